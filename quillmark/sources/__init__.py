"""Landed files as DataFrames, and sinks."""
