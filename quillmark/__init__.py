"""Curation, retrieval and corpus preparation on PySpark DataFrames."""
