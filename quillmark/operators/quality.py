"""Assertions about tables as one result table, and lists of a row's defects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assertions(df: DataFrame, checks: list[tuple[str, Column, str, float]], group: str | None = None) -> DataFrame:
    """(check_id, observed, op, expected, ok) a check, all from one aggregate.

    checks: id, aggregate Column, one of ``= <= >=``, expected value.
    """
    grouped = df.groupBy(group) if group else df.groupBy()
    wide = grouped.agg(*[c.cast("double").alias(name) for name, c, _, _ in checks])
    one = lambda name, op, want: F.struct(F.lit(name).alias("check_id"), F.col(name).alias("observed"), F.lit(op).alias("op"), F.lit(float(want)).alias("expected"))
    long = wide.select(*([group] if group else []), F.explode(F.array(*[one(name, op, want) for name, _, op, want in checks])).alias("c")).select(*([group] if group else []), "c.*")
    ok = F.when(F.col("op") == "=", F.col("observed") == F.col("expected")).when(F.col("op") == "<=", F.col("observed") <= F.col("expected")).otherwise(F.col("observed") >= F.col("expected"))
    return long.withColumn("ok", F.coalesce(ok, F.lit(False)))


def defects(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold for a row, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def quarantine(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rows with defects)."""
    marked = df.withColumn("defects", defects(rules))
    return marked.where(F.size("defects") == 0).drop("defects"), marked.where(F.size("defects") > 0)


def pools(*parts: DataFrame) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
