"""Scores and classes as Columns made from rule lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points a term by field.
FIELD_POINTS = {"title": 12, "description": 8, "bookmark": 5, "text": 3}
ALL_TOKENS = 18


def field_score(fields: dict[str, Column], terms: list[str], query_tokens: list[str]) -> Column:
    """Points a term and field that contains it, and more if the fields together contain all query tokens."""
    low = {name: F.lower(F.coalesce(c, F.lit(""))) for name, c in fields.items()}
    score = F.lit(0)
    for t in terms:
        for name, c in low.items():
            score = score + F.when(c.contains(t.lower()), FIELD_POINTS[name]).otherwise(0)
    if query_tokens:
        every = F.lit(True)
        for t in query_tokens:
            some = F.lit(False)
            for c in low.values():
                some = some | c.contains(t)
            every = every & some
        score = score + F.when(every, ALL_TOKENS).otherwise(0)
    return score


def penalty(tests: list[Column], points: int, most: int) -> Column:
    n = F.lit(0)
    for t in tests:
        n = n + F.coalesce(t, F.lit(False)).cast("int")
    return F.least(F.lit(most), n * points)


def _counted(text: Column, rules: list[tuple[str, str]]) -> Column:
    """(minus count, place, name) a rule; structs compare by count, then by place."""
    return F.array(*[F.struct((-F.regexp_count(text, F.lit(p))).alias("minus"), F.lit(i).alias("place"), F.lit(name).alias("name")) for i, (name, p) in enumerate(rules)])


def best_rule(text: Column, rules: list[tuple[str, str]], fallback: Column) -> Column:
    """The rule with most matches, the first of equals; the fallback if none matches."""
    best = F.array_min(_counted(text, rules))
    return F.when(best["minus"] < 0, best["name"]).otherwise(fallback)


def top_rules(text: Column, rules: list[tuple[str, str]], most: int) -> Column:
    """Names of the rules with most matches."""
    found = F.array_sort(F.filter(_counted(text, rules), lambda x: x["minus"] < 0))
    return F.transform(F.slice(found, 1, most), lambda x: x["name"])


def ladder(x: Column, steps: list[tuple[float, str]], below: str) -> Column:
    out = None
    for least, name in steps:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return out.otherwise(below)


def rule_hits(df: DataFrame, row_id: str, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """(row, axis, hits): how many terms of an axis stand in a row."""
    found = F.array_compact(F.array(*[F.when(text.contains(term), F.lit(axis)) for axis, term in rules]))
    return df.select(row_id, F.explode(found).alias("axis")).groupBy(row_id, "axis").agg(F.count("*").alias("hits"))
