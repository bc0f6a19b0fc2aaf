"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Native: DataFrame functions only.

Sources are ranked by code point (null last); ``weights`` repeat along that rank. All sources share the
corpus size T (its words). Source i aims at ``level * w_i`` words, never above ``cap = max_epochs * size_i``;
what a capped source leaves is shared again by weight. That fixpoint is found without a loop: with sources
in order of cap/weight, source i is capped if and only if cap_i / w_i <= (T - caps before) / (W - weights
before), and the level is what remains over the weights that remain.

A source that aims at r times its size takes each document floor(r) times, and the documents first in a
seeded hash order once more until the remainder is filled; the document at the border is taken if at least
half of it fits, so the source misses its target by half a document at most. The running sum along the hash
order has two levels (4096 hash ranges a source, then the documents of one range), so a source that holds a
third of all rows is spread over thousands of window groups.

Rows without an id are dealt by their texts.

Edge cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own;
repeated rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, text_or_empty

RANGE_DIGITS = 3  # hexadecimal digits of the hash that name a range


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(no_source, src, source_size) -> the same and target. One row a source: a summary, not the corpus."""
    by_name = Window.partitionBy(F.lit(0)).orderBy("no_source", "src")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("ratio", "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("w_all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    s = s.withColumn("capped", F.col("ratio") <= (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    s = s.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)).alias("cap_sum"),
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0)).alias("w_sum"),
    )
    level = (F.col("total") - F.col("cap_sum")) / (F.col("w_all") - F.col("w_sum"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * level)
    return s.select("no_source", "src", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", row_col: str | None = None,
) -> DataFrame:
    """Per document: id, source, size, source_size, target (of its source), taken (words) and times (copies).

    With row_col, also the row of docs itself as a struct of that name, so that no join on the id is needed.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), text_or_empty(F.col(text_col))))).cast("binary"))
    sized = (
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.col(source_col).isNull().cast("int").alias("no_source"),
            F.coalesce(F.col(source_col), F.lit("")).alias("src"),
            F.regexp_count(text_or_empty(F.col(text_col)), F.lit(WORD)).cast("long").alias("size"),
            key.alias("h"),
            *([F.struct(*docs.columns).alias("row")] if row_col else []),
        )
        .withColumn("part", F.substring("h", 1, RANGE_DIGITS))
        .repartition("no_source", "src", "part")
    )
    place = ["no_source", "src", "part"]
    ranges = sized.groupBy(*place).agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("no_source", "src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    sources = source_targets(ranges.groupBy("no_source", "src").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    ranges = ranges.join(sources, ["no_source", "src"])
    inside = Window.partitionBy(*place).orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, place)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    more = F.col("ahead") + F.col("inside") + F.col("size") / 2 <= F.col("target") - whole * F.col("source_size")
    times = whole + F.when(more & (F.col("target") > whole * F.col("source_size")), 1).otherwise(0)
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("size") * times).alias("taken"), F.when(F.col("size") > 0, times).otherwise(F.lit(0)).cast("long").alias("times"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
o AS (
  SELECT *, source_size * 3 AS cap, source_size * 3 / CAST(w AS DOUBLE) AS ratio,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM src),
p AS (
  SELECT *, ratio <= (total - coalesce(sum(cap) OVER b, 0)) / CAST(w_all - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS capped
  FROM o WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w *
         ((total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))
          / CAST(w_all - coalesce(sum(w) FILTER (WHERE capped) OVER (), 0) AS DOUBLE)) END AS target FROM p),
d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN target > whole * source_size AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d
"""
