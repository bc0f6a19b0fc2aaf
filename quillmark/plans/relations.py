"""Relational joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranges
from .registry import query
from .tables import table


@query("jn_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # noqa: E741
    by = o.join(l, "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("r").alias("r"))
    return by.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"))


@query("jn04_semi_join_top", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 32)")
def semi_join_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is among the 32 best (the 32 ids are broadcast)."""
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).orderBy(F.desc("t"), "o_custkey").limit(32)
    return table(spark, sf_dir, "customer").join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("jn05_left_with_fallback", "SELECT c_custkey, coalesce(o.o_orderpriority, 'none') AS priority FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = c_custkey")
def left_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("p", F.lit("none")).alias("priority"))


@query("jn_range_price_bands", """WITH b(lo, hi, band) AS (VALUES (0.0, 1000.0, 'low'), (1000.0, 1500.0, 'mid'), (1400.0, 100000.0, 'high'))
    SELECT band, count(*) AS n FROM part JOIN b ON p_retailprice >= lo AND p_retailprice < hi GROUP BY 1""")
def range_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join by buckets: intervals are cut into buckets of the value's width, so rows meet by equality."""
    bands = spark.createDataFrame([(0.0, 1000.0, "low"), (1000.0, 1500.0, "mid"), (1400.0, 100000.0, "high")], "lo double, hi double, band string")
    return ranges.range_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 500.0).groupBy("band").agg(F.count("*").alias("n"))


@query("agg11_argmin_per_group", "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY 1")
def argmin_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"))


@query("win_ranks", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INT) AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("quarter"))


@query("win09_running_batches", "WITH c AS (SELECT o_orderkey, o_custkey, sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) SELECT o_orderkey, CAST(s // 500000 AS BIGINT) AS batch FROM c")
def running_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    s = F.sum(F.round("o_totalprice").cast("long")).over(w)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(s / 500000).alias("batch"))


@query("src15_tree_paths", """WITH RECURSIVE t AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS parent, n_name AS name FROM nation),
    p AS (SELECT id, name AS path, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, p.path || '/' || t.name, p.depth + 1 FROM t JOIN p ON t.parent = p.id)
    SELECT id, path, depth FROM p""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a folder tree by a recursive query."""
    table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "CASE WHEN n_nationkey > 0 THEN CAST(floor((n_nationkey - 1) / 3) AS INT) END AS parent", "n_name AS name").createOrReplaceTempView("quillmark_tree")
    return spark.sql("""WITH RECURSIVE p AS (SELECT id, name AS path, 0 AS depth FROM quillmark_tree WHERE parent IS NULL
        UNION ALL SELECT t.id, p.path || '/' || t.name, p.depth + 1 FROM quillmark_tree t JOIN p ON t.parent = p.id) SELECT id, path, depth FROM p""")
