"""Relational aggregates: pricing summary, grouping sets, pivots and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .tables import table


@query("agg_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("agg_rollup", "SELECT coalesce(n_regionkey, -1) AS region, coalesce(n_name, 'all') AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_regionkey", "n_name").agg(F.count("*").alias("n")).select(F.coalesce("n_regionkey", F.lit(-1)).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n")


@query("agg_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return o.na.fill(0)


@query("agg20_tab_summary", """WITH s AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1),
    c AS (SELECT *, 10 * parts + 40.0 * parts / n - 20 AS score FROM s) SELECT CASE WHEN score >= 5000 THEN 'promote' WHEN score >= 2000 THEN 'watch' ELSE 'reject' END AS verdict, count(*) AS n, min(l_suppkey) AS least FROM c GROUP BY 1""")
def tab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate scores by novelty (CLS-20) rolled up by verdict."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))
    score = 10 * F.col("parts") + 40.0 * F.col("parts") / F.col("n") - 20
    verdict = F.when(score >= 5000, "promote").when(score >= 2000, "watch").otherwise("reject")
    return s.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.min("l_suppkey").alias("least"))


@query("agg17_audit_summary", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))


@query("agg_sketches")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts and quantiles."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))
