"""Queries over vectors: normalisation, quantisation, hybrid ranking, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import select, similar
from .registry import query
from .tables import table


@query("fn26_l2_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(values.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("fn27_quantise", "SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_max(q) AS INT) AS top FROM (SELECT vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, CAST(floor(CAST(x AS DOUBLE) * 400 + 0.5) AS INT)))) AS q FROM embeddings)")
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").select("vec_id", values.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("q").alias("top"))


_Q = "list_transform(embedding, lambda x: greatest(-127, least(127, CAST(floor(CAST(x AS DOUBLE) * 400 + 0.5) AS INT))))"


@query("cls19_hybrid_rank", f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, label, floor(10000.0 * (list_sum(list_transform(list_zip({_Q}, qv), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / 400 + 0.02 * least(3, label % 4) + CASE WHEN label % 2 = 0 THEN 0.03 ELSE 0 END) + 0.5) / 10000 AS score FROM embeddings, q WHERE vec_id <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s)
    SELECT vec_id, label, score FROM r WHERE k <= 3 ORDER BY score DESC, vec_id LIMIT 20""")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised dot product, lexical and archive bonuses, three a source, the best twenty."""
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("qv")))
    score = values.dot(values.quantised(F.col("embedding")), F.col("qv")) / 400 + 0.02 * F.least(F.lit(3), F.col("label") % 4) + F.when(F.col("label") % 2 == 0, 0.03).otherwise(0)
    s = e.where("vec_id <> 0").join(q).select("vec_id", "label", (F.floor(10000.0 * score + 0.5) / 10000).alias("score"))
    return select.capped_top(s, "label", [F.desc("score"), F.col("vec_id")], 3, 20)


@query("sel19_similar_items", """WITH q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query, vec_id AS neighbour, list_sum(list_transform(list_zip(qv, embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) AS score FROM embeddings, q WHERE vec_id <> query)
    SELECT query, neighbour, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) <= 5""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of each stated query (ids divisible by 100), without the query itself."""
    e = table(spark, sf_dir, "embeddings")
    return similar.nearest(e, e.where("vec_id % 100 = 0"), 5).select("query", "neighbour", F.round("score", 6).alias("score"))


@query("snk05_shard_manifest", "SELECT label % 3 AS shard, count(*) AS n, count(*) FILTER (WHERE vec_id % 4 <> 0) AS vectorised FROM embeddings GROUP BY 1")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("shard"), F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("v"))
    return e.groupBy("shard").agg(F.count("*").alias("n"), F.count("v").alias("vectorised"))
