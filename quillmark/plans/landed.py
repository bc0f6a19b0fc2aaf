"""Queries over landed files: loose JSON of platforms, and packed vector shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators.rounds import shared_folder
from ..sources import loose, packed
from .registry import query
from .tables import table

PLATFORMS = ["bluesky", "reddit", "youtube"]


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as landed answers of three platforms, a line a turn; every eleventh line is cut off, every thirteenth lists nothing."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("turn", "role", "text", "conv_id", (F.col("conv_id") * 31 + F.col("turn")).alias("n"))
    s = F.struct
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    ident = F.concat(name, F.lit("t"), F.col("turn").cast("string"))
    external = F.when(F.col("role") == "user", s(F.concat(F.lit("https://example.com/"), ident).alias("uri"), F.left("text", F.lit(20)).alias("title")))
    posts = s(F.array(s(s(name.alias("handle")).alias("author"), s("text", F.lit("2024-03-01T10:00:00Z").alias("createdAt")).alias("record"), s(external.alias("external")).alias("embed"),
        F.concat(F.lit("at://x/"), ident).alias("uri"), F.col("turn").alias("likeCount"), F.when(F.col("turn") % 2 == 0, F.lit("3")).otherwise(F.lit("many")).alias("repostCount"))).alias("posts"))
    children = s(s(F.array(s(s(F.concat(F.lit("/r/"), ident).alias("permalink"), name.alias("author"), F.left("text", F.lit(30)).alias("title"), F.col("text").alias("selftext"),
        F.col("turn").alias("score"), F.lit(4).alias("num_comments"), F.lit(1_709_287_200).alias("created_utc"), F.lit("self").alias("thumbnail")).alias("data"))).alias("children")).alias("data"))
    items = s(F.array(s(s(ident.alias("videoId")).alias("id"), s(name.alias("channelTitle"), F.col("text").alias("description"), F.lit("2024-03-01T10:00:00Z").alias("publishedAt")).alias("snippet"))).alias("items"))
    line = F.when(F.col("conv_id") % 3 == 0, F.to_json(posts)).when(F.col("conv_id") % 3 == 1, F.to_json(children)).otherwise(F.to_json(items))
    line = F.when(F.col("n") % 11 == 0, F.left(line, F.length(line) - 2)).when(F.col("n") % 13 == 0, F.lit('{"cursor": 1}')).otherwise(line)
    root = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    c.select(line.alias("value"), (F.col("conv_id") % 3).alias("p")).write.partitionBy("p").text(root)
    first, *rest = [loose.landed(spark, f"{root}/p={i}", p) for i, p in enumerate(PLATFORMS)]
    for r in rest:
        first = first.unionByName(r)
    return first


_LINES = "c AS (SELECT *, conv_id * 31 + turn AS n, 'c' || conv_id AS name, 'c' || conv_id || 't' || turn AS ident, conv_id % 3 AS p FROM conversations WHERE text IS NOT NULL)"


@query("src21_social_candidates", f"""WITH {_LINES} SELECT CASE p WHEN 0 THEN 'bluesky' WHEN 1 THEN 'reddit' ELSE 'youtube' END AS platform, name AS author,
    coalesce(nullif(CASE WHEN p = 0 AND role = 'user' THEN left(text, 20) WHEN p = 1 THEN left(text, 30) END, ''), left(text, 100)) AS title,
    CASE WHEN p = 0 AND role = 'user' THEN 'https://example.com/' || ident WHEN p = 0 THEN 'https://bsky.app/profile/' || name || '/post/' || ident WHEN p = 1 THEN 'https://www.reddit.com/r/' || ident ELSE 'https://www.youtube.com/watch?v=' || ident END AS url,
    CAST(CASE p WHEN 0 THEN turn + CASE WHEN turn % 2 = 0 THEN 6 ELSE 0 END WHEN 1 THEN turn + 8 ELSE 0 END AS BIGINT) AS engagement, md5(text) AS body, 1709287200 AS at
    FROM c WHERE n % 11 <> 0 AND n % 13 <> 0""")
def social_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: candidates of three platforms' landed lines."""
    found = loose.usable(loose.candidates(landed_lines(spark, sf_dir)))
    return found.select("platform", "author", "title", "url", "engagement", F.md5("text").alias("body"), F.unix_seconds("date").cast("int").alias("at"))


@query("src25_broken_lines", f"""WITH {_LINES} SELECT CASE p WHEN 0 THEN 'bluesky' WHEN 1 THEN 'reddit' ELSE 'youtube' END AS platform, count(*) AS lines, count(*) FILTER (WHERE n % 11 = 0) AS broken, count(*) FILTER (WHERE n % 11 <> 0 AND n % 13 = 0) AS without FROM c GROUP BY 1""")
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-25: lines that are no JSON, or list nothing."""
    return loose.broken(landed_lines(spark, sf_dir))


SHARD_IDS = 512
_Q = "list_transform(embedding, lambda x: greatest(-127, least(127, CAST(floor(CAST(x AS DOUBLE) * 400 + 0.5) AS INT))))"


@query("snk05_vector_shards", f"""WITH e AS (SELECT vec_id, label, vec_id // {SHARD_IDS} AS shard, CASE WHEN vec_id % 7 <> 0 THEN {_Q} END AS q FROM embeddings)
    SELECT vec_id, label, shard, row_number() OVER (PARTITION BY shard ORDER BY q IS NULL, vec_id) AS place, md5(array_to_string(q, ',')) AS vector FROM e""")
def vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, SRC-30, JN-17: quantised vectors packed a shard, every seventh row without one, read again by position."""
    e = table(spark, sf_dir, "embeddings")
    q = e.select("vec_id", "label", F.floor(F.col("vec_id") / SHARD_IDS).alias("shard"), F.when(F.col("vec_id") % 7 != 0, values.quantised(F.col("embedding"))).alias("q"))
    size = e.select(F.size("embedding").alias("n")).first()
    root = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    packed.write(q, root, "shard", "vec_id", "q", size.n if size else 1)
    got = packed.read(spark, root, "shard")
    return got.select("vec_id", "label", "shard", "place", F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")).alias("vector"))
