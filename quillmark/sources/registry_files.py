"""Source registries and bookmark trees from JSON, and archives by tab and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url, values

SOURCE = "struct<id:string,name:string,publisherName:string,url:string,field:string,feedUrls:array<string>,jsonUrls:array<string>,focus:string,referenceLenses:array<string>,category:string,region:string,trustReason:string>"


def read_sources(spark: SparkSession, path: str, field: str = "sources") -> DataFrame:
    """One row a source of a registry document {field: [...]}."""
    raw = spark.read.schema(f"`{field}` array<{SOURCE}>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.posexplode(field).alias("pos", "s")).select("pos", "s.*")


def feeds_of(sources: DataFrame) -> DataFrame:
    """(source, feed_pos, feed_url): feeds, then JSON endpoints, in order."""
    every = F.concat(F.coalesce("feedUrls", F.array().cast("array<string>")), F.coalesce("jsonUrls", F.array().cast("array<string>")))
    return sources.select(F.col("id").alias("source"), F.posexplode(every).alias("feed_pos", "feed_url"))


def verified_items(sources: DataFrame) -> DataFrame:
    """Verified sources as items of their own layer."""
    kind = F.when(F.lower("category").rlike("video|film"), "video").when(F.lower("category").rlike("image|photo"), "image").otherwise("web")
    return sources.select("id", F.col("name").alias("title"), "url", url.host(F.col("url")).alias("host"), kind.alias("kind"), F.lit("verified").alias("layer"), F.col("trustReason").alias("trust_reason"))


def bookmarks(spark: SparkSession, nodes: DataFrame, folders: list[str]) -> DataFrame:
    """Links below the named folders of a tree (node_id, parent_id, name, type, url, added), with their paths.

    A recursive query walks the tree level by level; a link below two named folders counts for each of them.
    """
    nodes.createOrReplaceTempView("quillmark_nodes")
    names = ", ".join("'" + f.replace("'", "''") + "'" for f in folders)
    walked = spark.sql(f"""WITH RECURSIVE walk AS (
        SELECT node_id, name AS folder, name AS path, type, url, added, name AS title FROM quillmark_nodes WHERE type = 'folder' AND name IN ({names})
        UNION ALL SELECT n.node_id, w.folder, w.path || '/' || n.name, n.type, n.url, n.added, n.name FROM quillmark_nodes n JOIN walk w ON n.parent_id = w.node_id)
        SELECT node_id, title, url, folder, path, added FROM walk WHERE type = 'url'""")
    return walked.where(url.is_usable(F.col("url"))).select("node_id", "title", "url", url.host(F.col("url")).alias("host"), url.kind(F.col("url")).alias("kind"), "folder", "path", values.webkit_timestamp(F.col("added")).alias("added"))


def write_archive(items: DataFrame, path: str) -> None:
    """Replaces the (tab, day) partitions that items hold; others stay."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tab", "day").parquet(path)


def read_archive(spark: SparkSession, path: str, tab: str | None = None) -> DataFrame:
    """The archive, or one tab of it (a pruned partition)."""
    a = spark.read.parquet(path)
    return a if tab is None else a.where(F.col("tab") == tab)


def archive_summary(items: DataFrame) -> DataFrame:
    """By tab: items, days, and the list of days, newest first."""
    return items.groupBy("tab").agg(F.count("*").alias("items"), F.countDistinct("day").alias("days"), F.sort_array(F.collect_set("day"), asc=False).alias("dates"))


def write_shards(docs: DataFrame, path: str) -> None:
    """Vector shards: rows with vectors first, then lexical ones, inside each file."""
    docs.repartition("shard").sortWithinPartitions("shard", F.col("embedding").isNull(), "id").write.mode("overwrite").partitionBy("shard").parquet(path)


def reused_vectors(docs: DataFrame, old: DataFrame, budget: int) -> DataFrame:
    """docs (id, h, ...) with the old vector where the content hash is the same, and ``embed``: the newest
    changed rows within the budget, which are to be embedded again; the rest stay lexical."""
    joined = docs.join(old.select("id", F.col("h").alias("old_h"), "embedding"), "id", "left")
    same = F.coalesce(F.col("old_h") == F.col("h"), F.lit(False))
    joined = joined.withColumn("embedding", F.when(same, F.col("embedding"))).withColumn("changed", ~same).drop("old_h")
    due = joined.where("changed").select("id", "day").orderBy(F.desc("day"), "id").limit(budget).select("id", F.lit(True).alias("embed"))
    return joined.join(due, "id", "left").withColumn("embed", F.coalesce("embed", F.lit(False))).drop("changed")
