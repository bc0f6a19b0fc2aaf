"""Sitemap trees that a fetch job has landed: rounds of a frontier with a visited anti-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url, values
from ..operators.rounds import written
from .feeds import tag

# Fixed value: sitemaps that are read of a source.
MOST_MAPS = 12
_BLOCKS = r"(?is)(<(?:url|sitemap)\b.*?</(?:url|sitemap)>)"


def entries(maps: DataFrame) -> DataFrame:
    """(source, n, xml) -> source, n, pos, url, modified, and whether the entry names a further sitemap."""
    block = F.col("block")
    found = maps.select("source", "n", F.posexplode(F.regexp_extract_all("xml", F.lit(_BLOCKS), F.lit(1))).alias("pos", "block"))
    return found.select("source", "n", "pos", tag(block, "loc").alias("url"), values.lenient_timestamp(tag(block, "lastmod")).alias("modified"), block.rlike(r"(?i)^<sitemap\b").alias("is_index")).where("url IS NOT NULL")


def walk_sitemaps(landed: DataFrame, roots: DataFrame, most: int = MOST_MAPS, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """landed (url, xml) and roots (source, url) -> pages (source, url, modified, map) and maps (source, url, n, found).

    Breadth first: a round reads the sitemaps of its frontier, and the sitemaps that they name and that were not yet
    visited are the next frontier, in order of the map that names them and their place in it. At most ``most`` maps of
    a source and ``depth`` rounds are read; both are the feature's limits. Maps are told apart by canonical address, so
    index files that name each other end. A page counts once a source, with its first place; n numbers a source's maps
    from 1 in the order they are visited, found says if the file was landed.

    Edge cases: roots without a source or address go, repeated ones count once; of files landed twice under one
    address one is read, the greatest; a file that can't be read has no entries; empty tables give empty tables.
    """
    key = url.canonical(F.col("url"))
    files = landed.where("url IS NOT NULL").select(key.alias("url"), "xml").groupBy("url").agg(F.max("xml").alias("xml"))
    frontier = roots.where("source IS NOT NULL AND url IS NOT NULL").select("source", key.alias("url"), F.lit(0).alias("up"), F.lit(0).alias("pos"))
    visited, read, number = None, [], Window.partitionBy("source").orderBy("up", "pos", "url")
    for _ in range(depth):
        new = frontier.groupBy("source", "url").agg(F.min(F.struct("up", "pos")).alias("at")).select("source", "url", "at.up", "at.pos")
        before = None
        if visited is not None:
            new = new.join(visited.select("source", "url"), ["source", "url"], "left_anti")
            before = visited.groupBy("source").agg(F.max("n").alias("before"))
        new = new.withColumn("k", F.row_number().over(number)).where(F.col("k") <= most)
        new = new.join(before, "source", "left") if before is not None else new.withColumn("before", F.lit(0))
        new = new.withColumn("n", F.coalesce("before", F.lit(0)) + F.col("k")).where(F.col("n") <= most)
        maps = written(new.join(files, "url", "left").select("source", "url", "n", "xml"))
        if maps.isEmpty():
            break
        read.append(maps)
        visited = reduce(DataFrame.unionByName, [m.select("source", "url", "n") for m in read])
        named = written(entries(maps.where("xml IS NOT NULL")).where("is_index"))
        frontier = named.select("source", key.alias("url"), F.col("n").alias("up"), "pos")
    if not read:
        empty = roots.select("source", "url").limit(0)
        return empty.withColumn("modified", F.lit(None).cast("timestamp")).withColumn("map", F.lit(0)), empty.withColumn("n", F.lit(0)).withColumn("found", F.lit(False))
    every = reduce(DataFrame.unionByName, read)
    found = entries(every.where("xml IS NOT NULL")).where("NOT is_index").withColumn("key", key)
    pages = found.groupBy("source", "key").agg(F.min_by(F.struct("modified", "n"), F.struct("n", "pos")).alias("v"))
    return pages.select("source", F.col("key").alias("url"), "v.modified", F.col("v.n").alias("map")), every.select("source", "url", "n", F.col("xml").isNotNull().alias("found"))
