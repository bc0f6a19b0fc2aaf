"""Curation expressions: query expansion, source profiles, candidate verdicts, hypotheses, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .rounds import written

# Boosts by layer of a source.
LAYER_BOOST = {"core": 18, "history": 10, "verified": 8}


def layer_boost(layer: Column) -> Column:
    out = F.lit(0)
    for name, points in LAYER_BOOST.items():
        out = F.when(layer == name, points).otherwise(out)
    return out


def expand_query(query: Column, lexicon: dict[str, list[str]]) -> Column:
    """Tokens of a query, and of every concept of which the query holds the key or an expansion."""
    low = F.lower(query)
    out = text.query_tokens(query)
    for key, terms in lexicon.items():
        named = low.contains(key)
        for t in terms:
            named = named | low.contains(t)
        words = [key, *dict.fromkeys(w for t in terms for w in t.split() if len(w) > 1)]
        out = F.concat(out, F.when(named, F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def first_profile(x: Column, profiles: list[tuple[str, str, list[str]]], fallback: str) -> Column:
    """The first profile whose pattern matches: struct(name, strengths)."""
    out = F.struct(F.lit(fallback).alias("name"), F.array().cast("array<string>").alias("strengths"))
    for name, pattern, strengths in reversed(profiles):
        out = F.when(x.rlike(pattern), F.struct(F.lit(name).alias("name"), F.array(*[F.lit(s) for s in strengths]).alias("strengths"))).otherwise(out)
    return out


def profile_boost(strengths: Column, axes: Column, weight: Column) -> Column:
    """Half-up rounded five points a shared strength, by weight."""
    return F.floor(5 * F.size(F.array_intersect(strengths, axes)) * weight + 0.5).cast("int")


def reasons(pairs: list[tuple[Column, str]], most: int = 4) -> Column:
    """The first so many reasons whose tests hold."""
    return F.slice(F.array_compact(F.array(*[F.when(test, F.lit(said)) for test, said in pairs])), 1, most)


def candidate_verdicts(rows: DataFrame, source: str, key: str, archived: DataFrame) -> DataFrame:
    """By source: fetched, distinct, novel, score 10 * novel + 40 * ratio + 10 or - 20, and promote, watch or reject."""
    known = archived.select(F.col(key), F.lit(True).alias("_known")).distinct()
    d = rows.groupBy(source, key).agg(F.count("*").alias("n")).join(known, key, "left")
    g = d.groupBy(source).agg(F.sum("n").alias("fetched"), F.count("*").alias("distinct"), F.count_if(F.col("_known").isNull()).alias("novel"))
    ratio = F.col("novel") / F.greatest(F.col("distinct"), F.lit(1))
    g = g.withColumn("score", F.floor(10 * F.col("novel") + 40 * ratio + F.when(F.col("novel") > 0, 10).otherwise(-20) + 0.5))
    return g.withColumn("verdict", F.when(F.col("score") >= 80, "promote").when(F.col("score") >= 35, "watch").otherwise("reject"))


def hypotheses(claims: DataFrame, items: DataFrame, least_evidence: int = 3, least_sources: int = 2) -> DataFrame:
    """claims (claim, ids) resolved with items (id, source, day): claims with enough evidence of enough sources."""
    e = claims.select("claim", F.explode(F.array_distinct("ids")).alias("id")).join(items.select("id", "source", "day"), "id")
    g = e.groupBy("claim").agg(F.count("*").alias("evidence"), F.countDistinct("source").alias("sources"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return g.where((F.col("evidence") >= least_evidence) & (F.col("sources") >= least_sources))


def merge_archives(incoming: DataFrame, existing: DataFrame, group: str) -> DataFrame:
    """Incoming rows over existing ones: a row is kept if neither its address nor its title is held by a kept row.

    Rows: group, pos, id, url_key, title_key, over keys alone; ties of pos go by id, a null group is a group, rows
    without an address are never kept, empty and null titles clash with nothing. Of rows with the same address and
    title only the first can be kept, so copies are collapsed on the map side. Then in rounds: a row that is the first
    of those left with its address and of those with its title is kept, and all rows that share either with it go.
    Each round keeps at least the first row left of every group; a row in a chain of n rows, each of which shares
    a key with the next alone, may wait n / 2 rounds.
    """
    rows = incoming.withColumn("_part", F.lit(0)).unionByName(existing.withColumn("_part", F.lit(1))).where("url_key <> ''")
    url, title = F.struct(F.col(group).alias("g"), F.col("url_key").alias("k")), F.struct(F.col(group).alias("g"), F.col("title_key").alias("k"))
    rows = rows.select(url.alias("url"), F.when(F.col("title_key") != "", title).alias("title"), F.struct("_part", "pos", "id").alias("at"))
    left, kept = written(rows.groupBy("url", "title").agg(F.min("at").alias("at"))), []
    while not kept or not left.isEmpty():
        first_url, first_title = left.groupBy("url").agg(F.min("at").alias("u")), left.where("title IS NOT NULL").groupBy("title").agg(F.min("at").alias("t"))
        first = left.join(first_url, "url").where("at = u").join(first_title, "title", "left").where("t IS NULL OR at = t")
        kept.append(written(first.select("url", "title", "at")))
        left = written(left.join(kept[-1].select("url"), "url", "left_anti").join(kept[-1].select("title"), "title", "left_anti"))
    return reduce(DataFrame.unionByName, kept).select(F.col("url.g").alias(group), F.col("at.id").alias("id"))
