"""Scores and rankings of the curated tabs; term lists and patterns are the caller's."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Points by age in days, and the least score of an update.
UPDATE_RECENCY, KOREAN_RECENCY = ((14, 15), (45, 11), (180, 6)), ((14, 16), (45, 10), (180, 4))
LEAST_UPDATE_SCORE = 35
# Reasons that rule an update out; all others are flags beside the score.
HARD_REASONS = ("commercial-noise", "announcement-news", "insufficient-evidence")


@dataclass(frozen=True)
class UpdateTerms:
    """Terms that speak for an update, by what they show, and patterns that speak against it."""

    perspective: tuple[str, ...]
    transferable: tuple[str, ...]
    evidence: tuple[str, ...]
    artifact: tuple[str, ...]
    craft: tuple[str, ...]
    noise: tuple[str, ...] = ()
    announcements: tuple[str, ...] = ()


def by_age(age: Column, steps: tuple[tuple[int, int], ...], older: int) -> Column:
    """Points by age; a null age counts as old."""
    out = F.lit(older)
    for days, points in reversed(steps):
        out = F.when(age <= days, points).otherwise(out)
    return out


#: A word's edge between a-z, 0-9 or _ and anything else, accented letters too: what \b means in the rule lists.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _edges(pattern: str) -> str:
    """The pattern with its edges spelled out; beside plain letters after the letter, so that most places fail at once."""
    pattern = re.sub(r"(?<![\\A-Za-z0-9_{])([A-Za-z0-9_]+)\\b", r"\1(?![A-Za-z0-9_])", pattern)
    pattern = re.sub(r"(?<!\\)\\b([A-Za-z0-9_])(?![?*+{])", r"\1(?<![A-Za-z0-9_]\1)", pattern)
    return pattern.replace(r"\b", _EDGE)


def hit_count(x: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns match; an edge of a word is one of plain letters, digits and underscores."""
    return sum((F.coalesce(x.rlike(_edges(p)), F.lit(False)).cast("int") for p in patterns), F.lit(0))


def update_words(title: Column, summary: Column, address: Column) -> Column:
    """What an update is scored by: title, summary and address in lower case; nulls are empty."""
    some = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.lower(F.concat(some(title), F.lit(" "), some(summary), F.lit(" "), F.coalesce(address, F.lit(""))))


def update_score(words: Column, summary: Column, image: Column, age: Column, bookmarked: Column, terms: UpdateTerms) -> Column:
    """struct(score, eligible, rejected, soft) of an update: five capped parts, and the reasons against it.

    Only noise, announcements and missing evidence rule an update out; the other reasons are soft flags: they stand
    in ``rejected`` and in ``soft``, and leave it eligible. A null image or bookmark counts as none, a null age as old.
    """
    kinds = ("perspective", "transferable", "evidence", "artifact", "craft")

    def counted(w: Column) -> Column:
        found = [text.hits_exact(w, list(getattr(terms, k))).alias(k) for k in kinds]
        return F.struct(*found, hit_count(w, terms.noise).alias("noise"), hit_count(w, terms.announcements).alias("announcements"), F.length(F.trim(F.coalesce(summary, F.lit("")))).alias("n"))

    def scored(seen: Column) -> Column:
        n = seen["n"]
        view = F.least(F.lit(30), 7 * seen["perspective"] + 4 * seen["craft"] + F.when((seen["perspective"] > 0) | (seen["craft"] > 0), 2).otherwise(0))
        use = F.least(F.lit(25), 4 * seen["transferable"] + F.when(seen["transferable"] > 0, 5).otherwise(0))
        proof = F.least(F.lit(20), F.when(n >= 90, 8).when(n >= 60, 4).otherwise(0) + 4 * seen["evidence"] + F.when(image, 4).otherwise(0))
        score = view + use + proof + by_age(age, UPDATE_RECENCY, 2) + F.when(bookmarked, 8).otherwise(10)
        documented = (n >= 90) & (seen["craft"] >= 1) & (seen["evidence"] >= 1) & (seen["transferable"] >= 2)
        reasons = [
            (seen["noise"] > 0, "commercial-noise"),
            (seen["announcements"] > 0, "announcement-news"),
            ((n < 60) & (seen["evidence"] == 0), "insufficient-evidence"),
            (seen["transferable"] == 0, "not-transferable"),
            (seen["artifact"] == 0, "outside-creative-practice"),
            ((seen["perspective"] == 0) & (seen["craft"] < 2) & ~documented, "no-creative-point-of-view"),
        ]
        said = lambda pairs: F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))
        soft = said([x for x in reasons if x[1] not in HARD_REASONS])
        hard = F.lit(False)
        for test, name in reasons:
            hard = hard | test if name in HARD_REASONS else hard
        return F.struct(score.alias("score"), (~hard & (score >= LEAST_UPDATE_SCORE)).alias("eligible"), said(reasons).alias("rejected"), soft.alias("soft"))

    # the words are read once for all counts, and a count once for all it says
    return text.once(text.once(words, counted), scored)


def korean_score(words: Column, title: Column, summary: Column, age: Column, bookmarked: Column, quality: tuple, korean: tuple, trusted: tuple, low: tuple) -> Column:
    """struct(score, passes): weighted hits, Hangul in the title counting as one, and the gates of the tab."""
    q, k, t = text.hits(words, list(quality)), text.hits(words, list(korean)), text.hits(words, list(trusted))
    k = k + F.coalesce(title.rlike("[가-힣]{2,}"), F.lit(False)).cast("int")
    bad, recency = hit_count(words, low), by_age(age, KOREAN_RECENCY, 0)
    score = 8 * q + 10 * k + 14 * t + F.when(bookmarked, 14).otherwise(0) + recency + F.when(F.length(summary) >= 80, 6).otherwise(0) - 24 * bad
    passes = (bad == 0) & (k > 0) & ((q > 0) | (t > 0) | bookmarked | (recency >= 10))
    return F.struct(score.alias("score"), passes.alias("passes"))


def cinema_score(words: Column, image: Column, quality: tuple, low: tuple) -> Column:
    return 8 * text.hits(words, list(quality)) - 24 * hit_count(words, low) + F.when(image, 8).otherwise(0)


def social_score(words: Column, novel: Column, engagement: Column, external: Column, creator: str, visual: str) -> Column:
    """Novelty, engagement up to 30, a bonus for references from outside, and what the words show."""
    return (
        F.when(novel, 40).otherwise(0) + F.least(F.lit(30), F.coalesce(engagement, F.lit(0))) + F.when(external, 25).otherwise(-15)
        + F.when(words.rlike(creator), 20).otherwise(0) + F.when(words.rlike(visual), 10).otherwise(0)
    )


def route_recommendations(items: DataFrame, route: str) -> DataFrame:
    """items (route, skipped, candidate, score) -> a row a route: novel, top and the recommendation."""
    g = items.groupBy(route).agg(F.count_if("candidate").alias("novel"), F.coalesce(F.max(F.when(F.col("candidate"), F.col("score"))), F.lit(0)).alias("top"), F.max("skipped").alias("skipped"))
    said = F.when(F.col("skipped"), "needs_credentials").when((F.col("top") >= 70) | (F.col("novel") >= 10), "watch").when(F.col("novel") > 0, "sample").otherwise("reject")
    return g.select(route, "novel", "top", said.alias("recommendation"))


def source_status(readings: DataFrame, source: str, today: Column, forget: int = 30) -> DataFrame:
    """readings (source, keep, sharpness, day) -> seen, kept, and demoted, trusted or watch; a demotion ends after so many unseen days."""
    g = readings.groupBy(source).agg(F.count("*").alias("seen"), F.count_if("keep").alias("kept"), F.avg("sharpness").alias("sharp"), F.max("day").alias("last"))
    rate = F.col("kept") / F.col("seen")
    low = (F.col("seen") >= 8) & (rate < 0.2) & (F.col("sharp") < 4.5) & (F.datediff(today, F.col("last")) < forget)
    return g.select(source, "seen", "kept", "last", F.when(low, "demoted").when((F.col("seen") >= 6) & (rate >= 0.6), "trusted").otherwise("watch").alias("status"))


def without_demoted(items: DataFrame, status: DataFrame, source: str) -> DataFrame:
    """Items of sources that are not demoted; names are compared in lower case."""
    demoted = status.where("status = 'demoted'").select(F.lower(source).alias("_demoted"))
    return items.join(demoted, F.lower(items[source]) == F.col("_demoted"), "left_anti")


def clean_summary(summary: Column, title: Column, source: Column) -> Column:
    """Without the source's name at its end; empty if it only repeats the title."""
    s = text.decode_entities(F.coalesce(summary, F.lit("")))
    tail = F.concat(F.lit(" "), F.lower(source))
    s = F.when(F.lower(s).endswith(tail), F.trim(F.left(s, F.length(s) - F.length(tail)))).otherwise(s)
    core = F.trim(F.regexp_replace(title, r"\s+-\s+[^-]+$", ""))
    return F.when(F.lower(s).isin(F.lower(title), F.lower(core)), F.lit("")).otherwise(s)


def first_label(x: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(fallback)
    for label, pattern in reversed(rules):
        out = F.when(x.rlike(pattern), label).otherwise(out)
    return out


def labels(x: Column, rules: list[tuple[str, str]], most: int = 5) -> Column:
    """The first distinct labels whose patterns match, joined."""
    return F.array_join(F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(label)) for label, p in rules]))), 1, most), ", ")
