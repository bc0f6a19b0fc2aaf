"""Loose JSON: landed lines of several platforms as one table of candidates, by a table of paths a platform.

A line is parsed once, into VARIANT, so that no schema is guessed from the data or breaks when a field changes its type;
a ``Shape`` says where the entries of a line are and, for each column, the paths that are tried in order. Lines that are no
JSON (``broken``) or that hold no list of entries are kept apart and counted, never fatal. One scan, no shuffle; lines are
split by Spark's text reader, entries come from exploding the line.

Edge cases: a field that is missing, null or of another type is the next path's, then null (numbers: 0); an empty line is
no line; an entry that is null or no object gives a row of nulls with its defaults; an entry without an address gets one
from ``Shape.address`` or stays without, which ``usable`` leaves out; repeated entries are kept; a file without lines and a
platform without a shape give no candidates; platform and lines pass through, further columns too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, NUMBER = "string", "double"
#: Length of a title that is cut from a text.
TITLE = 100


@dataclass(frozen=True)
class Shape:
    """Where a platform's lines have what a candidate needs.

    items: path of the list of entries. fields: column -> paths, the first that has a text counts. weights: path -> factor
    of its number in the engagement. address: from the entry (a VARIANT), where no path of ``url`` has one. seconds: path of
    a date in seconds since 1970, where ``date`` has none.
    """

    items: str
    fields: dict[str, list[str]]
    weights: dict[str, int] = field(default_factory=dict)
    address: Callable[[Column], Column] | None = None
    seconds: str | None = None


def said(entry: Column, *paths: str) -> Column:
    """The first text that isn't empty at one of the paths."""
    found = [F.nullif(F.try_variant_get(entry, p, TEXT), F.lit("")) for p in paths]
    return F.coalesce(*found, F.lit(None).cast("string"))


def number(entry: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(entry, path, NUMBER), F.lit(0.0))


def _bluesky_address(e: Column) -> Column:
    return F.concat(F.lit("https://bsky.app/profile/"), said(e, "$.author.handle"), F.lit("/post/"), F.element_at(F.split(said(e, "$.uri"), "/"), -1))


# Where the three platforms' answers have their fields, and what counts as engagement.
SHAPES = {
    "bluesky": Shape(
        "$.posts",
        {
            "author": ["$.author.handle"], "title": ["$.embed.external.title", "$.record.embed.external.title"], "text": ["$.record.text"],
            "url": ["$.embed.external.uri", "$.record.embed.external.uri"], "image": ["$.embed.external.thumb", "$.record.embed.external.thumb", "$.embed.images[0].thumb"], "date": ["$.record.createdAt"],
        },
        {"$.likeCount": 1, "$.repostCount": 2, "$.replyCount": 1},
        _bluesky_address,
    ),
    "reddit": Shape(
        "$.data.children",
        {"author": ["$.data.author"], "title": ["$.data.title"], "text": ["$.data.selftext"], "url": [], "image": ["$.data.thumbnail"], "date": []},
        {"$.data.score": 1, "$.data.num_comments": 2},
        lambda e: F.coalesce(F.concat(F.lit("https://www.reddit.com"), said(e, "$.data.permalink")), said(e, "$.data.url")),
        "$.data.created_utc",
    ),
    "youtube": Shape(
        "$.items",
        {
            "author": ["$.snippet.channelTitle"], "title": ["$.snippet.title"], "text": ["$.snippet.description"], "url": [],
            "image": ["$.snippet.thumbnails.high.url", "$.snippet.thumbnails.medium.url"], "date": ["$.snippet.publishedAt"],
        },
        {},
        lambda e: F.concat(F.lit("https://www.youtube.com/watch?v="), said(e, "$.id.videoId")),
    ),
}
COLUMNS = ("author", "title", "text", "url", "image", "date")


def landed(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """(platform, line) of the files under a path."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.lit(platform).alias("platform"), F.col("value").alias("line"))


def _parsed(lines: DataFrame, shapes: dict[str, Shape]) -> tuple[DataFrame, Column]:
    """(lines with v, the list of entries of a line by its platform; null if the line has none)."""
    v = lines.withColumn("v", F.try_parse_json("line"))
    items = F.coalesce(*[F.when(F.col("platform") == p, F.try_variant_get("v", s.items, "array<variant>")) for p, s in shapes.items()])
    return v, items


def broken(lines: DataFrame, shapes: dict[str, Shape] | None = None) -> DataFrame:
    """(platform, lines, broken, without): lines read, those that are no JSON, and those that are but have no list of entries."""
    v, items = _parsed(lines, shapes or SHAPES)
    bad = F.col("v").isNull()
    return v.groupBy("platform").agg(F.count("*").alias("lines"), F.count_if(bad).alias("broken"), F.count_if(~bad & items.isNull()).alias("without"))


def candidates(lines: DataFrame, shapes: dict[str, Shape] | None = None) -> DataFrame:
    """The entries of all sound lines: the columns of lines but ``line``, author, title, text, url, image, date, engagement."""
    shapes = shapes or SHAPES
    v, items = _parsed(lines, shapes)
    e = F.col("entry")
    entries = v.select(*[c for c in lines.columns if c != "line"], F.explode(items).alias("entry"))

    def by_platform(of: Callable[[Shape], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("platform") == p, of(s)) for p, s in shapes.items()])

    def engagement(s: Shape) -> Column:
        total = F.lit(0.0)
        for path, factor in s.weights.items():
            total = total + number(e, path) * factor
        return total

    def url(s: Shape) -> Column:
        return F.coalesce(said(e, *s.fields["url"]), s.address(e) if s.address else F.lit(None).cast("string"))

    def date(s: Shape) -> Column:
        at = F.try_to_timestamp(said(e, *s.fields["date"]))
        return F.coalesce(at, F.timestamp_seconds(F.try_variant_get(e, s.seconds, NUMBER))) if s.seconds else at

    text = F.coalesce(by_platform(lambda s: said(e, *s.fields["text"])), F.lit(""))
    image = F.coalesce(by_platform(lambda s: said(e, *s.fields["image"])), F.lit(""))
    return entries.select(
        *[c for c in entries.columns if c != "entry"],
        F.coalesce(by_platform(lambda s: said(e, *s.fields["author"])), F.lit("")).alias("author"),
        F.coalesce(by_platform(lambda s: said(e, *s.fields["title"])), F.nullif(F.left(text, F.lit(TITLE)), F.lit(""))).alias("title"),
        text.alias("text"), by_platform(url).alias("url"),
        F.when(image.startswith("http"), image).otherwise("").alias("image"),
        by_platform(date).alias("date"), by_platform(engagement).cast("long").alias("engagement"),
    )


def usable(found: DataFrame) -> DataFrame:
    """Candidates with an address."""
    return found.where(F.coalesce(F.trim("url"), F.lit("")) != "")
