"""Feeds, sitemaps and posts that a fetch job has landed as text, parsed to rows without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, url, values

# Characters of a summary by kind of feed.
SUMMARY_CHARS = {"updates": 280, "korean-code": 320, "cinema": 340, "history": 360}


def unescaped(x: Column) -> Column:
    """Content of CDATA sections, decoded entities (the five named, numeric quotes and non-breaking spaces)."""
    x = F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(x)


def _inside(block: Column, name: str) -> Column:
    return unescaped(F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1))


def tag(block: Column, name: str) -> Column:
    """The content of the first such element; null if there is none."""
    return F.nullif(_inside(block, name), F.lit(""))


def attribute(block: Column, name: str, attr: str) -> Column:
    return F.nullif(unescaped(F.regexp_extract(block, rf"""(?is)<{name}\b[^>]*\b{attr}=["']([^"']+)["']""", 1)), F.lit(""))


def _alternate(block: Column) -> Column:
    """The address of the alternate link, else of the first link that has one; empty if none has."""
    alternate = F.regexp_extract(block, r"""(?is)<link\b(?=[^>]*\brel=["']alternate["'])[^>]*\bhref=["']([^"']+)["']""", 1)
    return unescaped(F.when(alternate != "", alternate).otherwise(F.regexp_extract(block, r"""(?is)<link\b[^>]*\bhref=["']([^"']+)["']""", 1)))


def plain(x: Column, most: int) -> Column:
    """A summary: without markup, feed boilerplate and what is beyond the limit."""
    return F.left(text.clean_feed(text.strip_html(x)), F.lit(most))


def absolute(link: Column, base: Column) -> Column:
    """A link in full: as it is, from the root of its feed's site, or beside its feed."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    beside = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(beside == "", F.concat(root, F.lit("/"))).otherwise(beside), link))
    )


def _as_computed(df: DataFrame) -> DataFrame:
    """The same rows; filters and projections above are not merged into the expressions below."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def parse_feeds(feeds: DataFrame, kind: str = "updates") -> DataFrame:
    """(source, feed_url, xml) -> items: source, feed_url, pos, title, url, date, summary, image.

    RSS items and Atom entries; rows without a title or a link go. Fallbacks: link, then guid or id; pubDate, then
    dc:date, published, updated; description, then summary, then content; enclosure, media, then the first image.
    """
    block = F.col("block")
    blocks = feeds.select("source", "feed_url", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)(<item\b.*?</item>|<entry\b.*?</entry>)"), F.lit(1))).alias("pos", "block"))
    # Fields become columns of their own first: fallbacks name each of them twice.
    names = {n: n.replace(":", "_") for n in ("link", "guid", "id", "pubDate", "dc:date", "published", "updated", "title", "description", "summary", "content:encoded", "content")}
    read = _as_computed(blocks.select("source", "feed_url", "pos", "block", *[_inside(block, n).alias(c) for n, c in names.items()], _alternate(block).alias("alternate")))
    some = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    picked = _as_computed(read.select(
        "source", "feed_url", "pos", "title", some("link", "alternate", "guid", "id").alias("link"), some("pubDate", "dc_date", "published", "updated").alias("date"),
        F.coalesce(some("description", "summary", "content_encoded", "content"), F.lit("")).alias("body"),
        F.coalesce(attribute(block, "enclosure", "url"), attribute(block, "media:content", "url"), attribute(block, "media:thumbnail", "url"), F.nullif(F.regexp_extract("block", r"""(?i)(?:<|&lt;)img[^>]+src=["']([^"']+)["']""", 1), F.lit(""))).alias("image"),
    ))
    items = picked.select("source", "feed_url", "pos", text.strip_html(F.col("title")).alias("title"), absolute(F.col("link"), F.col("feed_url")).alias("url"), values.lenient_timestamp(F.col("date")).alias("date"), plain(F.col("body"), SUMMARY_CHARS[kind]).alias("summary"), "image")
    return _as_computed(items).where("title <> '' AND url IS NOT NULL")


def parse_sitemaps(maps: DataFrame) -> DataFrame:
    """(xml) -> url, modified, and whether it names a further sitemap."""
    block = F.col("block")
    found = maps.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)(<(?:url|sitemap)\b.*?</(?:url|sitemap)>)"), F.lit(1))).alias("block"))
    return found.select(tag(block, "loc").alias("url"), values.lenient_timestamp(tag(block, "lastmod")).alias("modified"), block.rlike(r"(?i)^<sitemap\b").alias("is_index")).where("url IS NOT NULL")


POSTS = "array<struct<title:struct<rendered:string>,link:string,guid:struct<rendered:string>,date:string,date_gmt:string,excerpt:struct<rendered:string>,content:struct<rendered:string>>>"


def parse_posts(landed: DataFrame, most: int = 280) -> DataFrame:
    """(source, json) of a posts endpoint -> source, title, url, date, summary."""
    p = landed.select("source", F.explode(F.from_json("json", POSTS)).alias("p"))
    return p.select(
        "source", text.strip_html(F.col("p.title.rendered")).alias("title"), F.coalesce("p.link", "p.guid.rendered").alias("url"),
        values.lenient_timestamp(F.coalesce("p.date_gmt", "p.date")).alias("date"), plain(F.coalesce("p.excerpt.rendered", "p.content.rendered", F.lit("")), most).alias("summary"),
    ).where("title <> '' AND url IS NOT NULL")


def first_full_feed(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Only the items of each source's first feed (by pos) that has any."""
    full = feeds.join(items.select("source", "feed_url").distinct(), ["source", "feed_url"], "left_semi")
    first = full.groupBy("source").agg(F.min_by("feed_url", "feed_pos").alias("feed_url"))
    return items.join(first, ["source", "feed_url"], "left_semi")


def link_status(probes: DataFrame) -> DataFrame:
    """probes (url, status, error) and health: reachable, restricted, timeout, error or network-error."""
    health = (
        F.when(F.col("error") == "timeout", "timeout").when(F.col("error").isNotNull(), "network-error").when(F.col("status").isin(401, 403, 429), "restricted")
        .when(F.col("status").between(200, 399), "reachable").otherwise("error")
    )
    return probes.withColumn("health", health)


def tiers(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """rows (url, health) with host and tier: A for trusted hosts, B for other sources, C for the rest."""
    r = rows.withColumn("host", url.host(F.col("url"))).join(trusted.select("host", F.lit(True).alias("trusted")), "host", "left")
    tier = F.when(F.col("trusted") & (F.col("health") == "reachable"), "A").when(url.is_source_level(F.col("url")), "B").otherwise("C")
    return r.withColumn("tier", tier).drop("trusted")
