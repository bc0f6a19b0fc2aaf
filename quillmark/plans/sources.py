"""Queries over landed sources: feeds, sitemaps and posts made from documents and read back; quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources import crawl, feeds, registry_files
from .registry import query
from .tables import CANONICAL, DOC_ITEMS, doc_items, table


#: Ids of one landed page of a feed, a sitemap or posts; a page is one string.
PAGE = 200


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of a source, a page for each PAGE ids: RSS for even documents, Atom for odd ones."""
    d = doc_items(spark, sf_dir).where("title <> ''").select("id", "source", "title", F.regexp_replace("text", r"\s+", " ").alias("body"))
    rss = F.concat(F.lit("<item><title>"), _xml(F.col("title")), F.lit("</title><link>/doc/"), F.col("id").cast("string"), F.lit("</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate><description>"), _xml(F.col("body")), F.lit("</description></item>"))
    atom = F.concat(F.lit("<entry><title>"), _xml(F.col("title")), F.lit('</title><link rel="self" href="/self"/><link rel="alternate" href="https://feeds.example.com/doc/'), F.col("id").cast("string"), F.lit('"/><updated>2024-03-05T10:00:00Z</updated><summary>'), _xml(F.col("body")), F.lit("</summary></entry>"))
    block = F.when(F.col("id") % 2 == 0, rss).otherwise(atom)
    g = d.groupBy("source", F.floor(F.col("id") / PAGE).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]), "").alias("xml"))
    return g.select("source", F.lit("https://feeds.example.com/a/feed.xml").alias("feed_url"), F.concat(F.lit("<rss>"), "xml", F.lit("</rss>")).alias("xml"))


_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_FEED_SQL = "WITH {docs} SELECT id, source, {title} AS title, left({body}, {n}) AS summary FROM docs WHERE title <> ''"


def _feed_sql(n: int) -> str:
    body = _CLEAN.format(r"regexp_replace(text, '\s+', ' ', 'g')")
    return _FEED_SQL.format(docs=DOC_ITEMS, title=_CLEAN.format("title"), body=body, n=n)


def _items(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    i = feeds.parse_feeds(_feeds(spark, sf_dir), kind)
    return i.where("date = TIMESTAMP '2024-03-05 10:00:00'").select(F.regexp_extract("url", r"^https://feeds\.example\.com/doc/(\d+)$", 1).cast("long").alias("id"), "source", "title", "summary")


@query("src05_feed_items", _feed_sql(280))
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "updates")


@query("src06_feed_items_korean", _feed_sql(320))
def feed_items_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "korean-code")


@query("src07_feed_items_cinema", _feed_sql(340))
def feed_items_cinema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "cinema")


@query("src09_feed_items_history", _feed_sql(360))
def feed_items_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "history")


@query("src13_sitemap", "SELECT url, CAST(TIMESTAMP '2024-01-01 00:00:00' + page_id % 28 * INTERVAL 1 DAY AS VARCHAR) AS modified, false AS is_index FROM pages")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parse_sitemaps(_sitemaps(spark, sf_dir)).select("url", F.col("modified").cast("string").alias("modified"), "is_index")


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    one = F.concat(F.lit("<url><loc>"), _xml(F.col("url")), F.lit("</loc><lastmod>2024-01-"), F.lpad(((F.col("page_id") % 28) + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    return p.groupBy(F.floor(F.col("page_id") / PAGE).alias("m")).agg(F.array_join(F.collect_list(one), "\n").alias("x")).select(F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("xml"))


@query("src14_sitemap_walk", f"SELECT DISTINCT {CANONICAL} AS url FROM pages")
def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a landed sitemap tree: an index of indexes of sitemaps, which name their index again."""
    name = lambda kind, n: F.concat(F.lit(f"https://maps.example.com/{kind}"), n.cast("string"), F.lit(".xml"))
    entry = lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))
    inside = lambda xs: F.concat(F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list(xs)), ""), F.lit("</sitemapindex>"))
    maps = table(spark, sf_dir, "pages").withColumn("m", F.floor(F.col("page_id") / PAGE)).groupBy("m").agg(F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), _xml(F.col("url")), F.lit("</loc></url>"))), "\n").alias("x"))
    maps = maps.select(F.floor(F.col("m") / PAGE).alias("i"), name("m", F.col("m")).alias("url"), F.concat(F.lit("<urlset>"), "x", entry(F.lit("https://maps.example.com/index.xml")), F.lit("</urlset>")).alias("xml"))
    parts = maps.groupBy("i").agg(inside(entry(F.col("url"))).alias("xml")).select(name("i", F.col("i")).alias("url"), "xml")
    top = parts.agg(inside(entry(F.col("url"))).alias("xml")).select(F.lit("https://maps.example.com/index.xml").alias("url"), "xml")
    landed = maps.select("url", "xml").unionByName(parts).unionByName(top)
    return crawl.walk_sitemaps(landed, top.select(F.lit("maps").alias("source"), "url"), most=1 << 30)[0].select("url")


@query("src10_posts", f"WITH {DOC_ITEMS} SELECT id, {_CLEAN.format('title')} AS title FROM docs WHERE title <> ''")
def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = feeds.parse_posts(_posts(spark, sf_dir))
    return p.select(F.regexp_extract("url", r"/(\d+)$", 1).cast("long").alias("id"), "title")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_items(spark, sf_dir).where("title <> ''")
    post = F.struct(F.struct(_xml(F.col("title")).alias("rendered")).alias("title"), F.concat(F.lit("https://posts.example.com/"), F.col("id").cast("string")).alias("link"), F.lit("2024-03-05T10:00:00").alias("date_gmt"))
    return d.groupBy("source", F.floor(F.col("id") / PAGE).alias("page")).agg(F.to_json(F.collect_list(post)).alias("json"))


@query("src35_link_health", """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'timeout' WHEN page_id % 13 = 0 THEN 'network-error' WHEN 200 + page_id % 5 * 101 IN (401, 403, 429) THEN 'restricted' WHEN 200 + page_id % 5 * 101 BETWEEN 200 AND 399 THEN 'reachable' ELSE 'error' END AS health FROM pages""")
def link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", (200 + F.col("page_id") % 5 * 101).alias("status"), F.when(F.col("page_id") % 11 == 0, "timeout").when(F.col("page_id") % 13 == 0, "reset").alias("error"))
    return feeds.link_status(p).select("page_id", "health")


@query("src24_archive_summary", "SELECT lang AS tab, count(*) AS items, count(DISTINCT doc_id % 30) AS days, CAST(max(doc_id % 30) AS BIGINT) AS newest FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("tab"), (F.col("doc_id") % 30).alias("day"))
    return registry_files.archive_summary(d).select("tab", "items", "days", F.element_at("dates", 1).alias("newest"))


@query("dq_assertions", """WITH a AS (SELECT count(*) AS n, count(*) - count(text) AS no_text, count(DISTINCT source) AS sources, max(length(text)) AS longest FROM documents)
    SELECT 'rows' AS check_id, CAST(n AS DOUBLE) AS observed, n >= 1 AS ok FROM a UNION ALL SELECT 'no_text', no_text, no_text = 0 FROM a UNION ALL SELECT 'sources', sources, sources <= 20 FROM a UNION ALL SELECT 'longest', longest, longest <= 1000 FROM a""")
def dq_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    checks = [("rows", F.count("*"), ">=", 1), ("no_text", F.count_if(F.col("text").isNull()), "=", 0), ("sources", F.countDistinct("source"), "<=", 20), ("longest", F.max(F.length("text")), "<=", 1000)]
    return quality.assertions(d, checks).select("check_id", "observed", "ok")


@query("cls26_item_defects", """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(text, '***') THEN 'symbols' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), ',') AS defects FROM documents""")
def item_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("short", F.length("text") < 100), ("symbols", F.col("text").contains("***")), ("shouting", F.col("text").contains("!!")), ("foreign", F.col("lang") != "en")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(quality.defects(rules), ",").alias("defects"))
