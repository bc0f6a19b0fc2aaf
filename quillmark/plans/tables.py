"""The tables that queries read, and the rows that stand in for curated items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, url

# Small words that title tokens leave out.
STOP_WORDS = "the and for with from that this of to in is on at by".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_words():
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as items: id, url, host, title, html and a day (a page an hour)."""
    p = table(spark, sf_dir, "pages")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 3600)
    return p.select(F.col("page_id").alias("id"), "url", url.host(F.col("url")).alias("host"), text.page_title(F.col("html")).alias("title"), "html", F.to_date(ts).cast("string").alias("day"))


#: The same in SQL.
PAGE_ITEMS = r"""items AS (
  SELECT page_id AS id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
         nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')), '') AS title,
         html, CAST(TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 1 HOUR AS DATE)::VARCHAR AS day
  FROM pages)"""


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: id, source, lang, title (first line, 80 characters), text, quality (of labels)."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    title = F.left(F.regexp_extract("text", r"^([^\n]*)", 1), F.lit(80))
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), "source", "lang", title.alias("title"), "text", "n_chars", "quality", "toxic")


DOC_ITEMS = r"""docs AS (
  SELECT d.doc_id AS id, source, lang, left(regexp_extract(text, '^([^\n]*)', 1), 80) AS title, text, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
CANONICAL = r"""CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#:]+') THEN 'https://'
  || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')
  || coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')
  || CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|source|lang)$'))) > 0
     THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|source|lang)$'))), '&') ELSE '' END
  ELSE trim(url) END"""
