"""Queries over web pages: addresses, texts and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, url, values
from ..operators import dedupe, select
from .registry import query
from .tables import CANONICAL, PAGE_ITEMS, page_items, table

HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')"
PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))"""
IDENTITY = rf"""ident AS (
  SELECT *, regexp_replace(lower(regexp_extract({CANONICAL}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^(www\d?|m|amp)\.', '') AS ih,
         regexp_replace(regexp_replace(regexp_replace(lower(url_decode({PATH})), '/amp/?$', '/'), '/+$', ''), '^/(ko|kr|en|fr|de|ja|jp|zh|cn|es|it|pt|nl)([-_][a-z]{{2,4}})?/', '/') AS ip,
         regexp_extract({CANONICAL}, '^[^?#]*(\?[^#]*)', 1) AS iq,
         regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '&#8211;|&#8212;|&ndash;|&mdash;', '-', 'g'), '&#0?38;|&amp;', '&', 'g'), '&#8217;|&#8216;|&rsquo;|&lsquo;', '''', 'g') AS t0,
         {CANONICAL} AS canon
  FROM items),
tails AS (SELECT *, regexp_extract(t0, '(\s+[-–—|]\s+[^-–—|]{{2,40}})$', 1) AS tail,
         regexp_replace(regexp_replace(regexp_extract(ip, '([^/]*)$', 1), '\.(html?|php|aspx?)$', ''), '^(ph|hk|sg|my|id|th|kr|jp|uk|us|au|ca|in)-', '') AS slug FROM ident),
named AS (SELECT *, trim(regexp_replace(regexp_replace(
         CASE WHEN tail <> '' AND (contains(tail, split_part(ih, '.', 1)) OR regexp_matches(tail, 'magazine|news|times|herald|\.com')) THEN left(t0, length(t0) - length(tail)) ELSE t0 END,
         '[''’‘"“”`]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS it FROM tails),
keys AS (
  SELECT id, day, unnest(list_filter(['u:' || canon, CASE WHEN ip <> '' THEN 'p:' || ih || ip || iq END,
         CASE WHEN ip <> '' AND iq = '' AND length(slug) >= 24 AND len(string_split(slug, '-')) >= 4 AND NOT regexp_matches(slug, '^[0-9]+$') THEN 's:' || ih || '/' || slug END,
         CASE WHEN length(it) >= 24 AND len(string_split(it, ' ')) >= 4 THEN 't:' || ih || '|' || it END], lambda x: x IS NOT NULL)) AS k
  FROM named)"""


@query("fn01_canonical_url", f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("canonical"))


@query("fn02_history_url", f"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN {CANONICAL} ELSE '' END AS canonical FROM pages")
def history_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.history_url(F.col("url")).alias("canonical"))


@query("fn03_host", f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(url.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("fn05_identity_keys", f"WITH {PAGE_ITEMS}, {IDENTITY} SELECT id, k FROM keys")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(spark, sf_dir).select("id", F.explode(url.identity_keys(F.col("url"), F.col("title"))).alias("k"))


@query("fn09_strip_html", f"SELECT page_id, length({STRIP.format('html')}) AS chars, md5({STRIP.format('html')}) AS digest FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(
    "fn11_paragraphs",
    rf"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)) AS raw FROM pages),
    t AS (SELECT DISTINCT page_id, {STRIP.format("raw")} AS t FROM p)
    SELECT page_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM t
    WHERE length(t) >= 45 AND NOT regexp_matches(lower(t), 'cookie|subscribe|newsletter|sign up|all rights reserved|privacy policy|advertisement') GROUP BY 1""",
)
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paragraphs of each page (paragraph tags alone, which SQL can express without a back reference)."""
    raw = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), text.strip_html)
    ok = F.filter(raw, lambda t: (F.length(t) >= 45) & ~F.lower(t).rlike("cookie|subscribe|newsletter|sign up|all rights reserved|privacy policy|advertisement"))
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(ok)).alias("t"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


@query("src17_article_text")
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of each page, and whether there is enough of it."""
    t = table(spark, sf_dir, "pages").select("page_id", text.harvest(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"), (F.length("t") >= 400).alias("ok"))


@query(
    "src16_page_extract",
    rf"""WITH {PAGE_ITEMS} SELECT id, title, left({STRIP.format("html")}, 200) AS head,
    CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS links,
    CAST(len(list_distinct(regexp_extract_all(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1))) AS BIGINT) AS images FROM items""",
)
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir)
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long")
    images = F.size(text.distinct_matches(F.col("html"), r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1_000_000)).cast("long")
    return p.select("id", "title", F.left(text.strip_html(F.col("html")), F.lit(200)).alias("head"), links.alias("links"), images.alias("images"))


@query(
    "fn12_meta_content",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']*)["'']', 1), ''), 'unknown') AS lang,
    coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+charset=["'']([^"'']*)["'']', 1), ''), 'unknown') AS charset FROM pages""",
)
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda p: F.coalesce(F.nullif(F.regexp_extract("html", p, 1), F.lit("")), F.lit("unknown"))
    return table(spark, sf_dir, "pages").select("page_id", named(r"""(?i)<html[^>]+lang=["']([^"']*)["']""").alias("lang"), named(r"""(?i)<meta[^>]+charset=["']([^"']*)["']""").alias("charset"))


@query("fn24_slug_title", rf"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(list_filter(string_split({PATH}, '/'), lambda p: p <> '')[-1], ''), '\.[A-Za-z0-9]{{2,5}}$', ''), '[-_]+', ' ', 'g')) AS title FROM pages")
def slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.title_from_slug(F.col("url")).alias("title"))


@query("fn25_hash_ids", f"SELECT page_id, left(sha256({CANONICAL}), 20) AS item_id, left(sha1(url), 12) AS short_id FROM pages")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", values.hash_id(url.canonical(F.col("url"))).alias("item_id"), values.short_id(F.col("url")).alias("short_id"))


@query(
    "fn40_source_level",
    rf"""SELECT page_id, len(list_filter(string_split({PATH}, '/'), lambda p: p <> '')) <= 1 AND NOT contains(url, '?') AS source_level,
    CASE WHEN regexp_matches(lower(url), 'youtube\.com|youtu\.be|vimeo\.com|\.(mp4|webm|mov)($|[?#])') THEN 'video'
         WHEN regexp_matches(lower(url), 'pinterest\.|instagram\.|\.(jpe?g|png|gif|webp)($|[?#])') THEN 'image' ELSE 'web' END AS kind FROM pages""",
)
def source_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.is_source_level(F.col("url")).alias("source_level"), url.kind(F.col("url")).alias("kind"))


@query(
    "flt01_blocked",
    rf"""WITH b(h) AS (VALUES ('example.org'), ('cheap-pills.example.com')), {PAGE_ITEMS}
    SELECT id, url FROM items WHERE NOT EXISTS (SELECT 1 FROM b WHERE host = h OR ends_with(host, '.' || h)) AND NOT regexp_matches(url, '/es/')""",
)
def not_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows off the block list: hosts and their subdomains (as an equi-join on host suffixes) and path patterns."""
    blocked = spark.createDataFrame([("example.org",), ("cheap-pills.example.com",)], "suffix string")
    p = page_items(spark, sf_dir).where(~F.col("url").rlike("/es/"))
    hit = p.select("id", F.explode(url.host_suffixes(F.col("host"))).alias("suffix")).join(blocked, "suffix", "left_semi").select("id").distinct()
    return p.join(hit, "id", "left_anti").select("id", "url")


@query("flt05_usable_url", r"SELECT page_id FROM pages WHERE regexp_matches(lower(url), '^https?://') AND NOT regexp_matches(lower(url), '/(login|signin|signup|auth|oauth|account|checkout)([/?#]|$)|[?&](q|s|query|search)=|/search([/?#]|$)')")
def usable_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(url.is_usable(F.col("url"))).select("page_id")


@query("jn14_host_suffix", rf"""WITH s(suffix, label) AS (VALUES ('example.com', 'com'), ('example.net', 'net')), {PAGE_ITEMS}
    SELECT label, count(*) AS n FROM items JOIN s ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY 1""")
def host_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("example.com", "com"), ("example.net", "net")], "suffix string, label string")
    p = page_items(spark, sf_dir).select("id", F.explode(url.host_suffixes(F.col("host"))).alias("suffix"))
    return p.join(known, "suffix").groupBy("label").agg(F.countDistinct("id").alias("n"))


@query("jn01_archive_anti_join", f"WITH p AS (SELECT page_id, {CANONICAL} AS c FROM pages) SELECT page_id, c AS canonical FROM p WHERE c NOT IN (SELECT c FROM p WHERE page_id % 3 = 0)")
def archive_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose canonical address the archive doesn't hold."""
    p = table(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("canonical"))
    archive = p.where("page_id % 3 = 0").select("canonical")
    return p.join(archive, "canonical", "left_anti").select("page_id", "canonical")


@query("fn05_reference_keys", rf"""WITH {PAGE_ITEMS.replace("items AS", "pages_ AS", 1)}, items AS (SELECT id, day, 'https://www.' || host || '/en/' || CASE id % 3 WHEN 0 THEN 'work/' WHEN 1 THEN 'caf%C3%A9/' ELSE '' END || regexp_replace(lower(title), '[^a-z]+', '-', 'g') || CASE WHEN id % 2 = 0 THEN '.html' ELSE '' END || CASE WHEN id % 5 = 0 THEN '?id=' || id ELSE '?utm_source=x' END AS url,
    title || CASE id % 3 WHEN 0 THEN ' | Some Magazine' WHEN 1 THEN ' &ndash; ' || split_part(host, '.', 1) ELSE ' - by another' END AS title, CASE WHEN id % 4 = 0 THEN 'https://news.example.org/' || (id % 9) || '/' END AS second FROM pages_ WHERE title IS NOT NULL AND host IS NOT NULL),
    {IDENTITY} SELECT id, k FROM keys UNION ALL SELECT id, 'u:https://news.example.org/' || (id % 9) FROM items WHERE second IS NOT NULL""")
def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of keys: encoded paths, slugs, titles with and without a site's tail, second addresses."""
    i, n = page_items(spark, sf_dir).where("title IS NOT NULL AND host IS NOT NULL"), F.col("id") % 3
    folder = F.when(n == 0, "work/").when(n == 1, "caf%C3%A9/").otherwise("")
    asked = F.when(F.col("id") % 5 == 0, F.concat(F.lit("?id="), F.col("id").cast("string"))).otherwise("?utm_source=x")
    u = F.concat(F.lit("https://www."), "host", F.lit("/en/"), folder, F.regexp_replace(F.lower("title"), "[^a-z]+", "-"), F.when(F.col("id") % 2 == 0, ".html").otherwise(""), asked)
    tail = F.when(n == 0, " | Some Magazine").when(n == 1, F.concat(F.lit(" &ndash; "), F.element_at(F.split("host", r"\."), 1))).otherwise(" - by another")
    second = F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://news.example.org/"), (F.col("id") % 9).cast("string"), F.lit("/")))
    return i.select("id", F.explode(url.identity_keys(u, F.concat("title", tail), second)).alias("k"))


@query("fn04_absolute_url", r"""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)(?:href|src)=["'']([^"'']*)', 1))) AS v FROM pages),
    b AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM l WHERE starts_with(v, '/') AND NOT contains(v, '..') AND regexp_matches(url, '^[A-Za-z]+://[^/?#:]+')),
    c AS (SELECT *, CASE WHEN folder = '' THEN '/' ELSE folder END AS f FROM b)
    SELECT page_id, v, scheme || '://' || host || v AS rooted, scheme || '://' || host || '/a/c' || v AS dotted, scheme || '://' || host || regexp_replace(f, '[^/]+/$', '') || substr(v, 2) AS above, 'https://x.org' || v AS whole FROM c""")
def absolute_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-04: each page's links as they stand, with dot segments, from the folder above, and without a scheme."""
    v = F.col("v")
    p = table(spark, sf_dir, "pages").where(url.is_url(F.col("url"))).select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)=["']([^"']*)"""), F.lit(1)))).alias("v"))
    p = p.where(v.startswith("/") & ~v.contains(".."))
    to = lambda x: url.absolute(x, F.col("url"))
    above, whole = F.concat(F.lit("./../"), F.substring(v, F.lit(2), F.length(v))), F.when(F.col("page_id") % 2 == 0, "https://x.org").otherwise("HTTPS://X.org")
    return p.select("page_id", "v", to(v).alias("rooted"), to(F.concat(F.lit("/a/b/%2E./c"), v)).alias("dotted"), to(above).alias("above"), to(F.concat(whole, v)).alias("whole"))


@query("jn03_identity_anti_join", f"WITH {PAGE_ITEMS}, {IDENTITY} SELECT id FROM items WHERE id % 3 <> 0 AND id NOT IN (SELECT a.id FROM keys a JOIN keys b ON a.k = b.k WHERE b.id % 3 = 0)")
def identity_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that share no identity key with the archive."""
    p = page_items(spark, sf_dir).select("id", url.identity_keys(F.col("url"), F.col("title")).alias("keys"))
    return dedupe.any_key_anti(p.where("id % 3 <> 0"), p.where("id % 3 = 0"), "keys", "id").select("id")


@query("mrg05_cross_archive_dedupe", f"""WITH {PAGE_ITEMS}, {IDENTITY},
    o AS (SELECT id, day, k, first_value(id) OVER (PARTITION BY k ORDER BY day, id) AS owner FROM keys)
    SELECT i.id, EXISTS (SELECT 1 FROM o WHERE o.id = i.id AND o.owner <> i.id) AS dropped FROM items i""")
def cross_archive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share an identity key with an earlier row are dropped."""
    p = page_items(spark, sf_dir).select("id", "day", url.identity_keys(F.col("url"), F.col("title")).alias("keys"))
    return dedupe.shares_earlier_key(p, "keys", ["day"], "id").select("id", "dropped")


@query("agg09_last_value_first_position", f"WITH {PAGE_ITEMS} SELECT host, min(id) AS pos, arg_max(url, id) AS url FROM items GROUP BY 1")
def last_value_first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir).select("host", F.col("id").alias("pos"), "url")
    return dedupe.first_position_last_value(p, "host", "pos")


@query("agg10_first_value", f"WITH {PAGE_ITEMS} SELECT host, arg_min(url, id) AS url FROM items GROUP BY 1")
def first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir).select("host", "id", "url")
    return dedupe.first_value(p, "host", "id").select("host", "url")


@query("mrg02_cap_per_day", f"WITH {PAGE_ITEMS} SELECT id, day FROM items QUALIFY row_number() OVER (PARTITION BY day ORDER BY id) <= 15")
def cap_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.cap_per_group(page_items(spark, sf_dir).select("id", "day"), "day", ["id"], 15)


@query("mrg04_replace_days", f"""WITH {PAGE_ITEMS}, inc AS (SELECT id + 1000 AS id, day FROM items WHERE id % 40 = 0)
    SELECT id, day FROM items WHERE day NOT IN (SELECT day FROM inc) UNION ALL SELECT id, day FROM inc""")
def replace_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir).select("id", "day")
    return dedupe.replace_days(p, p.where("id % 40 = 0").select((F.col("id") + 1000).alias("id"), "day")).select("id", "day")


@query("win05_round_robin", f"""WITH {PAGE_ITEMS}, r AS (SELECT id, host, row_number() OVER (PARTITION BY host ORDER BY id) AS turn, min(id) OVER (PARTITION BY host) AS start FROM items)
    SELECT id, host, start FROM r ORDER BY turn, start LIMIT 60""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.round_robin(page_items(spark, sf_dir).select("id", "host"), "host", "id", 60)


@query("win06_interleave", f"""WITH {PAGE_ITEMS}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM items WHERE host LIKE '%.com'),
    b AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM items WHERE host NOT LIKE '%.com'),
    u AS (SELECT id, (n - 1) // 2 AS turn, 0 AS l, n FROM a UNION ALL SELECT id, n - 1, 1, n FROM b)
    SELECT id FROM u ORDER BY turn, l, n LIMIT 45""")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir).select("id", "host")
    return select.interleave(p.where("host LIKE '%.com'"), p.where("host NOT LIKE '%.com'"), "id", 45).select("id")


@query("src26_layered_union", f"""WITH p AS (SELECT page_id, {CANONICAL} AS c FROM pages), core AS (SELECT * FROM p WHERE page_id % 2 = 0)
    SELECT page_id, 'core' AS layer FROM core UNION ALL SELECT page_id, 'history' FROM p WHERE page_id % 2 = 1 AND c NOT IN (SELECT c FROM core)""")
def layered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core rows and those history rows whose address core doesn't have."""
    p = table(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("c"))
    core, history = p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1")
    history = history.join(core.select("c"), "c", "left_anti")
    return core.select("page_id", F.lit("core").alias("layer")).unionByName(history.select("page_id", F.lit("history").alias("layer")))


@query("sel11_crawl_schedule", f"""WITH {PAGE_ITEMS}, c AS (SELECT host, max(CASE WHEN id % 5 <> 0 THEN day END) AS checked, count(*) AS n FROM items GROUP BY 1)
    SELECT host, coalesce(checked, '') AS checked, n FROM c ORDER BY c.checked NULLS FIRST, n DESC, host LIMIT 40""")
def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = page_items(spark, sf_dir).groupBy("host").agg(F.max(F.when(F.col("id") % 5 != 0, F.col("day"))).alias("checked"), F.count("*").alias("n"))
    return c.orderBy(F.asc_nulls_first("checked"), F.desc("n"), "host").limit(40).withColumn("checked", F.coalesce("checked", F.lit("")))


@query("win08_unique_texts", f"""WITH {PAGE_ITEMS}, t AS (SELECT id, host AS t, row_number() OVER (PARTITION BY host ORDER BY day, id) AS n FROM items)
    SELECT id, CASE WHEN n = 1 THEN t ELSE t || ' (' || id || ')' END AS t FROM t""")
def unique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir).select("id", "day", F.col("host").alias("t"), F.col("id").cast("string").alias("extra"))
    return dedupe.unique_texts(p, "t", ["day", "id"], ["extra"]).select("id", "t")


@query("sel01_novel_items")
def novel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy novelty selection over pages, two a host, after the anti-join with an archive of every third page."""
    from .tables import stop_words

    p = page_items(spark, sf_dir).withColumn("keys", url.identity_keys(F.col("url"), F.col("title")))
    fresh = dedupe.any_key_anti(p.where("id % 3 <> 0"), p.where("id % 3 = 0"), "keys", "id")
    rows = fresh.select(F.regexp_extract("host", r"\.([a-z]+)$", 1).alias("tab"), F.col("id").alias("pos"), "id", F.col("host").alias("source"), text.title_key(F.col("title")).alias("title_key"), "keys", text.title_tokens(F.col("title"), stop_words()).alias("words"))
    return select.select_novel(rows, 15, 2, loose_per_source=4)


@query("sel02_balanced_items")
def balanced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir)
    lane = F.regexp_extract("host", r"\.([a-z]+)$", 1)
    return select.select_balanced(p.select(lane.alias("lane"), F.col("id").alias("pos"), "id", F.col("host").alias("source")), ["com", "net", "org"], 30, 2)
