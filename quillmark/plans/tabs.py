"""Queries over the curated tabs: scores, rankings, social candidates, exports and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url
from ..operators import publish, select, tabs
from ..operators.rounds import shared_folder
from ..sources import site, versions
from .registry import query
from .tables import CANONICAL, DOC_ITEMS, PAGE_ITEMS, doc_items, page_items, table

TERMS = tabs.UpdateTerms(("thei", "wher"), ("ation", "ment"), ("erst", "enti"), ("the", "der", "les"), ("ouer", "and"), ("licensed under", "[*$%&#]{3}"), ("apache license", r"\bmit\b", r"src1[0-2]\."))
_AGE = "(id % 300)"


def _hits(terms, x: str = "w") -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{t}') AS INT)" for t in terms) + ")"


def _marks(patterns, x: str = "w") -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, '{p}') AS INT)" for p in patterns) + ")"


#: Documents as updates: an image for every third, an age in days, every fifth from a bookmark; w holds title, text and address.
#: By the survey: reasons a1 to a3 rule out, b1 to b3 are flags; eligible without a hard reason and from a score of 35.
_UPDATES = DOC_ITEMS + f""", u AS (SELECT id, source, lang, title, text, lower(trim(title) || ' ' || trim(text) || ' https://' || source || '.example.com/doc/' || id) AS w, id % 3 = 0 AS image, {_AGE} AS age, id % 5 = 0 AS marked FROM docs),
h AS (SELECT *, length(trim(text)) AS n, {_hits(TERMS.perspective)} AS p, {_hits(TERMS.transferable)} AS t, {_hits(TERMS.evidence)} AS e, {_hits(TERMS.artifact)} AS a, {_hits(TERMS.craft)} AS c, {_marks(TERMS.noise)} AS noise, {_marks(TERMS.announcements)} AS news FROM u),
s AS (SELECT *, least(30, 7 * p + 4 * c + CASE WHEN p > 0 OR c > 0 THEN 2 ELSE 0 END) + least(25, 4 * t + CASE WHEN t > 0 THEN 5 ELSE 0 END)
  + least(20, CASE WHEN n >= 90 THEN 8 WHEN n >= 60 THEN 4 ELSE 0 END + 4 * e + CASE WHEN image THEN 4 ELSE 0 END)
  + CASE WHEN age <= 14 THEN 15 WHEN age <= 45 THEN 11 WHEN age <= 180 THEN 6 ELSE 2 END + CASE WHEN marked THEN 8 ELSE 10 END AS score,
  list_filter([CASE WHEN noise > 0 THEN 'commercial-noise' END, CASE WHEN news > 0 THEN 'announcement-news' END, CASE WHEN n < 60 AND e = 0 THEN 'insufficient-evidence' END], lambda x: x IS NOT NULL) AS hard,
  list_filter([CASE WHEN t = 0 THEN 'not-transferable' END, CASE WHEN a = 0 THEN 'outside-creative-practice' END,
    CASE WHEN p = 0 AND c < 2 AND NOT (n >= 90 AND c >= 1 AND e >= 1 AND t >= 2) THEN 'no-creative-point-of-view' END], lambda x: x IS NOT NULL) AS soft FROM h)"""


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_items(spark, sf_dir).select("id", "source", "lang", "title", "text", "quality", tabs.update_words(F.col("title"), F.col("text"), F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), F.col("id").cast("string"))).alias("w"))
    return d.withColumn("image", F.col("id") % 3 == 0).withColumn("age", F.col("id") % 300).withColumn("marked", F.col("id") % 5 == 0)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _updates(spark, sf_dir).withColumn("u", tabs.update_score(c("w"), c("text"), c("image"), c("age"), c("marked"), TERMS))


@query("cls01_update_score", f"WITH {_UPDATES} SELECT id, score, len(hard) = 0 AND score >= 35 AS eligible, array_to_string(hard || soft, ',') AS rejected, array_to_string(soft, ',') AS soft FROM s")
def update_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "u.score", "u.eligible", F.array_join("u.rejected", ",").alias("rejected"), F.array_join("u.soft", ",").alias("soft"))


@query("sel07_update_ranking", f"WITH {_UPDATES} SELECT id, score FROM s WHERE len(hard) = 0 AND score >= 35 ORDER BY score DESC, age, id LIMIT 40")
def update_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("u.eligible").select("id", "u.score", "age").orderBy(F.desc("score"), "age", "id").limit(40).select("id", "score")


@query("cls02_pillar", f"WITH {DOC_ITEMS} SELECT id, CASE WHEN lang = 'fr' THEN 'visual-language' WHEN lang = 'de' THEN 'production-method' WHEN regexp_matches(lower(title || ' ' || text), 'idea|concept|approach') THEN 'idea-concept' ELSE 'culture-context' END AS pillar FROM docs")
def pillar(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = tabs.first_label(F.lower(F.concat_ws(" ", "title", "text")), [("idea-concept", "idea|concept|approach")], "culture-context")
    return doc_items(spark, sf_dir).select("id", F.when(F.col("lang") == "fr", "visual-language").when(F.col("lang") == "de", "production-method").otherwise(said).alias("pillar"))


_KOREAN = f"""{_UPDATES}, k AS (SELECT id, source, age, 8 * {_hits(("ation", "ment"))} AS q, {_hits(("the", "les"))} + CAST(regexp_matches(title, '[가-힣]{{2,}}') AS INT) AS k, {_hits(("ouer",))} AS tr, {_marks(TERMS.noise)} AS bad, marked, n,
  CASE WHEN age <= 14 THEN 16 WHEN age <= 45 THEN 10 WHEN age <= 180 THEN 4 ELSE 0 END AS rec FROM h),
ks AS (SELECT *, q + 10 * k + 14 * tr + CASE WHEN marked THEN 14 ELSE 0 END + rec + CASE WHEN n >= 80 THEN 6 ELSE 0 END - 24 * bad AS score, bad = 0 AND k > 0 AND (q > 0 OR tr > 0 OR marked OR rec >= 10) AS passes FROM k)"""


def _korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _updates(spark, sf_dir).withColumn("k", tabs.korean_score(c("w"), c("title"), c("text"), c("age"), c("marked"), ("ation", "ment"), ("the", "les"), ("ouer",), TERMS.noise))


@query("cls03_korean_score", f"WITH {_KOREAN} SELECT id, score, passes FROM ks")
def korean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _korean(spark, sf_dir).select("id", "k.score", "k.passes")


@query("sel08_korean_ranking", f"WITH {_KOREAN}, t AS (SELECT id, source, score, age FROM ks WHERE passes AND score >= 20 ORDER BY score DESC, age, id LIMIT 200), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, age, id) AS pos FROM t), r AS (SELECT id, row_number() OVER (PARTITION BY source ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY source) AS start FROM o) SELECT id FROM r ORDER BY turn, start LIMIT 30")
def korean_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 200 rows dealt round-robin over their sources (the windows run over those rows only)."""
    best = _korean(spark, sf_dir).where("k.passes AND k.score >= 20").select("id", "source", "k.score", "age").orderBy(F.desc("score"), "age", "id").limit(200)
    best = best.select("id", "source", F.row_number().over(Window.orderBy(F.desc("score"), "age", "id")).alias("pos"))
    return select.round_robin(best, "source", "pos", 30).select("id")


@query("cls04_cinema_score", f"WITH {_UPDATES} SELECT id, 8 * {_hits(('the', 'and', 'ment'))} - 24 * noise + CASE WHEN image THEN 8 ELSE 0 END AS score FROM h")
def cinema_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updates(spark, sf_dir).select("id", tabs.cinema_score(F.col("w"), F.col("image"), ("the", "and", "ment"), TERMS.noise).alias("score"))


@query("sel09_cinema_ranking", f"WITH {_UPDATES}, c AS (SELECT id, age, 8 * {_hits(('the', 'and', 'ment'))} - 24 * noise + CASE WHEN image THEN 8 ELSE 0 END AS score FROM h) SELECT id, score FROM c WHERE score >= 8 ORDER BY score DESC, age, id LIMIT 24")
def cinema_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _updates(spark, sf_dir).select("id", "age", tabs.cinema_score(F.col("w"), F.col("image"), ("the", "and", "ment"), TERMS.noise).alias("score"))
    return s.where("score >= 8").orderBy(F.desc("score"), "age", "id").limit(24).select("id", "score")


_SOCIAL = """c AS (SELECT conv_id, turn, role, text, role = 'user' AS external, least(60, turn * 7 + conv_id % 11) AS engagement, conv_id % 4 <> 0 AS novel FROM conversations),
x AS (SELECT *, CASE WHEN novel THEN 40 ELSE 0 END + least(30, engagement) + CASE WHEN external THEN 25 ELSE -15 END + CASE WHEN regexp_matches(lower(text), 'thei|wher') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'ation|ment') THEN 10 ELSE 0 END AS score,
  novel AND (external OR engagement >= 8) AND regexp_matches(lower(text), 'the|der|les') AS candidate FROM c)"""


def _social(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("external", F.col("role") == "user").withColumn("engagement", F.least(F.lit(60), F.col("turn") * 7 + F.col("conv_id") % 11)).withColumn("novel", F.col("conv_id") % 4 != 0)
    words = F.lower("text")
    score = tabs.social_score(words, F.col("novel"), F.col("engagement"), F.col("external"), "thei|wher", "ation|ment")
    return c.withColumn("score", score).withColumn("candidate", F.col("novel") & (F.col("external") | (F.col("engagement") >= 8)) & words.rlike("the|der|les"))


@query("cls21_social_score", f"WITH {_SOCIAL} SELECT conv_id, turn, score FROM x")
def social_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _social(spark, sf_dir).select("conv_id", "turn", "score")


@query("flt10_social_relevance", f"WITH {_SOCIAL} SELECT conv_id, turn FROM x WHERE candidate")
def social_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _social(spark, sf_dir).where("candidate").select("conv_id", "turn")


@query("cls22_route_recommendation", f"WITH {_SOCIAL}, g AS (SELECT conv_id % 23 AS route, count(*) FILTER (WHERE candidate) AS novel, coalesce(max(score) FILTER (WHERE candidate), 0) AS top, bool_or(conv_id % 23 = 7) AS skipped FROM x GROUP BY 1) SELECT route, novel, top, CASE WHEN skipped THEN 'needs_credentials' WHEN top >= 70 OR novel >= 10 THEN 'watch' WHEN novel > 0 THEN 'sample' ELSE 'reject' END AS recommendation FROM g")
def route_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _social(spark, sf_dir).withColumn("route", F.col("conv_id") % 23).withColumn("skipped", F.col("route") == 7)
    return tabs.route_recommendations(s, "route")


_STATUS = f"""{DOC_ITEMS}, g AS (SELECT source, count(*) AS seen, count(*) FILTER (WHERE quality = 1) AS kept, avg(n_chars % 10) AS sharp, max(DATE '2024-01-01' + CAST(id % 90 AS INT)) AS last FROM docs WHERE quality IS NOT NULL GROUP BY 1),
st AS (SELECT source, seen, kept, CAST(last AS VARCHAR) AS last, CASE WHEN seen >= 8 AND kept / CAST(seen AS DOUBLE) < 0.2 AND sharp < 4.5 AND DATE '2024-04-05' - last < 30 THEN 'demoted' WHEN seen >= 6 AND kept / CAST(seen AS DOUBLE) >= 0.6 THEN 'trusted' ELSE 'watch' END AS status FROM g)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_items(spark, sf_dir).where("quality IS NOT NULL")
    r = d.select("source", (F.col("quality") == 1).alias("keep"), (F.col("n_chars") % 10).alias("sharpness"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("day"))
    return tabs.source_status(r, "source", F.lit("2024-04-05").cast("date"))


@query("cls23_source_status", f"WITH {_STATUS} SELECT * FROM st")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-23 and STR-07: the status of each source; demotions end after thirty unseen days."""
    return _status(spark, sf_dir).withColumn("last", F.col("last").cast("string"))


@query("job06_without_demoted", f"WITH {_STATUS} SELECT id FROM docs WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.status = 'demoted' AND lower(st.source) = lower(docs.source))")
def without_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabs.without_demoted(doc_items(spark, sf_dir).select("id", "source"), _status(spark, sf_dir), "source").select("id")


@query("cls25_incident_class", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licensed') THEN 'license' WHEN regexp_matches(text, '[*$%&#]{3}') THEN 'symbols' WHEN regexp_matches(text, '@') THEN 'contact' ELSE 'unknown' END AS incident FROM documents")
def incident_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("license", "(?i)licensed"), ("symbols", "[*$%&#]{3}"), ("contact", "@")]
    return table(spark, sf_dir, "documents").select("doc_id", tabs.first_label(F.col("text"), rules, "unknown").alias("incident"))


@query("fn34_legacy_category", "SELECT doc_id, CASE WHEN regexp_matches(source, '[13579]$') THEN 'film' WHEN regexp_matches(source, '^src1') THEN 'brand' ELSE 'culture' END AS category FROM documents")
def legacy_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tabs.first_label(F.col("source"), [("film", "[13579]$"), ("brand", "^src1")], "culture").alias("category"))


@query("fn35_focus_labels", "SELECT doc_id, array_to_string(list_distinct(list_filter([CASE WHEN regexp_matches(text, 'tion') THEN 'a' END], lambda x: x IS NOT NULL)) || list_filter([CASE WHEN regexp_matches(text, 'ment') THEN 'b' END, CASE WHEN regexp_matches(text, 'ung') THEN 'c' END], lambda x: x IS NOT NULL), ', ') AS focus FROM documents")
def focus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tabs.labels(F.col("text"), [("a", "tion"), ("b", "ment"), ("c", "ung")]).alias("focus"))


@query("fn38_date_label", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y. %-m. %-d.') AS label FROM events")
def date_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day in Korea Standard Time as Korean readers write it."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul"), "yyyy. M. d.").alias("label"))


@query("fn30_clean_summary", r"""WITH s AS (SELECT doc_id, source, regexp_extract(text, '^([^\n]*)', 1) AS title, trim(regexp_replace(replace(replace(replace(replace(replace(CASE doc_id % 3 WHEN 0 THEN text || ' ' || source WHEN 1 THEN regexp_extract(text, '^([^\n]*)', 1) ELSE text END, '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS s FROM documents),
    c AS (SELECT doc_id, title, CASE WHEN ends_with(lower(s), ' ' || lower(source)) THEN trim(left(s, length(s) - length(source) - 1)) ELSE s END AS s FROM s)
    SELECT doc_id, md5(CASE WHEN lower(s) = lower(title) OR lower(s) = lower(trim(regexp_replace(title, '\s+-\s+[^-]+$', ''))) THEN '' ELSE s END) AS digest FROM c""")
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    summary = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "text", "source")).when(F.col("doc_id") % 3 == 1, title).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tabs.clean_summary(summary, title, F.col("source")).cast("binary")).alias("digest"))


@query("flt02_editorial_noise", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), 'licensed under|[*$%&#]{3}|!!')")
def editorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(tabs.hit_count(F.lower("text"), ("licensed under", "[*$%&#]{3}", "!!")) == 0).select("doc_id")


@query("flt03_exclusion_anti_join", f"WITH p AS (SELECT page_id, {CANONICAL} AS c FROM pages), x AS (SELECT c FROM p WHERE page_id % 5 = 0 UNION SELECT c FROM p WHERE page_id % 7 = 0) SELECT page_id FROM p WHERE c NOT IN (SELECT c FROM x)")
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose address is neither an archived row's address nor its second one."""
    p = table(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("c"))
    used = p.where("page_id % 5 = 0").select("c").union(p.where("page_id % 7 = 0").select("c")).distinct()
    return p.join(used, "c", "left_anti").select("page_id")


@query("flt07_useful_media", r"""SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), lambda x: NOT regexp_matches(lower(x), 'logo|icon|sprite|avatar|pixel|\.svg'))) AS BIGINT) AS useful FROM pages""")
def useful_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(found, lambda x: ~F.lower(x).rlike(r"logo|icon|sprite|avatar|pixel|\.svg"))).cast("long").alias("useful"))


@query("flt08_hangul", "SELECT doc_id, regexp_matches(text, '[가-힣]') AS korean FROM documents WHERE text IS NOT NULL")
def hangul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").rlike("[가-힣]").alias("korean"))


@query("flt13_deep_backlog", f"WITH {PAGE_ITEMS} SELECT id, CASE WHEN day >= '2024-01-20' THEN 'daily' ELSE 'backlog' END AS queue FROM items WHERE coalesce(CASE WHEN id % 4 <> 0 THEN 'v' || (id % 3) END, '') <> 'v2'")
def deep_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read with another version or not at all, by queue."""
    read = F.when(F.col("id") % 4 != 0, F.concat(F.lit("v"), (F.col("id") % 3).cast("string")))
    return page_items(spark, sf_dir).where(F.coalesce(read, F.lit("")) != "v2").select("id", F.when(F.col("day") >= "2024-01-20", "daily").otherwise("backlog").alias("queue"))


@query("flt14_signal_window", f"WITH {PAGE_ITEMS} SELECT id FROM items WHERE id % 10 >= 5 AND CAST(day AS DATE) > (SELECT max(CAST(day AS DATE)) FROM items) - 14 ORDER BY id % 10 DESC, day DESC, id LIMIT 180")
def signal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharp rows of the last fourteen days, the sharpest 180."""
    p = page_items(spark, sf_dir).select("id", "day", (F.col("id") % 10).alias("sharp"))
    last = F.broadcast(p.agg(F.max("day").alias("last")))
    return p.join(last).where((F.col("sharp") >= 5) & (F.col("day").cast("date") > F.date_sub(F.col("last").cast("date"), 14))).orderBy(F.desc("sharp"), F.desc("day"), "id").limit(180).select("id")


@query("flt15_new_since", f"WITH {PAGE_ITEMS} SELECT host, count(*) FILTER (WHERE day > '2024-01-15') AS fresh FROM items GROUP BY 1")
def new_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(spark, sf_dir).groupBy("host").agg(F.count_if(F.col("day") > "2024-01-15").alias("fresh"))


_REPORTS = f"""{PAGE_ITEMS}, d AS (SELECT id % 3 AS tab, day, count(*) AS n, count(*) FILTER (WHERE id % 4 <> 0) AS read, count(*) FILTER (WHERE id % 4 = 1) AS kept FROM items GROUP BY 1, 2),
r AS (SELECT tab, CAST(sum(n) AS BIGINT) AS items, CAST(sum(read) AS BIGINT) AS read, CAST(sum(kept) AS BIGINT) AS kept, count(*) AS days, max(day) AS latest, max(n) AS busiest FROM d GROUP BY 1)"""


def _tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(spark, sf_dir).select("id", (F.col("id") % 3).alias("tab"), "day", F.when(F.col("id") % 4 != 0, F.col("id") % 4 == 1).alias("keep"))


@query("job02_tab_report", f"WITH {_REPORTS} SELECT * FROM r")
def tab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.tab_report(_tabs(spark, sf_dir), "tab", "day", F.col("keep"))


@query("dq02_publish_guard", f"""WITH {_REPORTS}, b AS (SELECT tab, items + tab * 20 AS items, read + 1 AS read, CASE WHEN tab = 2 THEN '2025-01-01' ELSE latest END AS latest FROM r UNION ALL SELECT 9, 5, 5, '2024-01-01')
    SELECT coalesce(r.tab, b.tab) AS tab, array_to_string(list_filter([CASE WHEN r.tab IS NULL THEN 'tab vanished' END, CASE WHEN r.items < b.items * 0.97 THEN 'items dropped' END, CASE WHEN r.read < b.read * 0.97 THEN 'read dropped' END, CASE WHEN r.latest < b.latest THEN 'latest went back' END, CASE WHEN r.busiest > 15 THEN 'day too full' END, CASE WHEN r.items < 100 THEN 'too few items' END], lambda x: x IS NOT NULL), ',') AS failures FROM r FULL JOIN b ON r.tab = b.tab""")
def publish_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each tab against an earlier state, which had a tab that is gone."""
    now = publish.tab_report(_tabs(spark, sf_dir), "tab", "day", F.col("keep"), "id")
    before = now.select("tab", (F.col("items") + F.col("tab") * 20).alias("items"), (F.col("read") + 1).alias("read"), F.when(F.col("tab") == 2, "2025-01-01").otherwise(F.col("latest")).alias("latest"))
    gone = spark.range(1).select(F.lit(9).cast("long").alias("tab"), F.lit(5).cast("long").alias("items"), F.lit(5).cast("long").alias("read"), F.lit("2024-01-01").alias("latest"))
    return publish.publish_guard(now, before.unionByName(gone), "tab", least=100).select("tab", F.array_join("failures", ",").alias("failures"))


@query("dq09_freshness", f"WITH {PAGE_ITEMS}, t(tab) AS (VALUES (0), (1), (2), (3)), n AS (SELECT id % 3 AS tab, count(*) AS n FROM items WHERE day = '2024-01-05' AND id % 3 <> 1 GROUP BY 1) SELECT t.tab, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'error' WHEN n < 15 THEN 'warning' ELSE 'ok' END AS level FROM t LEFT JOIN n ON n.tab = t.tab")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-09 and STR-11: tabs without rows of today are errors, short ones warnings."""
    items = _tabs(spark, sf_dir).where("tab <> 1")
    return publish.freshness(items, spark.range(4).select(F.col("id").alias("tab")), "tab", "day", F.lit("2024-01-05"))


@query("dq07_public_contract", f"WITH {PAGE_ITEMS}, d AS (SELECT id % 3 AS tab, max(day) AS top FROM items GROUP BY 1) SELECT d.tab, top, count(*) AS n, count(*) - count(DISTINCT url) AS copies FROM items i JOIN d ON i.id % 3 = d.tab AND i.day = d.top GROUP BY 1, 2")
def public_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tab: the top day, its rows, and repeated addresses among them."""
    p = page_items(spark, sf_dir).select((F.col("id") % 3).alias("tab"), "day", "url")
    by_day = p.groupBy("tab", "day").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))
    return by_day.groupBy("tab").agg(F.max_by(F.struct("day", "n", (F.col("n") - F.col("urls")).alias("copies")), "day").alias("x")).select("tab", F.col("x.day").alias("top"), "x.n", "x.copies")


@query("dq03_new_defects", "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(text, '***') THEN 'symbols' END], lambda x: x IS NOT NULL), ',') AS defects FROM documents WHERE (length(text) < 100 OR contains(text, '***')) AND doc_id % 2 = 1")
def new_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import defects

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = publish.new_defects(d, d.where("doc_id % 2 = 0"), "doc_id", defects([("short", F.length("text") < 100), ("symbols", F.col("text").contains("***"))]))
    return found.select("doc_id", F.array_join("defects", ",").alias("defects"))


@query("snk01_archive_write")
def archive_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of three tabs after a write: merged by address and title, fifteen rows a day, titles made unique (a loop over rows; see the tests)."""
    p = page_items(spark, sf_dir).select("id", "day", F.col("id").alias("pos"), "url", "title", (F.col("id") % 3).cast("string").alias("tab"))
    return publish.archived(p.where("id % 2 = 0"), p.where("id % 5 < 2"), unique="title", extras=("id",)).select("id", "tab", "day", "title")


@query("snk04_history_upsert", f"""WITH p AS (SELECT {CANONICAL} AS c, page_id, CASE WHEN page_id % 4 <> 0 THEN page_id END AS note FROM pages),
    o AS (SELECT c, arg_max(note, page_id) FILTER (WHERE note IS NOT NULL) AS note, max(page_id) AS page_id FROM p WHERE page_id % 2 = 0 GROUP BY 1), n AS (SELECT c, arg_max(note, page_id) FILTER (WHERE note IS NOT NULL) AS note, max(page_id) AS page_id FROM p WHERE page_id % 3 = 0 GROUP BY 1)
    SELECT coalesce(n.c, o.c) AS c, coalesce(n.note, o.note, -1) AS note, coalesce(n.page_id, o.page_id) AS page_id FROM o FULL JOIN n ON o.c = n.c""")
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and found rows, both with repeated addresses; the last note that isn't null counts."""
    p = table(spark, sf_dir, "pages").select(url.canonical(F.col("url")).alias("c"), "page_id", F.when(F.col("page_id") % 4 != 0, F.col("page_id")).alias("note"))
    return publish.upserted_history(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0"), "c", "page_id").na.fill({"note": -1}).select("c", "note", "page_id")


@query("fn33_compact_export", f"WITH {DOC_ITEMS} SELECT id, id % 3 AS tab, CASE WHEN quality IS NOT NULL THEN lower(title) ELSE title END AS t, title AS ot, CASE WHEN id % 4 = 0 THEN '' ELSE 'img' || id END AS img, source AS s, coalesce(quality, -1) AS k, id % 700 > 365 AS old FROM docs")
def compact_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the site reads them: read titles before original ones, no related images, and whether a row was old when archived."""
    d = doc_items(spark, sf_dir)
    title, image = F.when(F.col("quality").isNotNull(), F.lower("title")), F.when(F.col("id") % 4 != 0, F.concat(F.lit("img"), F.col("id").cast("string")))
    return d.select("id", (F.col("id") % 3).alias("tab"), F.coalesce(title, "title").alias("t"), F.col("title").alias("ot"), F.coalesce(image, F.lit("")).alias("img"), F.col("source").alias("s"), F.coalesce("quality", F.lit(-1)).alias("k"), (F.col("id") % 700 > 365).alias("old"))


@query("snk07_site_export", f"""WITH {DOC_ITEMS}, i AS (SELECT id, coalesce(lang, 'none') AS tab, source, CAST(DATE '2024-01-01' + CAST(id % 50 AS INT) AS VARCHAR) AS day, quality = 1 AS keep, CASE WHEN quality IS NOT NULL THEN 1 + id % 10 END AS sh FROM docs),
    d AS (SELECT tab, day, count(*) AS n, row_number() OVER (PARTITION BY tab ORDER BY day DESC) AS r FROM i GROUP BY 1, 2),
    t AS (SELECT i.tab, count(*) AS item_count, count(DISTINCT i.day) AS date_count, max(i.day) AS latest, count(sh) AS read_count, count(*) FILTER (WHERE sh IS NOT NULL AND keep) AS keep_count, count(*) FILTER (WHERE r <= 21) AS recent FROM i JOIN d ON d.tab = i.tab AND d.day = i.day GROUP BY 1),
    l AS (SELECT DISTINCT day FROM i ORDER BY day DESC LIMIT 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sh DESC, day DESC, id) AS c FROM i WHERE keep AND day IN (SELECT day FROM l)),
    p AS (SELECT tab, sh, day, id FROM k WHERE c <= 2 ORDER BY sh DESC, day DESC, id LIMIT 12)
    SELECT t.*, coalesce(n, 0) AS picks FROM t LEFT JOIN (SELECT tab, count(*) AS n FROM p GROUP BY 1) q ON q.tab = t.tab""")
def site_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: the site's tables, published as one commit and read back by their manifest: totals, recent rows and picks of each tab."""
    root, none = f"{shared_folder(spark)}/site-{uuid.uuid4().hex}", F.lit(None).cast("string")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 50 * 86_400)
    read = F.col("quality").isNotNull()
    items = doc_items(spark, sf_dir).select(
        "id", F.coalesce("lang", F.lit("none")).alias("tab"), at.alias("at"), at.alias("archived_at"), (at - F.expr("INTERVAL 3 DAYS")).alias("original"), "title", none.alias("article_title"),
        none.alias("title_ko"), F.when(read, F.upper("title")).alias("deep_title"), none.alias("url"), none.alias("image"), none.alias("image_kind"), "source", F.col("text").alias("summary"),
        none.alias("summary_ko"), none.alias("deep_summary"), none.alias("deep_category"), (F.col("quality") == 1).alias("keep"), F.when(read, 1 + F.col("id") % 10).cast("int").alias("sharpness"),
    )
    site.export(items, root, F.lit("other"))
    n = lambda name, said: versions.read(spark, root, name).groupBy("tab").agg(F.count("*").alias(said))
    meta = versions.read(spark, root, "meta").select("tab", "item_count", "date_count", "latest", "read_count", "keep_count")
    return meta.join(n("recent", "recent"), "tab", "left").join(n("today", "picks"), "tab", "left").na.fill({"picks": 0})


@query("agg08_source_max", f"WITH {DOC_ITEMS}, n AS (SELECT lang, source, count(*) AS n FROM docs GROUP BY 1, 2) SELECT lang, max(n) AS most, count(*) AS sources FROM n GROUP BY 1")
def source_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = doc_items(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.max("n").alias("most"), F.count("*").alias("sources"))


@query("agg21_health", f"WITH p AS (SELECT page_id % 3 AS tab, {CANONICAL} AS c FROM pages), k AS (SELECT c, count(DISTINCT tab) AS tabs, count(*) AS n FROM p GROUP BY 1) SELECT tabs, count(*) AS addresses, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses stand in one, two or three tabs."""
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("tab"), url.canonical(F.col("url")).alias("c")).groupBy("c", "tab").agg(F.count("*").alias("n"))
    k = p.groupBy("c").agg(F.count("*").alias("tabs"), F.sum("n").alias("n"))
    return k.groupBy("tabs").agg(F.count("*").alias("addresses"), F.sum("n").alias("n"))


@query("jn09_trusted_hosts", f"WITH {PAGE_ITEMS}, t AS (SELECT host FROM items GROUP BY 1 HAVING count(*) >= 5) SELECT id, host IN (SELECT host FROM t) AS trusted FROM items WHERE host IS NOT NULL")
def trusted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir).where("host IS NOT NULL").select("id", "host")
    t = p.groupBy("host").agg(F.count("*").alias("n")).where("n >= 5").select("host", F.lit(True).alias("trusted"))
    return p.join(t, "host", "left").select("id", F.coalesce("trusted", F.lit(False)).alias("trusted"))


@query("jn18_flag_join", "WITH f(source, flag) AS (VALUES ('src0', 'core'), ('src3', 'paused')) SELECT doc_id, flag FROM documents JOIN f USING (source)")
def flag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spark.createDataFrame([("src0", "core"), ("src3", "paused")], "source string, flag string")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(flags, "source").select("doc_id", "flag")


@query("sel18_picks_with_taste", "WITH a AS (SELECT user_id, event_type, greatest(-1.5, least(1.5, 0.25 * sum(CASE WHEN CAST(props->>'k' AS INT) >= 50 THEN 1 ELSE -1 END))) AS boost FROM events GROUP BY 1, 2) SELECT e.event_id, round(e.value + boost, 6) AS score FROM events e JOIN a USING (user_id, event_type) WHERE event_type = 'purchase' ORDER BY e.value + boost DESC, e.event_id LIMIT 12")
def picks_with_taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .events import taste_boost

    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "event_type", "value")
    s = e.join(taste_boost(spark, sf_dir), ["user_id", "event_type"]).withColumn("s", F.col("value") + F.col("boost"))
    return s.orderBy(F.desc("s"), "event_id").limit(12).select("event_id", F.round("s", 6).alias("score"))


@query("sel14_day_quota", f"WITH {PAGE_ITEMS}, m AS (SELECT id, day, id % 3 = 0 AS marked FROM items), q AS (SELECT *, row_number() OVER (PARTITION BY day, marked ORDER BY id) AS k FROM m) SELECT id, day FROM q WHERE k <= CASE WHEN marked THEN 5 ELSE 10 END")
def day_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day anew: at most five bookmarks and ten editorial rows."""
    m = page_items(spark, sf_dir).select("id", "day", (F.col("id") % 3 == 0).alias("marked"))
    k = F.row_number().over(Window.partitionBy("day", "marked").orderBy("id"))
    return m.withColumn("k", k).where(F.col("k") <= F.when(F.col("marked"), 5).otherwise(10)).select("id", "day")


@query("prm03_unique_terms", r"SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{3,}') || regexp_extract_all(lower(role), '[\p{L}]{3,}'))) AS BIGINT) AS terms FROM conversations")
def unique_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]{3,})"), F.lit(1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_distinct(F.concat(found("text"), found("role")))).cast("long").alias("terms"))


@query("prm04_source_key", f"WITH {PAGE_ITEMS} SELECT id, lower(trim(coalesce(nullif(CASE WHEN id % 3 = 0 THEN ' ' || upper(host) END, ''), CASE WHEN id % 3 = 1 THEN 'S' || id END, host, ''))) AS k FROM items")
def source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's source: its name, else its id, else its host; in lower case."""
    name, ident = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), F.upper("host"))), F.when(F.col("id") % 3 == 1, F.concat(F.lit("S"), F.col("id").cast("string")))
    return page_items(spark, sf_dir).select("id", F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), ident, "host", F.lit("")))).alias("k"))


@query("prm05_search_url", r"SELECT page_id, regexp_matches(lower(url), '/search([/?#]|$)|[?&](q|s|query|search)=') AS is_search FROM pages")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower("url").rlike(r"/search(?:[/?#]|$)|[?&](?:q|s|query|search)=").alias("is_search"))


@query("prm09_toggles", "SELECT user_id, event_type, count(*) % 2 = 1 AS saved FROM events GROUP BY 1, 2")
def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is saved after an odd number of toggles."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.count("*") % 2 == 1).alias("saved"))


@query("job07_run_tally", "SELECT source, count(*) AS read, count(*) FILTER (WHERE quality = 1) AS kept FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_items(spark, sf_dir).where("quality IS NOT NULL").groupBy("source").agg(F.count("*").alias("read"), F.count_if(F.col("quality") == 1).alias("kept"))


@query("sel23_board_filter", "WITH e AS (SELECT DISTINCT conv_id, unnest([conv_id, conv_id * 3, conv_id * 40]) AS doc_id FROM conversations) SELECT conv_id, count(*) AS cards FROM e WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1 HAVING count(*) >= 2")
def board_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards whose ids exist, with at least two of them."""
    b = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    e = b.select("conv_id", F.explode(F.array_distinct(F.array(F.col("conv_id"), F.col("conv_id") * 3, F.col("conv_id") * 40))).alias("doc_id"))
    return e.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("cards")).where("cards >= 2")


@query("flt09_valid_update", f"WITH {_UPDATES} SELECT id FROM s WHERE len(hard) = 0 AND score >= 35 AND title <> '' AND n >= 60")
def valid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where((F.col("u.eligible")) & (F.col("title") != "") & (F.length("text") >= 60)).select("id")


@query("cls08_role", f"WITH {DOC_ITEMS} SELECT id, CASE WHEN source = 'src1' THEN 'cinema' WHEN source = 'src2' THEN 'korean-code' WHEN id % 7 = 0 THEN 'history' ELSE 'updates' END AS role FROM docs")
def role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of a row: a tab's own mark first, then its layer."""
    return doc_items(spark, sf_dir).select("id", F.when(F.col("source") == "src1", "cinema").when(F.col("source") == "src2", "korean-code").when(F.col("id") % 7 == 0, "history").otherwise("updates").alias("role"))


@query("cls07_method_argmax", r"WITH s AS (SELECT doc_id, len(regexp_extract_all(text, 'tion')) AS a, len(regexp_extract_all(text, 'ung')) AS b FROM documents) SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'none' WHEN a >= b THEN 'process' ELSE 'contrast' END AS method FROM s")
def method_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import best_rule

    return table(spark, sf_dir, "documents").select("doc_id", best_rule(F.col("text"), [("process", "tion"), ("contrast", "ung")], F.lit("none")).alias("method"))


@query("prm11_archived_urls", f"WITH p AS (SELECT {CANONICAL} AS c FROM pages WHERE page_id % 2 = 0 UNION SELECT {CANONICAL} FROM pages WHERE page_id % 3 = 0) SELECT c FROM p")
def archived_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("c"))
    return p.where("page_id % 2 = 0 OR page_id % 3 = 0").select("c").distinct()
