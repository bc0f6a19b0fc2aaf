"""Queries over curated items: profiles, boosts, verdicts, merges, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, url, values
from ..operators import curate, dedupe, select
from .registry import query
from .tables import CANONICAL, DOC_ITEMS, PAGE_ITEMS, doc_items, page_items, table

LEXICON = {"thing": ["thein", "other things"], "place": ["ouer", "where"]}


@query("cls10_query_expansion", r"""WITH t AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user'),
    w AS (SELECT conv_id, turn, q, list_filter(regexp_split_to_array(regexp_replace(q, '[^\p{L}\p{N}\s-]', ' ', 'g'), '\s+'), lambda x: length(x) > 1) AS ws FROM t)
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(ws || CASE WHEN contains(q, 'thing') OR contains(q, 'thein') OR contains(q, 'other things') THEN ['thing', 'thein', 'other', 'things'] ELSE [] END
      || CASE WHEN contains(q, 'place') OR contains(q, 'ouer') OR contains(q, 'where') THEN ['place', 'ouer', 'where'] ELSE [] END)), ' ') AS terms FROM w""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(curate.expand_query(F.col("text"), LEXICON)), " ").alias("terms"))


@query("cls12_source_profile", """SELECT doc_id, CASE WHEN regexp_matches(source, '^src1[0-9]$') THEN 'teens' WHEN regexp_matches(source, '[02468]$') THEN 'even' ELSE 'plain' END AS profile,
    CAST(CASE WHEN regexp_matches(source, '^src1[0-9]$') THEN floor(5 * 2 * 0.7 + 0.5) WHEN regexp_matches(source, '[02468]$') THEN floor(5 * 1 * 0.7 + 0.5) ELSE 0 END AS INT) AS boost FROM documents""")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-12 and CLS-13: the first profile that matches, and its boost for an intent's axes."""
    profiles = [("teens", "^src1[0-9]$", ["image", "text", "sound"]), ("even", "[02468]$", ["text"])]
    p = table(spark, sf_dir, "documents").select("doc_id", curate.first_profile(F.col("source"), profiles, "plain").alias("p"))
    return p.select("doc_id", F.col("p.name").alias("profile"), curate.profile_boost(F.col("p.strengths"), F.array(F.lit("text"), F.lit("image")), F.lit(0.7)).alias("boost"))


@query("cls14_layer_boost", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 18 WHEN 1 THEN 10 WHEN 2 THEN 8 ELSE 0 END AS boost FROM pages")
def layer_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.element_at(F.array(*[F.lit(x) for x in ("core", "history", "verified", "other")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", curate.layer_boost(layer).alias("boost"))


@query("cls18_reasons", """SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN source = 'src0' THEN 'main' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)[:4], ', ') AS reasons FROM documents""")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [(F.col("n_chars") > 2000, "long"), (F.col("text").contains("the"), "the"), (F.col("lang") == "en", "english"), (F.col("source") == "src0", "main"), (F.col("doc_id") % 2 == 0, "even")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(curate.reasons(tests), ", ").alias("reasons"))


@query("cls20_candidate_verdicts", """WITH a AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 5 = 0), d AS (SELECT source, sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1, 2),
    g AS (SELECT source, CAST(sum(n) AS BIGINT) AS fetched, count(*) AS "distinct", count(*) FILTER (WHERE h NOT IN (SELECT h FROM a)) AS novel FROM d GROUP BY 1),
    s AS (SELECT *, CAST(floor(10 * novel + 40 * (novel / CAST("distinct" AS DOUBLE)) + CASE WHEN novel > 0 THEN 10 ELSE -20 END + 0.5) AS BIGINT) AS score FROM g)
    SELECT *, CASE WHEN score >= 80 THEN 'promote' WHEN score >= 35 THEN 'watch' ELSE 'reject' END AS verdict FROM s""")
def candidate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return curate.candidate_verdicts(d.where("doc_id % 5 <> 0"), "source", "h", d.where("doc_id % 5 = 0"))


@query("agg15_hypotheses", f"""WITH {PAGE_ITEMS}, e AS (SELECT DISTINCT conv_id AS claim, unnest([conv_id, conv_id * 2, conv_id * 3, conv_id + 1]) AS id FROM conversations)
    SELECT claim, count(*) AS evidence, count(DISTINCT host) AS sources, min(day) AS first_seen, max(day) AS last_seen FROM e JOIN items USING (id) GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT host) >= 2""")
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    claims = c.select(F.col("conv_id").alias("claim"), F.array(F.col("conv_id"), F.col("conv_id") * 2, F.col("conv_id") * 3, F.col("conv_id") + 1).alias("ids"))
    return curate.hypotheses(claims, page_items(spark, sf_dir).select("id", F.col("host").alias("source"), "day"))


@query("mrg01_merge_archives")
def merge_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming documents over archived ones, unique by text and by title a language."""
    d = doc_items(spark, sf_dir).select(F.coalesce("lang", F.lit("")).alias("tab"), F.col("id").alias("pos"), "id", F.sha2("text", 256).alias("url_key"), text.title_key(F.col("title")).alias("title_key"))
    return curate.merge_archives(d.where("id % 4 = 0"), d.where("id % 4 <> 0"), "tab")


@query("mrg03_normalised_rows", f"SELECT page_id, left(sha256({CANONICAL}), 20) AS archive_id, coalesce(CASE WHEN page_id % 3 = 0 THEN '2024-01-01' END, '2024-06-01') AS original, '2024-06-01' AS day FROM pages")
def normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as archives keep them: a stable id; the collection day takes the place of the original date."""
    original = F.when(F.col("page_id") % 3 == 0, "2024-01-01")
    return table(spark, sf_dir, "pages").select("page_id", values.hash_id(url.canonical(F.col("url"))).alias("archive_id"), F.coalesce(original, F.lit("2024-06-01")).alias("original"), F.lit("2024-06-01").alias("day"))


@query("src20_flagged_quota", f"WITH {PAGE_ITEMS}, f(host) AS (SELECT DISTINCT host FROM items WHERE id < 40) SELECT id, regexp_replace(coalesce(title, ''), '\\.$', '') AS title FROM items WHERE host IN (SELECT host FROM f) AND title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY id) <= 2")
def flagged_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each flagged source, resolved rows only, without a title's tail."""
    p = page_items(spark, sf_dir).where("title IS NOT NULL").select("id", "host", "title")
    flagged = page_items(spark, sf_dir).where("id < 40").select("host").distinct()
    kept = select.cap_per_group(p.join(flagged, "host", "left_semi"), "host", ["id"], 2)
    return kept.select("id", F.regexp_replace("title", r"\.$", "").alias("title"))


@query("src27_reserve_scan", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'thion|ment') AND NOT regexp_matches(text, '[*$%&#]{3}') AND length(text) >= 200 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id DESC LIMIT 200")
def reserve_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.lower("text").rlike("thion|ment") & ~F.col("text").rlike(r"[*$%&#]{3}") & (F.length("text") >= 200)).select("doc_id")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(200)


@query("sel12_backfill_slots", f"""WITH {PAGE_ITEMS}, d AS (SELECT day, count(*) AS n FROM items WHERE id % 2 = 0 GROUP BY 1), need AS (SELECT day, 15 - n AS missing, sum(15 - n) OVER (ORDER BY day) AS upto FROM d WHERE n < 15),
    c AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM items WHERE id % 2 = 1) SELECT c.id, need.day FROM c JOIN need ON rank > upto - missing AND rank <= upto""")
def backfill_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in rank order onto the missing slots of days, oldest first: slots and candidates meet by number.

    Only as many candidates as there are slots are ranked; both windows run over that many rows.
    """
    p = page_items(spark, sf_dir)
    days = p.where("id % 2 = 0").groupBy("day").agg(F.count("*").alias("n")).where("n < 15").select("day", (15 - F.col("n")).alias("missing"))
    slots = days.select("day", F.explode(F.sequence(F.lit(1), F.col("missing").cast("int"))).alias("k"))
    slots = slots.withColumn("rank", F.row_number().over(Window.orderBy("day", "k")))
    few = p.where("id % 2 = 1").select("id").orderBy("id").limit(slots.count())
    return few.withColumn("rank", F.row_number().over(Window.orderBy("id"))).join(slots, "rank").select("id", "day")


@query("sel15_export_order", f"WITH {DOC_ITEMS} SELECT id, CAST(row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, n_chars DESC, id) AS BIGINT) AS place FROM docs")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("quality"), F.desc("n_chars"), "id")
    return doc_items(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("place"))


@query("sel16_trusted_top", "SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS kept FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY sum(quality) / CAST(count(*) AS DOUBLE) DESC, source LIMIT 15")
def trusted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = doc_items(spark, sf_dir).where("quality IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("kept"))
    return g.orderBy(F.desc(F.col("kept") / F.col("n")), "source").limit(15)


@query("agg12_dates_list", f"WITH {PAGE_ITEMS} SELECT host, array_to_string(list_reverse_sort(list_distinct(list(day))), ',') AS dates, count(DISTINCT day) AS n FROM items GROUP BY 1")
def dates_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = page_items(spark, sf_dir).groupBy("host").agg(F.sort_array(F.collect_set("day"), asc=False).alias("d"))
    return g.select("host", F.array_join("d", ",").alias("dates"), F.size("d").cast("long").alias("n"))


@query("agg16_cluster_filter", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 2) SELECT label, n FROM c ORDER BY n DESC, label LIMIT 10")
def cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    return c.orderBy(F.desc("n"), "label").limit(10)


@query("jn08_left_defaults", "SELECT c.conv_id, c.turn, coalesce(d.lang, 'unknown') AS lang FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 7")
def left_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 7).alias("doc_id"))
    return c.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "left").select("conv_id", "turn", F.coalesce("lang", F.lit("unknown")).alias("lang"))


@query("jn07_valid_ids", "WITH e AS (SELECT DISTINCT conv_id, unnest([conv_id, conv_id, conv_id + 40, conv_id * 50]) AS doc_id FROM conversations) SELECT conv_id, count(*) AS valid FROM e WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    e = c.select("conv_id", F.explode(F.array_distinct(F.array(F.col("conv_id"), F.col("conv_id") + 40, F.col("conv_id") * 50))).alias("doc_id"))
    return e.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("valid"))


@query("jn02_history_anti_join", f"WITH p AS (SELECT page_id, {CANONICAL} AS c FROM pages) SELECT page_id FROM p WHERE page_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.page_id % 2 = 0 AND q.c = p.c)")
def history_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("c"))
    return p.where("page_id % 2 = 1").join(p.where("page_id % 2 = 0").select("c"), "c", "left_anti").select("page_id")


@query("win07_first_owner", f"WITH {PAGE_ITEMS} SELECT id, first_value(id) OVER (PARTITION BY host ORDER BY day, id) AS owner FROM items")
def first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of each key as an aggregate joined back, so that a frequent key is combined before it is shuffled."""
    p = page_items(spark, sf_dir).select("id", "host", "day")
    own = p.groupBy("host").agg(F.min_by("id", F.struct("day", "id")).alias("owner"))
    return p.join(own, "host").select("id", "owner")


@query("fn08_entities", "SELECT page_id, len(regexp_extract_all(html, '&amp;')) AS n, md5(trim(regexp_replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_count("html", F.lit("&amp;")).cast("long").alias("n"), F.md5(text.decode_entities(F.col("html")).cast("binary")).alias("digest"))


@query("fn29_same_meaning", r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS a, regexp_replace(lower(regexp_extract(text, '^([^\n]*)', 1)), '[^\p{L}\p{N}]+', '', 'g') AS b, regexp_replace(lower(lang), '[^\p{L}\p{N}]+', '', 'g') AS c FROM documents)
    SELECT doc_id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS same, a <> '' AND c <> '' AND (contains(a, c) OR contains(c, a)) AS of_lang FROM d""")
def same_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.same_meaning(a, F.regexp_extract("text", r"^([^\n]*)", 1)).alias("same"), text.same_meaning(a, F.col("lang")).alias("of_lang"))


@query("flt06_same_site", f"WITH {PAGE_ITEMS} SELECT id FROM items WHERE (host = 'example.com' OR ends_with(host, '.example.com')) AND NOT regexp_matches(lower(url), '/(wp-admin|tag|tags|author|category|feed|assets)(/|$)|[?&](s|q)=')")
def same_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir)
    site = (F.col("host") == "example.com") | F.col("host").endswith(".example.com")
    return p.where(site & ~F.lower("url").rlike(r"/(?:wp-admin|tag|tags|author|category|feed|assets)(?:/|$)|[?&](?:s|q)=")).select("id")


@query("fn32_normalised_readings", "SELECT doc_id, CAST(greatest(1, least(10, n_chars // 300)) AS INT) AS sharpness, quality = 1 AND greatest(1, least(10, n_chars // 300)) >= 6 AS keep FROM documents JOIN labels USING (doc_id)")
def normalised_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness clamped to 1..10; kept only if said so and sharp enough."""
    d = doc_items(spark, sf_dir).where("quality IS NOT NULL")
    sharp = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("n_chars") / 300))).cast("int")
    return d.select(F.col("id").alias("doc_id"), sharp.alias("sharpness"), ((F.col("quality") == 1) & (sharp >= 6)).alias("keep"))


@query("snk03_history_write", f"WITH p AS (SELECT page_id, {CANONICAL} AS c FROM pages) SELECT c AS canonical, min(page_id) AS pos, max(page_id) AS last FROM p GROUP BY 1")
def history_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history index as it is written: canonical addresses, the last row's values at the first row's place."""
    p = table(spark, sf_dir, "pages").select(url.canonical(F.col("url")).alias("canonical"), F.col("page_id").alias("pos"), F.col("page_id").alias("last"))
    return dedupe.first_position_last_value(p, "canonical", "pos")
