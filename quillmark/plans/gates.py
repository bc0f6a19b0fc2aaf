"""The quality gate as queries: results, evidence, tabs at fault, and the contract of an incident playbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gate
from .registry import query
from .tables import DOC_ITEMS, doc_items, table

TABS = ["en", "fr", "de", "es", "ko"]
ROWS_A_DAY = 15


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of tabs (their languages): addresses that some share, fifty days, an image for every third."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), (F.col("id") % 997).cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).cast("string")
    return doc_items(spark, sf_dir).select("id", F.col("lang").alias("tab"), "source", "title", "text", "quality", "toxic", url.alias("url"), day.alias("day"), (F.col("id") % 3 == 0).alias("image"))


def checks() -> list[gate.Check]:
    c = F.col
    has = lambda x: F.length(F.trim(x)) > 0
    return [
        gate.at_least("items", 100),
        gate.at_most("toxic_rows", 5, c("toxic") == 1),
        gate.at_most("rows_today", ROWS_A_DAY, latest=True),
        gate.at_least("thin_today", ROWS_A_DAY, latest=True, level=gate.WARNING),
        gate.each("full_day", c("day"), ROWS_A_DAY),
        gate.unique("repeated_url", c("url")),
        gate.unique("repeated_text", c("text")),
        gate.unique("repeated_title_today", c("title"), where=c("day") == "2024-02-19"),
        gate.every("has_title", has("title")),
        gate.every("has_text", has("text")),
        gate.every("metadata", c("id").isNotNull() & has("source") & has("url") & has("title")),
        gate.every("degraded", ~c("text").rlike(r"[*$%&#]{3}")),
        gate.every("leak_today", ~F.lower("text").contains("licensed under"), latest=True),
        gate.every("long_enough_today", F.length(F.trim("text")) >= 60, latest=True),
        gate.every("labelled_high", c("quality") == 1, where=c("quality").isNotNull() & c("image")),
        gate.share("images", c("image"), 0.3),
        gate.share("good_labels", c("quality") == 1, 0.5, where=c("quality").isNotNull(), tabs=("en", "fr", "de", "es")),
        gate.kinds("fields", c("source"), 5),
        gate.kinds("fields_with_image", c("source"), 12, where=c("image"), level=gate.WARNING),
    ]


_I = DOC_ITEMS + r""", i AS (SELECT id, lang AS tab, source, title, text, quality, toxic, 'https://' || source || '.example.com/doc/' || (id % 997) AS url, CAST(DATE '2024-01-01' + CAST(id % 50 AS INT) AS VARCHAR) AS day, id % 3 = 0 AS image FROM docs),
  t AS (SELECT unnest(['en', 'fr', 'de', 'es', 'ko']) AS tab), l AS (SELECT i.*, i.day = max(i.day) OVER (PARTITION BY i.tab) AS late FROM i JOIN t USING (tab))"""


def _spare(key: str) -> str:
    """Rows whose key another row has, and rows without one."""
    return f"count(*) - count(DISTINCT CASE WHEN trim({key}) <> '' THEN {key} END)"


_EVERY = {
    "has_title": "length(trim(title)) > 0",
    "has_text": "length(trim(text)) > 0",
    "metadata": "id IS NOT NULL AND length(trim(source)) > 0 AND length(trim(url)) > 0 AND length(trim(title)) > 0",
    "degraded": "NOT regexp_matches(text, '[*$%&#]{3}')",
    "leak_today": "NOT contains(lower(text), 'licensed under')",
    "long_enough_today": "length(trim(text)) >= 60",
    "labelled_high": "quality = 1",
}
_FOR = {"leak_today": "late", "long_enough_today": "late", "labelled_high": "quality IS NOT NULL AND image"}
#: check -> (rows, observed, op, bound, level)
_RESULTS = {
    "items": ("true", "count(*)", ">=", 100, "failure"),
    "toxic_rows": ("toxic = 1", "count(*)", "<=", 5, "failure"),
    "rows_today": ("late", "count(*)", "<=", 15, "failure"),
    "thin_today": ("late", "count(*)", ">=", 15, "warning"),
    "repeated_url": ("true", _spare("url"), "<=", 0, "failure"),
    "repeated_text": ("true", _spare("text"), "<=", 0, "failure"),
    "repeated_title_today": ("day = '2024-02-19'", _spare("title"), "<=", 0, "failure"),
    "images": ("true", "avg(image::INT)", ">=", 0.3, "failure"),
    "good_labels": ("quality IS NOT NULL AND tab <> 'ko'", "avg((quality = 1)::INT)", ">=", 0.5, "failure"),
    "fields": ("true", "count(DISTINCT source)", ">=", 5, "failure"),
    "fields_with_image": ("image", "count(DISTINCT source)", ">=", 12, "warning"),
} | {n: (_FOR.get(n, "true"), f"count(*) FILTER (WHERE ({rule}) IS NOT TRUE)", "<=", 0, "failure") for n, rule in _EVERY.items()}
_PARTS = [
    f"SELECT t.tab, '{n}' AS check_id, '{level}' AS level, {'observed' if 'avg' in seen else 'coalesce(observed, 0)'}::DOUBLE AS observed, '{op}' AS op, {bound}::DOUBLE AS bound FROM t LEFT JOIN (SELECT tab, {seen} AS observed FROM l WHERE {rows} GROUP BY 1) g ON g.tab = t.tab"
    + (" WHERE t.tab <> 'ko'" if n == "good_labels" else "")
    for n, (rows, seen, op, bound, level) in _RESULTS.items()
]
_PARTS.append("SELECT t.tab, 'full_day', 'failure', coalesce(max(n), 0)::DOUBLE, '<=', 15::DOUBLE FROM t LEFT JOIN (SELECT tab, day, count(*) AS n FROM l GROUP BY 1, 2) g ON g.tab = t.tab GROUP BY 1")
_GATE = f"{_I}, r AS ({' UNION ALL '.join(_PARTS)}), z AS (SELECT *, coalesce(CASE WHEN op = '<=' THEN observed <= bound ELSE observed >= bound END, false) AS ok FROM r)"


@query("dq01_gate", f"WITH {_GATE} SELECT * FROM z")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-01: 94 assertions of five tabs (one of them without rows) in one scan."""
    return gate.gate(_items(spark, sf_dir), checks(), "tab", TABS, "day")


_TWICE = " UNION ALL ".join(
    f"SELECT tab, '{n}' AS check_id, id, CASE WHEN trim({key}) <> '' THEN {key} END AS key FROM l WHERE {rows} QUALIFY coalesce(trim({key}), '') = '' OR count(*) OVER (PARTITION BY tab, {key}) > 1"
    for n, key, rows in (("repeated_url", "url", "true"), ("repeated_text", "text", "true"), ("repeated_title_today", "title", "day = '2024-02-19'"))
)
_BROKEN = " UNION ALL ".join(f"SELECT tab, '{n}', id, NULL FROM l WHERE {_FOR.get(n, 'true')} AND ({rule}) IS NOT TRUE" for n, rule in _EVERY.items())


@query("dq01_evidence", f"WITH {_I}, e AS ({_TWICE} UNION ALL {_BROKEN} UNION ALL SELECT tab, 'full_day', id, day FROM l QUALIFY count(*) OVER (PARTITION BY tab, day) > 15) SELECT tab, check_id, id, md5(key) AS key FROM e")
def gate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind the gate's failures, all of them."""
    return gate.evidence(_items(spark, sf_dir), checks(), "tab", TABS, "id", "day").select("tab", "check_id", "id", F.md5("key").alias("key"))


@query("dq04_failing_tabs", f"""WITH {_GATE}, m AS (SELECT 'tab ' || tab || ': ' || check_id || ' is ' || CASE WHEN observed IS NULL THEN 'unknown' ELSE 'off' END AS said FROM z WHERE NOT ok AND level = 'failure')
  SELECT CASE WHEN contains(said, 'tab en') THEN 'english' WHEN regexp_matches(said, '(?i)tab (fr|es)') THEN 'romance' WHEN contains(said, 'images') THEN 'pictures' ELSE 'global' END AS tab, count(*) AS failures FROM m GROUP BY 1""")
def failing_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-04: which tabs the gate's failure messages speak of."""
    bad = quality_gate(spark, sf_dir).where(~F.col("ok") & (F.col("level") == gate.FAILURE))
    said = F.concat(F.lit("tab "), "tab", F.lit(": "), "check_id", F.lit(" is "), F.when(F.col("observed").isNull(), "unknown").otherwise("off"))
    return gate.failing_tabs(bad.select(said.alias("said")), "said", [("english", "tab en"), ("romance", "(?i)tab (fr|es)"), ("pictures", "images")])


_PLAYBOOK = [
    ("least_incidents", "count(*)", ">=", 6),
    ("incident_ids", "count(*) - count(DISTINCT id)", "<=", 0),
    ("has_signals", "count(*) FILTER (WHERE signals = 0)", "<=", 0),
    ("has_actions", "count(*) FILTER (WHERE actions = 0)", "<=", 0),
    ("on_failure", "count(*) FILTER (WHERE NOT last_resort)", "<=", 0),
]


@query("dq10_playbook_contract", """WITH p AS (SELECT conv_id AS id, count(*) FILTER (WHERE role = 'user' AND length(text) > 0) AS signals, count(*) FILTER (WHERE role = 'assistant' AND length(text) > 0) AS actions, bool_or(role = 'system') AS last_resort FROM conversations GROUP BY 1), r AS ("""
  + " UNION ALL ".join(f"SELECT 'playbook' AS tab, '{n}' AS check_id, 'failure' AS level, ({seen})::DOUBLE AS observed, '{op}' AS op, {bound}::DOUBLE AS bound FROM p" for n, seen, op, bound in _PLAYBOOK)
  + ") SELECT *, CASE WHEN op = '<=' THEN observed <= bound ELSE observed >= bound END AS ok FROM r")
def playbook_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-10: conversations as incidents: user turns as signals, assistant turns as actions, a system turn as the last resort."""
    said = F.coalesce(F.length("text"), F.lit(0)) > 0
    p = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.count_if((F.col("role") == "user") & said).alias("signals"), F.count_if((F.col("role") == "assistant") & said).alias("actions"), F.bool_or(F.col("role") == "system").alias("last_resort")
    ).withColumn("tab", F.lit("playbook"))
    tests = [
        gate.at_least("least_incidents", 6),
        gate.unique("incident_ids", F.col("id")),
        gate.every("has_signals", F.col("signals") > 0),
        gate.every("has_actions", F.col("actions") > 0),
        gate.every("on_failure", F.col("last_resort")),
    ]
    return gate.gate(p, tests, "tab", ["playbook"])
