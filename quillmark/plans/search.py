"""Queries over the search index: increments, and lookups of many queries at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search_index
from ..operators.rounds import shared_folder
from .registry import query
from .tables import table

FIELDS = ["title", "bookmark", "text"]
BLOCK = "id div 64"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the index takes them, as ``doc_items`` has them but without a join of their labels."""
    title = F.left(F.substring_index("text", "\n", 1), F.lit(80))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), F.col("source").alias("bookmark"), "text")


def indexed(spark: SparkSession, sf_dir: str) -> str:
    """An index of all documents, made by three increments: other texts for a fifth of them first, then the rest, then these again."""
    root, d = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", _docs(spark, sf_dir)
    old = d.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat(F.lit("draft "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    search_index.merge(old.where("id % 3 <> 1"), root, 1, BLOCK, FIELDS)
    search_index.merge(d.where("id % 3 = 1"), root, 2, BLOCK, FIELDS)
    search_index.merge(d.where("id % 5 = 0"), root, 3, BLOCK, FIELDS)
    return root


_WORDS = r"""WITH d AS (SELECT doc_id AS id, doc_id // 64 AS block, lower(left(regexp_extract(text, '^([^\n]*)', 1), 80)) AS title, lower(source) AS bookmark, lower(text) AS body FROM documents),
    f AS (SELECT id, block, 1 AS bit, unnest(list_distinct(regexp_split_to_array(title, '[\x20\x09-\x0D]+'))) AS word FROM d
      UNION ALL SELECT id, block, 2, unnest(list_distinct(regexp_split_to_array(bookmark, '[\x20\x09-\x0D]+'))) FROM d
      UNION ALL SELECT id, block, 4, unnest(list_distinct(regexp_split_to_array(body, '[\x20\x09-\x0D]+'))) FROM d)"""


@query("str08_index_increments", _WORDS + """ SELECT block, count(DISTINCT id) AS docs, count(DISTINCT word) AS words, count(*) AS entries, CAST(sum(bit) AS BIGINT) AS bits FROM f WHERE word <> '' GROUP BY 1""")
def index_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: what the index holds of each block after three increments, as if it had been made at once."""
    p = search_index.blocks_of_postings(spark, indexed(spark, sf_dir))
    bits = F.aggregate("entries", F.lit(0).cast("long"), lambda total, e: total + e.bitwiseAND(255))
    return p.select("block", F.size("ids").cast("long").alias("docs"), F.size("words").cast("long").alias("words"), F.size("entries").cast("long").alias("entries"), bits.alias("bits"))


#: A query for each document whose id is divisible by 100: five tokens of its title, the first three of them required.
_TOKENS = "list_filter(l, lambda x, i: list_position(l, x) = i)[1:5]"
_TITLES = r"d0 AS (SELECT *, list_filter(string_split(regexp_replace(title, '[^a-zà-ÿß\x20]', ' ', 'g'), ' '), lambda x: length(x) >= 3) AS l FROM d)"


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_replace(F.lower("title"), r"[^a-zà-ÿß\x20]", " ")
    tokens = F.slice(F.array_distinct(F.filter(F.split(title, " "), lambda x: F.length(x) >= 3)), 1, 5)
    q = _docs(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query"), tokens.alias("terms"))
    return q.withColumn("required", F.slice("terms", 1, 3))


@query("api02_index_lookup", rf"""WITH d AS (SELECT doc_id AS id, lower(left(regexp_extract(text, '^([^\n]*)', 1), 80)) AS title, lower(source) AS bookmark, lower(text) AS body FROM documents),
    {_TITLES}, q AS (SELECT id AS query, {_TOKENS} AS terms FROM d0 WHERE id % 100 = 0),
    t AS (SELECT query, unnest(terms) AS term, generate_subscripts(terms, 1) <= 3 AS required, least(3, len(terms)) AS needed FROM q),
    s AS (SELECT query, needed, id, CAST(sum(CASE WHEN contains(title, term) THEN 12 ELSE 0 END + CASE WHEN contains(bookmark, term) THEN 5 ELSE 0 END + CASE WHEN contains(body, term) THEN 3 ELSE 0 END) AS INT) AS points,
        count(*) FILTER (WHERE required AND (contains(title, term) OR contains(bookmark, term) OR contains(body, term))) AS seen FROM t, d GROUP BY 1, 2, 3),
    p AS (SELECT query, id, points + CASE WHEN seen = needed THEN 18 ELSE 0 END AS score FROM s)
    SELECT query, id, score FROM p WHERE score >= 20 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 48""")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-02: the best 48 documents of each query, from the index."""
    return search_index.lookup(spark, indexed(spark, sf_dir), queries_of(spark, sf_dir), FIELDS)[0]


@query("sel06_blocks_read", rf"""WITH d AS (SELECT doc_id AS id, lower(left(regexp_extract(text, '^([^\n]*)', 1), 80)) AS title FROM documents),
    {_TITLES}, q AS (SELECT id AS query, {_TOKENS} AS terms FROM d0 WHERE id % 100 = 0) SELECT query, true AS within FROM q WHERE len(terms) > 0""")
def blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each query's lookup read at most the blocks that can reach its least score."""
    report = search_index.lookup(spark, indexed(spark, sf_dir), queries_of(spark, sf_dir), FIELDS)[1]
    return report.select("query", (F.col("read_first") + F.col("read_then") <= F.col("blocks")).alias("within"))
