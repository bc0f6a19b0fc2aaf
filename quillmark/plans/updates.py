"""The daily update as queries: today's rows of the tabs, and the report with what the publish policy makes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, url
from ..operators import daily
from ..operators.rounds import written
from .registry import query
from .tables import doc_items, stop_words

# Rows a source in both passes, and the likeness of titles that are one.
POLICIES = {"en": (3, 6, 0.82), "fr": (3, 7, 0.78), "de": (4, 10, 0.82)}
TODAY = "2024-01-08"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of tabs (their languages): addresses that some share, fifty days."""
    d = doc_items(spark, sf_dir)
    address = F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), (F.col("id") % 9973).cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).cast("string")
    return d.select(
        F.col("lang").alias("tab"), day.alias("day"), F.col("id").alias("pos"), "id", "source", "title", text.title_key(F.col("title")).alias("title_key"),
        url.identity_keys(address, F.col("title")).alias("keys"), text.title_tokens(F.col("title"), stop_words()).alias("words"), "quality", "toxic",
    )


def _prepared(rows: DataFrame) -> DataFrame:
    """Titles as shown, their first six words: two titles may then be one."""
    shown = F.substring_index("title", " ", 6)
    return rows.withColumn("title", shown).withColumn("title_key", text.title_key(shown)).withColumn("words", text.title_tokens(shown, stop_words()))


def update(spark: SparkSession, sf_dir: str) -> daily.Update:
    """Two of three documents are the archives, the others were found today; rows of low quality or toxic ones can't be shown."""
    rows, valid = written(_rows(spark, sf_dir)), (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & (F.col("title_key") != "")
    tabs = [daily.Tab(name, few, more, like, _prepared, valid) for name, (few, more, like) in POLICIES.items()]
    return daily.daily_update(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), tabs, TODAY)


@query("sel10_daily_items")
def daily_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update(spark, sf_dir).items.select("tab", "part", "rank", "id", "source", "title")


@query("job01_daily_report")
def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, with the archive's rows after the write and the decisions of the publish policy."""
    made = update(spark, sf_dir)
    after = made.archive.groupBy("tab").agg(F.count("*").alias("archive_after"))
    return made.report.join(after, "tab", "left").crossJoin(F.broadcast(daily.publish_policy(made.report)))
