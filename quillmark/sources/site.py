"""The site export: items as the site reads them, recent ones, tab totals and today's picks, published as one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators.rounds import written
from ..operators.select import capped_top
from . import versions

# Days of the recent table and of the day counts, summary length, picks, and images that aren't an item's own.
RECENT_DAYS, COUNTED_DAYS, SUMMARY_CHARS = 21, 14, 240
PICKS, PICKS_A_SOURCE, PICK_DAYS, OLD_DAYS = 12, 2, 3, 365
FOREIGN_IMAGES = ("related", "page-preview")


def _first(*columns: str) -> Column:
    """The first column that isn't null or empty; null if none is."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def compact(items: DataFrame, category: Column, template: str = "$^") -> DataFrame:
    """Archive rows -> id, tab, day, at, t, ot, u, img, s, od, sum, cat, old, k, sh.

    items: id, tab, at, archived_at, original (timestamps), title, article_title, title_ko, deep_title, url, image,
    image_kind, source, summary, summary_ko, deep_summary, deep_category, keep, sharpness. A reading's title and summary
    come first; a local summary that matches the pattern ``template`` gives way to the original one. ``category`` is for
    rows without a reading. Null times have no day; an unread row has null k and sh.
    """
    at = F.coalesce("at", "archived_at")
    local, original = text.clean_feed(F.coalesce("summary_ko", F.lit(""))), text.clean_feed(F.coalesce("summary", F.lit("")), SUMMARY_CHARS)
    summary = text.once(local, lambda x: F.when(x.rlike(template), original).otherwise(x))
    age = (F.unix_seconds(at) - F.unix_seconds("original")) / 86400
    return items.select(
        "id", "tab", values.kst_day(at).cast("string").alias("day"), at.alias("at"), _first("deep_title", "title_ko", "article_title", "title").alias("t"),
        _first("article_title", "title").alias("ot"), F.col("url").alias("u"),
        F.when(F.coalesce(F.col("image_kind").isin(*FOREIGN_IMAGES), F.lit(False)), "").otherwise(F.coalesce("image", F.lit(""))).alias("img"),
        F.coalesce("source", F.lit("")).alias("s"), F.col("original").alias("od"),
        F.coalesce(_first("deep_summary"), summary).alias("sum"), F.coalesce(_first("deep_category"), category).alias("cat"),
        F.coalesce(age > OLD_DAYS, F.lit(False)).alias("old"), F.col("keep").cast("int").alias("k"), F.col("sharpness").alias("sh"),
    )


def ranked_days(rows: DataFrame) -> DataFrame:
    """(tab, day, n, r): days of each tab, the newest first; a window over days, not rows."""
    days = rows.where("day IS NOT NULL").groupBy("tab", "day").agg(F.count("*").alias("n"))
    return days.withColumn("r", F.row_number().over(Window.partitionBy("tab").orderBy(F.desc("day"))))


def tab_totals(rows: DataFrame) -> DataFrame:
    """By tab: items, days, latest, dates from the newest, counts of the last days, read and kept rows."""
    days = ranked_days(rows).groupBy("tab").agg(
        F.count("*").alias("date_count"), F.max("day").alias("latest"), F.sort_array(F.collect_list("day"), asc=False).alias("dates"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("r") <= COUNTED_DAYS, F.struct("day", "n"))))).alias("day_counts"),
    )
    n = rows.groupBy("tab").agg(F.count("*").alias("item_count"), F.count_if(F.col("sh") > 0).alias("read_count"), F.count_if((F.col("sh") > 0) & (F.col("k") == 1)).alias("keep_count"))
    return n.join(days, "tab", "left")


def todays_picks(rows: DataFrame) -> DataFrame:
    """The sharpest kept rows of the last three days of all tabs, two a source."""
    days = rows.select("day").where("day IS NOT NULL").distinct().orderBy(F.desc("day")).limit(PICK_DAYS)
    kept = rows.where("k = 1").join(F.broadcast(days), "day", "left_semi")
    return capped_top(kept, "s", [F.desc_nulls_last("sh"), F.desc("day"), F.col("id")], PICKS_A_SOURCE, PICKS)


def export(items: DataFrame, root: str, category: Column, template: str = "$^", replaces: int | None = None) -> int:
    """Commits the tables all, recent (both by tab), meta and today as one state; returns its version.

    Readers see the four tables of one version or of the one before, never a mixture. Items are read and made compact
    once; the four tables are made from the compact rows.
    """
    rows = written(compact(items, category, template))
    recent = rows.join(ranked_days(rows).where(F.col("r") <= RECENT_DAYS).select("tab", "day"), ["tab", "day"], "left_semi")
    tables = {"all": rows, "recent": recent.select(*rows.columns), "meta": tab_totals(rows), "today": todays_picks(rows)}
    return versions.commit(items.sparkSession, root, tables, partition_by={"all": ["tab"], "recent": ["tab"]}, replaces=replaces)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of an export in the order of the site: day, original time, sharpness, all descending."""
    time = F.coalesce("od", F.to_timestamp(F.concat("day", F.lit("T00:00:00+09:00"))))
    return rows.orderBy(F.desc("day"), F.desc(time), F.desc_nulls_last("sh"), "id")


def tab_items(spark: SparkSession, root: str, tab: str, table: str = "recent", version: int | None = None) -> DataFrame:
    """Rows of a tab as the manifest names them; only that tab's folders are read."""
    return in_order(versions.read(spark, root, table, version).where(F.col("tab") == tab))
