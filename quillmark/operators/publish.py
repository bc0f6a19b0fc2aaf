"""Writing archives and exports, and the checks before they are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, url
from .curate import merge_archives
from .dedupe import unique_texts, upsert
from .select import cap_per_group

# Rows a day, the least rows of a tab, and the share that counts may fall to.
ROWS_A_DAY, LEAST_ROWS, LEAST_SHARE = 15, 100, 0.97


def archived(
    existing: DataFrame, incoming: DataFrame, tab: str = "tab", day: str = "day", snapshot: int | None = None, replace_days: bool = False,
    most: int = ROWS_A_DAY, unique: str | None = None, extras: tuple[str, ...] = ("title", "id"),
) -> DataFrame:
    """The archive after a write; both sides have tab, day, pos, id, url, title and further columns.

    Of the incoming rows the first ``snapshot`` of a tab count (by pos), those without an address go. With
    ``replace_days`` existing rows of a tab and day that the incoming ones have go as well. Rows are merged by canonical
    address and by title, incoming rows first (``curate.merge_archives``), and of each tab and day the first ``most``
    stay, incoming ones before existing ones. Texts of the column ``unique`` are then made unique, the oldest first.

    Edge cases: a null tab or day is a tab or day; rows that are equal in tab, side, pos and id count once; empty
    sides are allowed; existing rows without an address go; columns that one side lacks are null.
    """
    own = F.concat_ws(":", "_part", F.col("pos").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    has = F.trim(F.coalesce("url", F.lit(""))) != ""

    def side(df: DataFrame, part: int) -> DataFrame:
        return df.withColumn("_part", F.lit(part)).withColumn("_row", own)

    new = side(incoming, 0)
    if snapshot is not None:
        new = cap_per_group(new, tab, ["pos", "id"], snapshot)
    new, old = new.where(has), side(existing, 1).where(has)
    if replace_days:
        days = new.select(F.col(tab).alias("_t"), F.col(day).alias("_d")).distinct()
        old = old.join(days, F.col(tab).eqNullSafe(F.col("_t")) & F.col(day).eqNullSafe(F.col("_d")), "left_anti")
    keyed = lambda df: df.select(F.col(tab).alias("g"), F.col("pos").cast("long").alias("pos"), F.col("_row").alias("id"), url.canonical(F.col("url")).alias("url_key"), text.title_key(F.col("title")).alias("title_key"))
    kept = merge_archives(keyed(new), keyed(old), "g").select(F.col("g").alias("_g"), F.col("id").alias("_kept"))
    rows = new.unionByName(old, allowMissingColumns=True)
    rows = rows.join(kept, F.col(tab).eqNullSafe(F.col("_g")) & (F.col("_row") == F.col("_kept")), "left_semi").dropDuplicates([tab, "_row"])
    out = cap_per_group(rows, F.struct(tab, day), ["_part", "pos", "id"], most)
    if unique is not None:
        out = unique_texts(out, unique, [day, "_part", "pos", "_row"], list(extras))
    return out.drop("_part", "_row")


def latest_fields(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: of each field the last value by order that isn't null."""
    rest = [c for c in rows.columns if c != key]
    rows = rows.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order)).alias(c) for c in rest])


def upserted_history(history: DataFrame, found: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """History after a crawl, once a key: fields of found rows win where they aren't null.

    Rows of one key are reduced first on either side, field by field: the last by ``order`` that isn't null (without an
    order the greatest row). Rows without a key go; empty sides are allowed.
    """

    def one(df: DataFrame) -> DataFrame:
        return latest_fields(df, key, F.struct(*([order] if order else []), *[c for c in df.columns if c not in (key, order)]))

    return upsert(one(history), one(found), key)


def tab_report(items: DataFrame, tab: str, day: str, keep: Column, ident: str | None = None) -> DataFrame:
    """By tab: items, read and kept rows, days, latest day, the most rows of a day, and with an id column its faults.

    A null keep is an unread row; null days count as a day, but never as the latest.
    """
    report = [
        F.sum("n").alias("items"), F.sum("read").alias("read"), F.sum("kept").alias("kept"), F.count("*").alias("days"), F.max(day).alias("latest"), F.max("n").alias("busiest"),
    ]
    by_day = items.groupBy(tab, day).agg(F.count("*").alias("n"), F.count(keep).alias("read"), F.count_if(keep).alias("kept"))
    out = by_day.groupBy(tab).agg(*report)
    if ident is None:
        return out
    named = F.trim(F.coalesce(F.col(ident).cast("string"), F.lit("")))
    ids = items.groupBy(F.col(tab).alias("_t"), named.alias("i")).agg(F.count("*").alias("n"))
    faults = ids.groupBy("_t").agg(F.sum(F.when(F.col("i") == "", F.col("n")).otherwise(0)).alias("no_id"), F.count_if((F.col("i") != "") & (F.col("n") > 1)).alias("repeated_ids"))
    return out.join(faults, out[tab].eqNullSafe(faults["_t"]), "left").drop("_t")


def publish_guard(now: DataFrame, before: DataFrame, tab: str, allowed: int = 0, share: float = LEAST_SHARE, most: int = ROWS_A_DAY, least: int | None = None) -> DataFrame:
    """Reports (tab_report) of two states -> (tab, failures) for every tab of either state.

    A tab that vanished fails, a new one is only held against the bounds; counts that fell too far, a latest day that
    went back, too full days, too few rows (from ``least`` on), and empty or repeated ids where the report has them.
    """
    b = before.select(F.col(tab).alias("_t"), F.col("items").alias("items_before"), F.col("read").alias("read_before"), F.col("latest").alias("latest_before"))
    j = now.join(b, now[tab].eqNullSafe(b["_t"]), "full_outer").withColumn(tab, F.coalesce(F.col(tab), F.col("_t")))
    tests = [
        (F.col("items").isNull(), "tab vanished"),
        (F.col("items") < F.col("items_before") * share - allowed, "items dropped"),
        (F.col("read") < F.col("read_before") * share - allowed, "read dropped"),
        (F.col("latest") < F.col("latest_before"), "latest went back"),
        (F.col("busiest") > most, "day too full"),
    ]
    if least is not None:
        tests.append((F.col("items") < least, "too few items"))
    if "no_id" in now.columns:
        tests += [(F.col("no_id") > 0, "empty ids"), (F.col("repeated_ids") > 0, "repeated ids")]
    return j.select(tab, F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests])).alias("failures"))


def reads_dropped(now: DataFrame, before: DataFrame, allowed: int = 0, share: float = LEAST_SHARE) -> DataFrame:
    """One row: read rows of all tabs in both states, and whether they fell too far."""
    n, b = (df.agg(F.coalesce(F.sum("read"), F.lit(0)).alias(name)) for df, name in ((now, "read"), (before, "read_before")))
    return n.crossJoin(b).select("read", "read_before", (F.col("read") < F.col("read_before") * share - allowed).alias("dropped"))


def freshness(items: DataFrame, tabs: DataFrame, tab: str, day: str, today: Column, target: int = ROWS_A_DAY) -> DataFrame:
    """(tab, n, level) of each named tab: error without rows of today, warning below the target, else ok.

    Rows of null days and of tabs that aren't named don't count; repeated rows count each.
    """
    n = items.where(F.col(day) == today).groupBy(tab).agg(F.count("*").alias("n"))
    out = tabs.join(n, tab, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(tab, "n", F.when(F.col("n") == 0, "error").when(F.col("n") < target, "warning").otherwise("ok").alias("level"))


def new_defects(rows: DataFrame, snapshot: DataFrame, key: str, defects: Column) -> DataFrame:
    """Rows with defects that the snapshot doesn't hold yet: old rows are left alone."""
    return rows.withColumn("defects", defects).where(F.size("defects") > 0).join(snapshot.select(key), key, "left_anti")
