"""The daily update: today's rows of several tabs, each out of its archive and of what was found, in batches.

Rows of archives and of what was found have tab, day, pos, id (one row an id on either side), source, title_key, keys
(identity keys), words (of titles) and further columns. The driver sees counts only; what it loops over are at most
``4 * max(target, remaining)`` rows a tab, the reserve.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .publish import ROWS_A_DAY
from .rounds import written
from .select import cap_per_group, select_novel

# The reserve as a multiple of the target, and the most rows of a batch where fewer are asked for.
RESERVE, BATCH = 4, 20


@dataclass(frozen=True)
class Tab:
    """A tab's rules: rows a source (and in a second pass), likeness of titles that are one, what makes rows ready to
    be shown, and which rows may be shown (null: not)."""

    name: str
    per_source: int
    loose_per_source: int
    similarity: float = 0.82
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows
    valid: Column | None = None


@dataclass(frozen=True)
class Update:
    """Today's rows (part ``existing`` or ``added``, and their rank), the archive after the write, and a report by tab."""

    items: DataFrame
    archive: DataFrame
    report: DataFrame


def _all_keys() -> Column:
    title = F.coalesce("title_key", F.lit(""))
    return F.array_distinct(F.concat(F.array_compact(F.coalesce("keys", F.array().cast("array<string>"))), F.when(title != "", F.array(F.concat(F.lit("title:"), title))).otherwise(F.array().cast("array<string>"))))


def unseen(found: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of found that share no identity key and no title with any row of history.

    History is large and found small: keys of history that found lacks are dropped before they are made distinct, so
    that no key of history is paired with rows, however often it stands there.
    """
    mine = found.select(F.col("id").alias("_id"), F.explode(_all_keys()).alias("k"))
    used = history.select(F.explode(_all_keys()).alias("k")).join(mine.select("k").distinct(), "k", "left_semi").distinct()
    late = mine.join(used, "k", "left_semi").select("_id").distinct()
    return found.join(late, F.col("id") == F.col("_id"), "left_anti")


def _chosen(rows: DataFrame, tab: Tab, limit: int, seeds: DataFrame | None = None) -> DataFrame:
    placed = rows.withColumn("pos", F.coalesce(F.col("pos").cast("long"), F.lit(2**62)))
    picks = select_novel(placed, limit, tab.per_source, tab.similarity, loose_per_source=tab.loose_per_source, seeds=seeds)
    picks = picks.select(F.col("id").alias("_id"), F.col("rank").alias("_rank"))
    rows = cap_per_group(rows.drop("rank").join(F.broadcast(picks), F.col("id") == F.col("_id")), "_id", ["pos"], 1)
    return written(rows.withColumnRenamed("_rank", "rank").drop("_id"))


def update_tab(archive: DataFrame, found: DataFrame, others: DataFrame, tab: Tab, today: str, target: int = ROWS_A_DAY) -> tuple[DataFrame, dict]:
    """(today's rows with part and rank, counts) of one tab.

    Valid rows that the archive has of today stay, as far as they differ from each other. For what is missing, rows of
    found that neither the archive's other days nor ``others`` (rows of other tabs, of any day) have are chosen as a
    reserve; it is made ready batch by batch, and chosen from again as it then is, until the target is reached.

    Edge cases: rows of a null day are of another day, those without a place (pos) come last; rows without keys or
    without an id are never chosen, of rows of one id one is; nothing is read of found if the archive has the target
    already; empty tables give the rows there are; columns named rank or part are replaced.
    """
    valid = F.lit(True) if tab.valid is None else F.coalesce(tab.valid, F.lit(False))
    of_today = F.coalesce(F.col("day") == today, F.lit(False))
    existing = _chosen(archive.where(of_today & valid & F.col("id").isNotNull()), tab, target)
    n = existing.count()
    remaining = target - n
    counts = {"tab": tab.name, "candidates": 0, "prepared": 0, "batches": 0, "existing": n, "added": 0, "skipped": remaining <= 0}
    items = existing.withColumn("part", F.lit("existing"))
    if remaining <= 0:
        return items, counts
    history = archive.where(~of_today).select("title_key", "keys").unionByName(others.select("title_key", "keys"))
    reserve = _chosen(unseen(found.where(F.col("id").isNotNull()), history), tab, RESERVE * max(remaining, target), existing)
    counts["candidates"] = reserve.count()
    size, ready, added = max(remaining, min(target, BATCH)), None, None
    while counts["batches"] * size < counts["candidates"] and counts["added"] < remaining:
        start = counts["batches"] * size
        batch = reserve.where((F.col("rank") > start) & (F.col("rank") <= start + size)).withColumn("pos", F.col("rank"))
        batch = written(tab.prepare(batch).where(valid))
        ready = batch if ready is None else ready.unionByName(batch)
        added = _chosen(unseen(ready, history), tab, remaining, existing)
        counts |= {"batches": counts["batches"] + 1, "prepared": counts["prepared"] + batch.count(), "added": added.count()}
    if counts["added"]:
        items = items.unionByName(added.withColumn("rank", F.col("rank") + n).withColumn("part", F.lit("added")), allowMissingColumns=True)
    return items, counts


def daily_update(archives: DataFrame, found: DataFrame, tabs: list[Tab], today: str, target: int = ROWS_A_DAY) -> Update:
    """One update of all tabs, in the order given: no row that a tab's archive or today's rows have comes to a later tab.

    A tab that got new rows has its rows of today replaced by the chosen ones; the archive of other tabs stays. Rows of
    tabs that aren't named are history to all. Report: tab, candidates, prepared, batches, existing, added, archived,
    skipped, archive_before.
    """
    columns, now, items, report = archives.columns, archives, None, []
    for tab in tabs:
        own = F.coalesce(F.col("tab") == tab.name, F.lit(False))
        mine, others = now.where(own), now.where(~own)
        rows, counts = update_tab(mine, found.where(own), others, tab, today, target)
        rows = rows.withColumn("tab", F.lit(tab.name)).withColumn("day", F.lit(today))
        items = rows if items is None else items.unionByName(rows, allowMissingColumns=True)
        if counts["added"]:
            old = now.where(~(own & F.coalesce(F.col("day") == today, F.lit(False))))
            now = old.unionByName(rows.select(*[c for c in rows.columns if c in columns]), allowMissingColumns=True)
        report.append((*counts.values(), counts["existing"] + counts["added"], archives.where(own).count()))
    names = "tab string, candidates long, prepared long, batches long, existing long, added long, skipped boolean, archived long, archive_before long"
    return Update(items, now, archives.sparkSession.createDataFrame(report, names))


def publish_policy(report: DataFrame, target: int = ROWS_A_DAY) -> DataFrame:
    """One row: tabs, tabs short of the target, rows of today, and what the first and the recovery pass do.

    All tabs complete: publish. Else the first pass fails, so that a recovery follows; that one publishes what there is,
    or fails if no tab has a row of today. A report without tabs is complete.
    """
    r = report.agg(F.count("*").alias("tabs"), F.count_if(F.col("archived") < target).alias("short"), F.coalesce(F.sum("archived"), F.lit(0)).alias("rows"))
    first = F.when(F.col("short") == 0, "publish").otherwise("fail")
    second = F.when(F.col("short") == 0, "publish").when(F.col("rows") > 0, "partial").otherwise("fail")
    return r.select("*", first.alias("first_pass"), second.alias("recovery_pass"))
