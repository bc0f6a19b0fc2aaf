"""Selection: caps, round-robin, interleaving, and the greedy selections over bounded candidate lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import written


def cap_per_group(df: DataFrame, group: Column | str, order: list, most: int) -> DataFrame:
    """The first rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def capped_top(df: DataFrame, group: Column | str, order: list, per_group: int, limit: int) -> DataFrame:
    """The first rows of each group, then the first of all."""
    return cap_per_group(df, group, order, per_group).orderBy(*order).limit(limit)


def round_robin(df: DataFrame, group: str, pos: str, limit: int) -> DataFrame:
    """First rows of all groups in order of first appearance, then second rows, and so on.

    Only the first ``limit`` rows of a group can be taken, and only groups that appear among the first ``limit``
    of all groups, so the last sort is over a bounded list.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(pos))
    turns = df.withColumn("turn", turn).where(F.col("turn") <= limit)
    starts = turns.where("turn = 1").select(group, F.col(pos).alias("start"))
    return turns.join(starts, group).orderBy("turn", "start").limit(limit).select(*df.columns, "start")


def interleave(two: DataFrame, one: DataFrame, pos: str, limit: int) -> DataFrame:
    """Two rows of the first list, one of the second, in turn; each list in order of pos."""
    a = two.orderBy(pos).limit(limit).withColumn("_n", F.row_number().over(Window.orderBy(pos)))
    b = one.orderBy(pos).limit(limit).withColumn("_n", F.row_number().over(Window.orderBy(pos)))
    a = a.withColumn("turn", F.floor((F.col("_n") - 1) / 2)).withColumn("list", F.lit(0))
    b = b.withColumn("turn", F.col("_n") - 1).withColumn("list", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).orderBy("turn", "list", "_n").limit(limit)


def select_novel(candidates: DataFrame, limit: int, per_source: int, similarity: float = 0.82, loose_per_source: int | None = None, group: str = "tab", seeds: DataFrame | None = None) -> DataFrame:
    """Greedy selection a group: skip rows that share an identity key or title with a chosen one, whose source is
    full, or whose title is too like a chosen one; a second pass has a looser cap.

    candidates: group, pos, id, source, title_key, keys (array), words (array); ties of pos go by id. Rows that
    archives hold are taken out before by anti-joins (dedupe.any_key_anti). Works in rounds: Spark drops all rows that
    clash with what was chosen so far (at most ``limit`` rows a group), and a task a group settles the next
    ``8 * limit`` of the others in order. The first of them clashes with nothing, so each round chooses a row of
    every group that isn't through. Rows without keys are never chosen; null groups and sources are groups and sources.
    seeds, a bounded list with the columns of candidates, count as chosen before, but not against the limit.
    """
    none = F.array().cast("array<string>")

    def compared(df: DataFrame) -> DataFrame:
        return df.select(
            F.col(group).alias("tab"), "pos", F.col("id").cast("long").alias("id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("source"),
            F.coalesce("title_key", F.lit("")).alias("title"), F.array_compact(F.coalesce(F.col("keys").cast("array<string>"), none)).alias("keys"),
            F.array_distinct(F.array_compact(F.coalesce(F.col("words").cast("array<string>"), none))).alias("words"),
        )

    rows = written(compared(candidates).where(F.size("keys") > 0))

    def like(w: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("words"), w))
        return (shared >= 3) & (shared / F.least(F.size("words"), F.size(w)) >= similarity)

    def still_open(chosen: DataFrame | None, cap: int) -> DataFrame:
        """Rows that could be chosen next, with how many of their group and source were chosen."""
        if chosen is None:
            return rows.withColumns({"n": F.lit(0).cast("long"), "of_source": F.lit(0)})
        state = chosen.groupBy(F.col("tab").alias("of")).agg(
            F.count_if(F.col("rank") > 0).alias("n"), F.flatten(F.collect_list("keys")).alias("used"), F.collect_list("title").alias("titles"),
            F.collect_list("words").alias("compared"), F.collect_list("source").alias("sources"),
        )
        d = rows.join(state, F.col("tab").eqNullSafe(F.col("of")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
        of_source = F.size(F.filter(F.coalesce("sources", none), lambda x: x == F.col("source")))
        clash = F.arrays_overlap("keys", "used") | (F.col("title") != "") & F.array_contains("titles", F.col("title")) | F.exists("compared", like)
        d = d.where(F.coalesce(~clash, F.lit(True)) & (F.col("n") < limit)).withColumn("of_source", of_source)
        return d.where(F.col("of_source") < cap).select(*rows.columns, "n", "of_source")

    def choose(cap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def settle(frame: pd.DataFrame) -> pd.DataFrame:
            chosen, used, titles, of_source = [], set(), set(), {}
            for r in frame.sort_values(["pos", "id"]).itertuples():
                if r.n + len(chosen) >= limit:
                    break
                words, in_source = set(r.words), of_source.get(r.source, r.of_source)
                if used.intersection(r.keys) or r.title and r.title in titles or in_source >= cap:
                    continue
                shared = ((len(words.intersection(c[6])), min(len(words), len(c[6]))) for c in chosen)
                if any(n >= 3 and n / m >= similarity for n, m in shared):
                    continue
                chosen.append((r.tab, r.id, r.n + len(chosen) + 1, r.source, r.title, r.keys, r.words))
                used.update(r.keys)
                titles.add(r.title)
                of_source[r.source] = in_source + 1
            out = pd.DataFrame(chosen, columns=["tab", "id", "rank", "source", "title", "keys", "words"])
            return out.assign(more=len(frame) >= 8 * limit and len(chosen) > 0 and chosen[-1][2] < limit)

        return settle

    kind = rows.schema["tab"].dataType.simpleString()
    chosen = None if seeds is None else compared(seeds).select("tab", "id", F.lit(0).cast("long").alias("rank"), "source", "title", "keys", "words")
    for cap in sorted({per_source, max(per_source, per_source if loose_per_source is None else loose_per_source)}):
        while True:
            block = cap_per_group(still_open(chosen, cap), "tab", ["pos", "id"], 8 * limit)
            schema = f"tab {kind}, id long, rank long, source string, title string, keys array<string>, words array<string>, more boolean"
            new = written(block.groupBy("tab").applyInPandas(choose(cap), schema))
            chosen = new.drop("more") if chosen is None else chosen.unionByName(new.drop("more"))
            if new.where("more").isEmpty():  # the blocks held all open rows of their groups
                break
    return chosen.where(F.col("rank") > 0).select(F.col("tab").alias(group), "id", "rank")


def select_balanced(items: DataFrame, lanes: list[str], limit: int, per_source: int) -> DataFrame:
    """Round-robin over lanes in a fixed order with a cap a source, then the first rows whatever their source.

    items: lane, pos, id, source. The choice itself is one task over a bounded list: rows past the first ``limit`` of
    a (lane, source) can't be taken in either pass; of the rest a lane passes over at most ``limit`` rows of each of
    the ``limit // per_source`` sources that can be full, and takes ``limit`` at most.
    """
    short = cap_per_group(items, F.struct("lane", "source"), ["pos"], limit)
    short = cap_per_group(short, "lane", ["pos"], limit + limit * (limit // per_source))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("pos")
        queues = {lane: rows[rows.lane == lane].to_dict("records") for lane in lanes}
        chosen, seen, of_source = [], set(), {}

        def take(r: dict, cap: float) -> bool:
            if r["id"] in seen or of_source.get(r["source"], 0) >= cap:
                return False
            seen.add(r["id"])
            of_source[r["source"]] = of_source.get(r["source"], 0) + 1
            chosen.append((r["id"], len(chosen) + 1))
            return True

        moved = True
        while moved and len(chosen) < limit:
            moved = False
            for lane in lanes:
                while queues[lane]:
                    if take(queues[lane].pop(0), per_source):
                        moved = True
                        break
                if len(chosen) >= limit:
                    break
        for r in rows.to_dict("records"):
            if len(chosen) >= limit:
                break
            take(r, float("inf"))
        yield pd.DataFrame(chosen, columns=["id", "rank"])

    return short.coalesce(1).mapInPandas(choose, "id long, rank long")
