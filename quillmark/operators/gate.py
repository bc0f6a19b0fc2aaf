"""A quality gate: a table of assertions about rows of tabs, compiled into one scan and two aggregates.

``Check`` says what is asserted; ``gate`` gives a result row for each check of each tab, ``evidence`` the rows that break
one, ``failing_tabs`` the tabs that a failure message speaks of.

All checks share one scan. A row gives one entry a day, with a 0 or 1 for each check on rows, and one for each key that is
checked; the first aggregate adds up entries of a tab, key and kind of key (on the map side first, so neither a tab of a
third of all rows nor a key that most rows share is gathered in one task), the second reads counts, distinct keys and
highest counts from that. Checks on a tab's latest day read the sums of that day, so that they need no scan to find it.

Edge cases: a condition that is null does not hold; a key that is null or blank breaks ``unique`` and is no key for
``kinds`` and ``each``; rows of a null tab, or of one not named, are left out; a named tab without rows holds ``every``
and ``unique``, but no ``share``, and fails counts from 1 on; rows of a null day are never the latest; repeated rows count
each; an empty table gives the results of empty tabs; further columns are ignored by ``gate`` and kept by none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAILURE, WARNING = "failure", "warning"


@dataclass(frozen=True, eq=False)
class Check:
    """One assertion. Made by the functions below.

    kind: every (rows that don't hold), share (of rows that hold), rows (that hold), unique (rows whose key another has),
    each (highest count of a key), kinds (distinct keys). what: the condition, or the key. bound: observed <= it for every,
    unique and each, and for rows if ``at_most``; else observed >= it. where: only these rows. latest: only the latest day.
    tabs: only these tabs. level: failure or warning.
    """

    name: str
    kind: str
    what: Column
    bound: float = 0
    where: Column | None = None
    latest: bool = False
    at_most: bool = False
    tabs: tuple[str, ...] = ()
    level: str = FAILURE

    @property
    def upper(self) -> bool:
        return self.at_most or self.kind in ("every", "unique", "each")

    @property
    def keyed(self) -> bool:
        return self.kind in ("unique", "each", "kinds")


def every(name: str, holds: Column, **more) -> Check:
    return Check(name, "every", holds, **more)


def share(name: str, holds: Column, least: float, **more) -> Check:
    return Check(name, "share", holds, least, **more)


def at_least(name: str, least: float, holds: Column | None = None, **more) -> Check:
    return Check(name, "rows", F.lit(True) if holds is None else holds, least, **more)


def at_most(name: str, most: float, holds: Column | None = None, **more) -> Check:
    return Check(name, "rows", F.lit(True) if holds is None else holds, most, at_most=True, **more)


def unique(name: str, key: Column, **more) -> Check:
    return Check(name, "unique", key, **more)


def each(name: str, key: Column, most: float, **more) -> Check:
    return Check(name, "each", key, most, **more)


def kinds(name: str, key: Column, least: float, **more) -> Check:
    return Check(name, "kinds", key, least, **more)


def _holds(c: Check) -> Column:
    return F.coalesce(c.what.cast("boolean"), F.lit(False))


def _within(c: Check) -> Column:
    return F.lit(True) if c.where is None else F.coalesce(c.where, F.lit(False))


def _key(c: Check) -> Column:
    """The key as a text; null if blank."""
    text = c.what.cast("string")
    return F.when(F.trim(text) != "", text)


def _of(c: Check, tabs: list[str]) -> list[str]:
    return [t for t in tabs if not c.tabs or t in c.tabs]


def _free(name: str, items: DataFrame) -> str:
    """A column name that the items don't have."""
    taken = {c.lower() for c in items.columns}
    while name in taken:
        name += "_"
    return name


def _tested(checks: list[Check]) -> None:
    names = [c.name for c in checks]
    if len(set(names)) < len(names):
        raise ValueError("two checks of one name")
    for c in checks:
        if c.latest and c.keyed:
            raise ValueError(f"{c.name}: a check on keys takes all days; use where")


def measures(items: DataFrame, checks: list[Check], tab: str, day: str | None = None) -> DataFrame:
    """A row a tab: m<i>, what check i observed."""
    _tested(checks)
    plain = [(i, c) for i, c in enumerate(checks) if not c.keyed]
    keyed = [(i, c) for i, c in enumerate(checks) if c.keyed]
    flags: dict[str, Column] = {}
    for i, c in plain:
        flags[f"n{i}"] = _within(c)
        flags[f"y{i}"] = _within(c) & _holds(c)
    # facet -1 carries the flags a day; facet i the key of check i, with a mark for rows that have none
    own = F.struct(F.lit(-1).alias("facet"), (F.col(day).cast("string") if day else F.lit(None).cast("string")).alias("key"), F.lit(True).alias("in"))
    facets = [F.struct(F.lit(i).alias("facet"), _key(c).alias("key"), _within(c).alias("in")) for i, c in keyed]
    rows = items.where(F.col(tab).isNotNull()).select(
        F.col(tab).cast("string").alias("tab"), *[f.cast("long").alias(n) for n, f in flags.items()], F.explode(F.array(own, *facets)).alias("f")
    ).where("f.in")
    mine = F.col("f.facet") == -1
    first = rows.groupBy("tab", F.col("f.facet").alias("facet"), F.col("f.key").alias("key")).agg(F.count("*").alias("n"), *[F.sum(F.when(mine, F.col(n))).alias(n) for n in flags])
    of = lambda i: F.col("facet") == i
    own_day = of(-1) & F.col("key").isNotNull()
    out = []
    for i, c in plain:
        total = (lambda n: F.max_by(F.col(n), F.when(own_day, F.col("key")))) if c.latest else (lambda n: F.sum(F.when(of(-1), F.col(n))))
        n, y = F.coalesce(total(f"n{i}"), F.lit(0)), F.coalesce(total(f"y{i}"), F.lit(0))
        out.append({"every": n - y, "rows": y, "share": F.when(n > 0, y / n)}[c.kind].cast("double").alias(f"m{i}"))
    for i, c in keyed:
        named = of(i) & F.col("key").isNotNull()
        seen = {
            "unique": F.coalesce(F.sum(F.when(named, F.col("n") - 1).when(of(i), F.col("n"))), F.lit(0)),
            "each": F.coalesce(F.max(F.when(named, F.col("n"))), F.lit(0)),
            "kinds": F.count_if(named),
        }[c.kind]
        out.append(seen.cast("double").alias(f"m{i}"))
    return first.groupBy("tab").agg(*out)


def gate(items: DataFrame, checks: list[Check], tab: str, tabs: list[str], day: str | None = None) -> DataFrame:
    """(tab, check_id, level, observed, op, bound, ok) for each check of each named tab it is meant for."""
    spark = items.sparkSession
    named = spark.createDataFrame([(t,) for t in tabs], "tab string")
    wide = F.broadcast(named).join(measures(items, checks, tab, day), "tab", "left") if tabs else named.join(measures(items, checks, tab, day), "tab")
    empty = lambda c: F.lit(None).cast("double") if c.kind == "share" else F.lit(0.0)
    one = [
        F.when(
            F.col("tab").isin(_of(c, tabs)),
            F.struct(
                F.lit(c.name).alias("check_id"), F.lit(c.level).alias("level"), F.coalesce(F.col(f"m{i}"), empty(c)).alias("observed"),
                F.lit("<=" if c.upper else ">=").alias("op"), F.lit(float(c.bound)).alias("bound"),
            ),
        )
        for i, c in enumerate(checks)
    ]
    long = wide.select("tab", F.explode(F.array_compact(F.array(*one))).alias("c")).select("tab", "c.*")
    ok = F.when(F.col("op") == "<=", F.col("observed") <= F.col("bound")).otherwise(F.col("observed") >= F.col("bound"))
    return long.withColumn("ok", F.coalesce(ok, F.lit(False)))


def evidence(items: DataFrame, checks: list[Check], tab: str, tabs: list[str], ident: str, day: str | None = None) -> DataFrame:
    """(tab, check_id, id, key) of rows that break a check: every, unique (all rows of a repeated key or of none), and each.

    All such rows, not a sample: checks on rows need no shuffle; those on keys one aggregate and a join with the keys at
    fault. Checks on the latest day name its rows alone. Other kinds are about a tab as a whole and have no rows.
    """
    _tested(checks)
    own, end = _free("tab", items), _free("last", items)
    base = items.where(F.col(tab).isin(tabs)).withColumn(own, F.col(tab).cast("string"))
    if day and any(c.latest and c.kind == "every" for c in checks):
        last = base.groupBy(own).agg(F.max(F.col(day).cast("string")).alias(end))
        base = base.join(F.broadcast(last), own, "left")  # a row a named tab
    else:
        base = base.withColumn(end, F.lit(None).cast("string"))
    meant = lambda c: F.col(own).isin(_of(c, tabs))
    today = lambda c: F.coalesce(F.col(day).cast("string") == F.col(end), F.lit(False)) if c.latest else F.lit(True)
    broken = [F.when(meant(c) & today(c) & _within(c) & ~_holds(c), F.lit(c.name)) for c in checks if c.kind == "every"]
    ids = F.col(ident).alias("id")
    empty = items.sparkSession.createDataFrame([], T.StructType([T.StructField("tab", T.StringType()), T.StructField("check_id", T.StringType()), T.StructField("id", items.schema[ident].dataType), T.StructField("key", T.StringType())]))
    parts = [base.select(F.col(own).alias("tab"), F.explode(F.array_compact(F.array(*broken))).alias("check_id"), ids, F.lit(None).cast("string").alias("key"))] if broken else []
    facets = [F.when(meant(c) & _within(c), F.struct(F.lit(c.name).alias("check_id"), _key(c).alias("key"), F.lit(1.0 if c.kind == "unique" else float(c.bound)).alias("most"), F.lit(c.kind == "unique").alias("blank"))) for c in checks if c.kind in ("unique", "each")]
    if facets:
        keys = base.select(F.col(own).alias("tab"), ids, F.explode(F.array_compact(F.array(*facets))).alias("f")).select("tab", "id", "f.*")
        parts.append(keys.where("key IS NULL AND blank").select("tab", "check_id", "id", "key"))
        full = keys.where("key IS NOT NULL").groupBy("tab", "check_id", "key", "most").agg(F.count("*").alias("n")).where("n > most").select("tab", "check_id", "key")
        parts.append(keys.where("key IS NOT NULL").join(full, ["tab", "check_id", "key"], "left_semi").select("tab", "check_id", "id", "key"))
    out = empty
    for p in parts:
        out = out.unionByName(p)
    return out


def failing_tabs(messages: DataFrame, message: str, patterns: list[tuple[str, str]], rest: str = "global") -> DataFrame:
    """(tab, failures): how many messages speak of each tab, by the first (tab, pattern) that matches, else of ``rest``."""
    said = F.coalesce(F.col(message), F.lit(""))
    first = F.coalesce(*[F.when(said.rlike(p), F.lit(t)) for t, p in patterns], F.lit(rest))
    return messages.groupBy(first.alias("tab")).agg(F.count("*").alias("failures"))
