"""The quality gate against a plain loop over rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import gate

TABS = ["a", "b", "none"]
SCHEMA = "id long, tab string, day string, url string, score int, img boolean, check_id string, last string"


def _rows(seed, n=120):
    r = random.Random(seed)
    one = lambda i: (r.choice([i, i, None]), r.choice(["a", "b", "c", None]), r.choice(["d1", "d2", "d3", None]), r.choice(["", " ", None, "u1", "u2", f"v{i}"]), r.choice([None, 1, 5, 9]), r.choice([True, False, None]), "x", "y")
    return [one(i) for i in range(n)]


def checks():
    return [
        gate.every("score", F.col("score") >= 5),
        gate.every("late", F.col("score") >= 5, latest=True),
        gate.every("only", F.col("img"), where=F.col("score") == 9, tabs=("a",)),
        gate.share("share", F.col("img"), 0.3),
        gate.at_least("few", 1),
        gate.at_most("many", 3, F.col("img"), latest=True, level=gate.WARNING),
        gate.unique("url", F.col("url")),
        gate.each("day", F.col("day"), 8),
        gate.kinds("kinds", F.col("url"), 4, where=F.col("img")),
    ]


def _plain(rows, tab):
    mine = [r for r in rows if r[1] == tab]
    days = [r[2] for r in mine if r[2] is not None]
    late = [r for r in mine if days and r[2] == max(days)]
    key = lambda r: r[3] if r[3] and r[3].strip() else None
    keys = [key(r) for r in mine]
    img = [r for r in mine if r[5]]
    found = {
        "score": sum(not (r[4] or 0) >= 5 for r in mine),
        "late": sum(not (r[4] or 0) >= 5 for r in late),
        "share": sum(bool(r[5]) for r in mine) / len(mine) if mine else None,
        "few": len(mine),
        "many": sum(bool(r[5]) for r in late),
        "url": len(keys) - len({k for k in keys if k is not None}),
        "day": max((days.count(d) for d in days), default=0),
        "kinds": len({key(r) for r in img} - {None}),
    }
    if tab == "a":
        found["only"] = sum(not r[5] for r in mine if r[4] == 9)
    broken = [("score", r[0], None) for r in mine if not (r[4] or 0) >= 5] + [("late", r[0], None) for r in late if not (r[4] or 0) >= 5]
    broken += [("only", r[0], None) for r in mine if tab == "a" and r[4] == 9 and not r[5]]
    broken += [("url", r[0], k) for r, k in zip(mine, keys) if k is None or keys.count(k) > 1]
    broken += [("day", r[0], r[2]) for r in mine if r[2] and days.count(r[2]) > 8]
    return found, broken


@pytest.mark.parametrize("seed", range(4))
def test_gate_as_a_plain_loop(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.tab, r.check_id): r for r in gate.gate(df, checks(), "tab", TABS, "day").collect()}
    named = {c.name: c for c in checks()}
    said = lambda x: tuple(str(v) for v in x)
    want_rows, want = [], {}
    for tab in TABS:
        found, broken = _plain(rows, tab)
        want |= {(tab, n): v for n, v in found.items()}
        want_rows += [said((tab, *b)) for b in broken]
    assert got.keys() == want.keys()
    for k, v in want.items():
        c = named[k[1]]
        assert got[k].observed == (None if v is None else pytest.approx(v)), k
        assert got[k].ok == (v is not None and (v <= c.bound if c.upper else v >= c.bound)), k
        assert got[k].level == c.level
    seen = gate.evidence(df, checks(), "tab", TABS, "id", "day").collect()
    assert sorted(said(r) for r in seen) == sorted(want_rows)


def test_gate_of_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = {(r.tab, r.check_id): r.ok for r in gate.gate(df, checks(), "tab", ["a"], "day").collect()}
    assert got == {("a", c.name): c.name not in ("share", "few", "kinds") for c in checks()}
    assert gate.evidence(df, checks(), "tab", ["a"], "id", "day").count() == 0
    assert gate.gate(df, checks(), "tab", [], "day").count() == 0


def test_gate_is_one_scan(spark, sf):
    from quillmark.plans import gates

    plan = gates.quality_gate(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("n_chars") <= 1 and plan.count("Relation") == 2  # documents and labels, once each


def test_checks_that_contradict(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        gate.gate(df, [gate.kinds("k", F.col("url"), 1, latest=True)], "tab", ["a"], "day")
    with pytest.raises(ValueError):
        gate.gate(df, [gate.at_least("k", 1), gate.at_least("k", 2)], "tab", ["a"])


def test_failing_tabs(spark):
    df = spark.createDataFrame([("Korean Code has x",), ("cinema y",), ("Korean z",), (None,), ("else",)], "m string")
    got = gate.failing_tabs(df, "m", [("korean", "(?i)korean"), ("cinema", "(?i)cinema")]).collect()
    assert {r.tab: r.failures for r in got} == {"korean": 2, "cinema": 1, "global": 2}
