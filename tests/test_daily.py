"""The daily update against plain loops over rows in order."""

import random

from pyspark.sql import functions as F

from quillmark.operators import daily

COLUMNS = "tab string, day string, pos long, id long, source string, title_key string, keys array<string>, words array<string>, good boolean"
TODAY = "d9"


def novel(rows, history, limit, caps, similarity, seeds=()):
    used = {k for x in history for k in x[6]} | {("t", x[5]) for x in history if x[5]}
    chosen = []
    for cap in sorted(set(caps)):
        for x in sorted(rows, key=lambda x: (x[2], x[3])):
            mine, before = set(x[6]) | ({("t", x[5])} if x[5] else set()), [*seeds, *chosen]
            near = any(len(set(x[7]) & set(c[7])) >= max(3, similarity * min(len(set(x[7])), len(set(c[7])))) for c in before)
            taken = {k for c in before for k in c[6]} | {("t", c[5]) for c in before if c[5]}
            if len(chosen) < limit and x[6] and not mine & (used | taken) and not near and sum(c[4] == x[4] for c in before) < cap:
                chosen.append(x)
    return chosen


def plain(archives, found, tabs, target, prepare):
    now, items, report = list(archives), [], []
    for name, few, more, like in tabs:
        mine, others = [x for x in now if x[0] == name], [x for x in now if x[0] != name]
        existing = novel([x for x in mine if x[1] == TODAY and x[8]], [], target, (few, more), like)
        left, added, ready, batches, reserve = target - len(existing), [], [], 0, []
        if left > 0:
            history = [x for x in mine if x[1] != TODAY] + others
            reserve = novel([x for x in found if x[0] == name], history, 4 * max(left, target), (few, more), like, existing)
            size = max(left, min(target, 20))
            while batches * size < len(reserve) and len(added) < left:
                part = [(*x[:2], batches * size + i, *x[3:]) for i, x in enumerate(reserve[batches * size : (batches + 1) * size])]
                ready += [y for y in map(prepare, part) if y[8]]
                batches += 1
                added = novel(ready, history, left, (few, more), like, existing)
        items += [(name, p, i + 1, x[3]) for i, (p, x) in enumerate([("existing", x) for x in existing] + [("added", x) for x in added])]
        if added:
            now = [x for x in now if x[0] != name or x[1] != TODAY] + existing + [(name, TODAY, *x[2:]) for x in added]
        report.append((name, len(reserve), len(ready), batches, len(existing), len(added), left <= 0))
    return items, report, now


def test_daily_update_as_plain_loops(spark):
    r = random.Random(11)

    def row(i, days):
        tab = r.choice(["a", "b", "c"])
        return (tab, r.choice(days), r.randrange(200), i, r.choice(["s1", "s2", "s3", "s4", None]), r.choice(["", *map(str, range(400))]),
                [f"k{r.randrange(500)}" for _ in range(r.choice([0, 1, 1, 2]))], [r.choice("abcdefghijklmnop") for _ in range(r.randrange(6))], r.random() < 0.5)

    archives = [row(i, ["d1", "d2", TODAY, None]) for i in range(90)]
    archives += [("c", TODAY, 500 + i, 900 + i, f"x{i}", f"own {i}", [f"own{i}"], [], True) for i in range(12)]
    found = [row(1000 + i, [TODAY]) for i in range(120)]

    def prepare(x):
        return (*x[:5], x[5][:2], *x[6:])

    def prepared(df):
        return df.withColumn("title_key", F.left("title_key", F.lit(2)))

    policies = [("a", 2, 4, 0.6), ("b", 1, 1, 0.8), ("c", 3, 5, 0.8)]
    tabs = [daily.Tab(*p, prepared, F.col("good")) for p in policies]
    got = daily.daily_update(spark.createDataFrame(archives, COLUMNS), spark.createDataFrame(found, COLUMNS), tabs, TODAY, 8)
    items, report, now = plain(archives, found, policies, 8, prepare)
    assert sorted((x.tab, x.part, x["rank"], x.id) for x in got.items.collect()) == sorted(items)
    assert [tuple(x)[:7] for x in got.report.collect()] == report
    assert {x[6] for x in report} == {True, False} and max(x[3] for x in report) > 1
    assert sorted((x.tab, x.id) for x in got.archive.collect()) == sorted((x[0], x[3]) for x in now)
    policy = daily.publish_policy(got.report, 8).first()
    short = sum(x[4] + x[5] < 8 for x in report)
    assert (policy.tabs, policy.short) == (3, short) and policy.first_pass == ("fail" if short else "publish")


def test_daily_update_edges(spark):
    """Nulls in every column, repeated rows, empty tables, columns of other names on either side."""
    none = spark.createDataFrame([], COLUMNS)
    odd = [("a", None, None, 1, None, None, ["k"], None, None), ("a", TODAY, 1, 2, None, None, None, None, True), ("a", TODAY, 1, 3, None, None, ["k"], None, True),
           ("a", TODAY, 1, 3, None, None, ["k"], None, True), ("a", TODAY, 0, None, "s", "t", ["n"], [], True), (None, TODAY, 0, 5, "s", "t", ["z"], [], True)]
    df, tabs = spark.createDataFrame(odd, COLUMNS), [daily.Tab("a", 3, 3)]
    assert daily.daily_update(none, none, tabs, TODAY, 3).items.count() == 0
    got = daily.daily_update(none, df.withColumn("rank", F.lit("x")).withColumn("part", F.lit(1)).withColumn("extra", F.lit(1)), tabs, TODAY, 3).items.collect()
    assert [x.id for x in got] == [3]  # the first by place that has keys; the row without a place shares its key
    assert daily.daily_update(df, none, tabs, TODAY, 3).items.select("id").collect()[0].id == 3
    assert daily.publish_policy(daily.daily_update(df, none, tabs, TODAY, 3).report, 3).first().recovery_pass == "partial"
