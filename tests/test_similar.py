"""Similar titles: rows with equal token sets are paired as classes."""

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillmark.operators import similar
from quillmark.plans import registry


def _titles(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    w = F.when(F.col("id") < 1200, words("red", "blue", "green")).when(F.col("id") < 1203, words("red", "blue", "green", "grey")).otherwise(words("one", "two"))
    return spark.range(1210).select("id", F.lit("s").alias("source"), w.alias("w"))


def test_copies_are_paired_without_moving_the_pairs(spark):
    moved = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    got = similar.similar_titles(_titles(spark), "id", "w").agg(F.count("*"), F.countDistinct("a", "b"), F.count_if(F.col("a") < F.col("b")), F.min("similarity")).first()
    pairs = 1203 * 1202 // 2
    assert tuple(got) == (pairs, pairs, pairs, 1.0)
    shared = similar.sharing_tokens(_titles(spark), "id", "source", "w", 3).groupBy("shared").count().collect()
    assert sorted(map(tuple, shared)) == [(3, pairs - 3), (4, 3)]
    plan = similar.similar_titles(_titles(spark), "id", "w")
    before = moved()
    plan.write.format("noop").mode("overwrite").save()
    assert moved() - before < 500_000


def test_repeated_and_missing_ids(spark):
    rows = [(1, "s", ["a", "b", "c"]), (1, "s", ["a", "b", "c", "d"]), (2, "s", ["a", "b", "c"]), (None, "s", ["a", "b", "c"]), (3, None, ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "id long, source string, w array<string>")
    assert {(r.a, r.b) for r in similar.similar_titles(df, "id", "w").collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.a, r.b) for r in similar.sharing_tokens(df, "id", "source", "w", 3).collect()} == {(1, 2)}


def _by_loop(vectors, queries, k):
    out = set()
    for q, qv in queries:
        scores = []
        for n, v in vectors:
            if n != q:
                s = 0.0
                for x, y in zip(qv, v, strict=False):
                    s += 0.0 if x is None or y is None else x * y
                scores.append((-s, n))
        out |= {(q, n, -s) for s, n in sorted(scores)[:k]}
    return out


def test_nearest_vectors_as_a_plain_loop(spark):
    import random

    r = random.Random(4)
    kinds = [[r.gauss(0, 1) for _ in range(7)] for _ in range(60)]
    data = [(i, list(r.choice(kinds[:3]) if i % 2 else r.choice(kinds))) for i in range(3000)]
    data[5] = (5, data[5][1][:4])
    data[7] = (7, [None, *data[7][1][1:]])
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    asked = [x for x in data if x[0] % 100 in (0, 5)]
    got = similar.nearest(df, df.where("vec_id % 100 IN (0, 5)"), 5, block=7)
    assert {tuple(x) for x in got.collect()} == _by_loop(data, asked, 5)
    assert similar.nearest(df, df.limit(0), 5).count() == 0 and similar.nearest(df.limit(0), df, 5).count() == 0


def test_nearest_multiplies_in_tasks_of_arrays(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id int, embedding array<double>")
    found = similar.nearest(df, df.where("vec_id < 5"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and found.schema["query"].dataType.simpleString() == "int"


def test_pairs_of_one_group_are_not_moved(spark):
    moved = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    w = F.array(*[F.lit(x) for x in ("red", "blue", "green")], F.col("id").cast("string"))
    plan = similar.sharing_tokens(spark.range(1500).select("id", F.lit("s").alias("source"), w.alias("w")), "id", "source", "w", 3)
    before = moved()
    assert plan.count() == 1500 * 1499 // 2
    assert moved() - before < 1_500_000


def test_tokens_of_many_rows_meet_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(similar, "_BLOCK", 9)
    monkeypatch.setattr(similar, "_CHUNK", 2)
    r = random.Random(8)
    data = [(i, r.choice("xyz"), [r.choice("abcdefgh") for _ in range(r.randint(0, 7))]) for i in range(150)]
    got = similar.sharing_tokens(spark.createDataFrame(data, "id long, source string, w array<string>"), "id", "source", "w", 3).collect()
    want = []
    for a, s, u in data:
        for b, t, v in data:
            if a < b and s == t and len(set(u) & set(v)) >= 3:
                want.append((a, b, len(set(u) & set(v)), len(set(u) & set(v)) / min(len(set(u)), len(set(v)))))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["fn28_title_overlap", "jn13_similar_titles"])
def test_years_are_tokens_of_titles_as_in_the_sql(spark, tmp_path, name):
    titles = ["Alpha beta 1999", "alpha BETA 1999 gamma", "Call 555-2058 alpha now", "call 555-2058", "2024 2025 2026", "2026 2025 2024", "x2024 alpha beta"]
    docs = [(i, t + "\nbody", "en", "s", len(t) + 5) for i, t in enumerate(titles)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = rows(con.execute(registry.oracle_sql()[name]).fetchdf())
    assert len(want[1]) == 3 and rows(registry.queries()[name](spark, str(tmp_path)).toPandas()) == want
