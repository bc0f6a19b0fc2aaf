"""Repeats: what bitmaps keep out of shuffles, texts read together, and blocks against counted windows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import repeats


def test_marks_rule_out_most_other_keys(spark):
    of = repeats.marks(spark.range(4000).select(F.col("id").alias("k")), "k")
    told = repeats.marked(spark.range(100_000).select(F.col("id").alias("k")), of, "k")
    assert told.where("k < 4000 AND may").count() == 4000
    assert told.where("k >= 4000 AND may").count() < 96_000 / 6
    assert repeats.marked(spark.range(9).select(F.col("id").alias("k")), repeats.marks(spark.range(0).select(F.col("id").alias("k")), "k"), "k").where("may").count() == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 28])
def test_shuffled_places_leave_all_rows(spark, bits, monkeypatch):
    """Tables of places that are too large to broadcast: the same rows, with few and with many bits."""
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(repeats, "MOST_BITS", bits)
    r = random.Random(4)
    said = ["".join(r.choice("abcdefgh ") for _ in range(260)) for _ in range(6)]
    texts = [None, "", said[0], said[0], said[1] + said[2], said[2] + "x" + said[1][:210], said[3] * 2, said[4], said[5][:199], said[5][:199]]
    texts += ["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(40)]
    counts = Counter(t[i : i + 200] for t in texts if t for i in range(len(t) - 199))
    want = []
    for i, t in enumerate(texts):
        gone = {k for j in range(len(t or "") - 199) if counts[t[j : j + 200]] > 1 for k in range(j, j + 200)}
        want.append((i, len(t or ""), "".join(c for k, c in enumerate(t or "") if k not in gone).encode()))
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    assert sorted((x.doc_id, x.n_bytes, bytes(x.kept)) for x in got) == want


def test_segments_of_texts_together(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("abc ") for _ in range(n)).encode() for n in (0, 36, 500, 35, 37, 2000, 0, 71, 36, 1200)] + [b"a" * 300, b"ab" * 90, b"a" * 36]
    alone = [(i, *row) for i, t in enumerate(texts) for row in zip(*(c.tolist() for c in repeats.segments(np.frombuffer(t, np.uint8), 36)), strict=True)]
    for together in (1, 600, 1 << 16):
        monkeypatch.setattr(repeats, "_TOGETHER", together)
        g, s, i, lo, hi = (c.tolist() for c in repeats.all_segments(texts, 36))
        assert list(zip(i, g, s, lo, hi, strict=True)) == alone
    for i, t in enumerate(texts):
        windows = [w for j, _, _, lo, hi in alone if j == i for w in range(lo, hi + 1)]
        assert windows == list(range(len(t) - 35))


def test_blocks_of_short_alphabets_and_zero_bytes():
    r = np.random.default_rng(6)
    for letters in (1, 2, 3):
        block = [bytes(r.integers(0, letters, int(n)).astype(np.uint8)) for n in r.integers(34, 120, 12)]
        block += [block[0], block[1] + block[2]]
        c = Counter(t[i : i + 34] for t in block for i in range(len(t) - 33))
        for t, flags in zip(block, repeats.repeated_starts(block, 34), strict=True):
            assert flags.tolist() == [c[t[i : i + 34]] > 1 for i in range(len(t) - 33)]


def test_texts_become_objects_in_slices(monkeypatch):
    """However many texts an Arrow batch has, a slice has a bounded number of their bytes; nothing is lost or reordered."""
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1000)
    texts = ["", None, *("x" * n for n in (400, 500, 100, 1, 3000, 999)), "\u00e9" * 300, *["y" * 10] * 250, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    got = list(repeats.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 4)]), 1))
    assert [x for part in got for x in part.column(0).to_pylist()] == [*range(len(texts)), 3, 4, 5, 6]
    assert [x for part in got for x in part.column(1).to_pylist()] == texts + texts[3:7]
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part.column(1).to_pylist()) <= 1000 for part in got)


def test_only_grams_that_occur_twice_are_written(spark, monkeypatch):
    """What is written of a corpus with hardly any repeats is a small share of its segments; gram counts are of all of them."""
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(900)) for _ in range(60)]
    texts.append(texts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", F.xxhash64("text")).repartition(3)
    want = Counter(g for t in texts for g in repeats.segments(np.frombuffer(t.encode(), np.uint8), 200)[0].tolist())
    assert Counter({x.gram: x.n for x in repeats.gram_counts(docs, 200).collect()}) == want
    written, cut = [], repeats.cut
    monkeypatch.setattr(repeats, "cut", lambda df: written.append(cut(df)) or written[-1])
    runs = {(x.id, x.start, x.end) for x in repeats.repeated_runs(docs, 200).collect()}
    assert {i for i, _, _ in runs} == {0, 60}
    assert max(df.count() for df in written) < sum(want.values()) / 4
