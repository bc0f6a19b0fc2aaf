"""Periodic runs of words, by harmonic grid probing.

A run is a stretch of words with smallest period q and at least max(12, 2q) words that no neighbouring word extends.
A run with period p has two neighbouring multiples jp and (j+1)p among its positions, so a text of n words is probed
only where those are equal: n/p comparisons for a period p, n log n in all, taken as strided array comparisons (over j
for small periods, over p for large ones). Survivors with fewer equal neighbours than a run has are dropped, the
others extended to both sides by comparing chunks of growing length. Grid points inside a run already found, whose
period divides p, can't give another run and are skipped; so are those inside a stretch that was just extended.

Texts are worked on one by one in numpy inside Arrow batches, without a shuffle; memory is a few integers a word and,
for periods from P to 2P, a few a surviving grid point. Texts that consist of few very long stretches that are equal up
to single words cost the most, at worst a comparison of the text with itself a period.

Edge cases: a null, empty or blank text has no words and no runs, and collapses to an empty text; repeated rows are
looked at each; an empty table gives no rows; of runs of equal length the one that starts first, then the one of
smaller period, is the longest. Other columns are passed through inside ``row``, so their names can't clash. Texts are
used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, words

LEAST_WORDS = 12
#: Any run has this many words in a row that equal the words a period later.
_NEIGHBOURS = LEAST_WORDS // 2
_FIRST_CHUNK = 64
BATCH_CHARS = 2_000_000

Run = tuple[int, int, int]


def probe(ids: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions i, periods p) with low <= p < high, i a multiple of p, and equal words at i and i + p."""
    n, at, of = len(ids), [], []
    if low * low <= n:
        for p in range(low, high):
            grid = ids[::p]
            hit = np.flatnonzero(grid[1:] == grid[:-1])
            at.append(hit * p)
            of.append(np.full(len(hit), p))
    else:
        for j in range((n - 1) // low):
            upto = min(high - 1, (n - 1) // (j + 1))
            left = ids[j * low : j * upto + 1 : j] if j else ids[0]
            hit = low + np.flatnonzero(left == ids[(j + 1) * low : (j + 1) * upto + 1 : j + 1])
            at.append(hit * j)
            of.append(hit)
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, p = np.concatenate(at), np.concatenate(of)
    order = np.lexsort((i, p))
    return i[order], p[order]


def outside(i: np.ndarray, p: np.ndarray, found: list[Run], low: int, high: int, n: int) -> np.ndarray:
    """False for grid points whose both words lie in a found run with a period that divides p."""
    key, change = p * n + i, np.zeros(len(i) + 1, np.int64)
    for start, length, period in found:
        upto = min(high, length)
        if upto > low:
            multiples = np.arange(-(-low // period) * period, upto, period)
            np.add.at(change, np.searchsorted(key, multiples * n + start), 1)
            np.add.at(change, np.searchsorted(key, multiples * n + start + length - multiples), -1)
    return np.cumsum(change)[:-1] == 0


def supported(ids: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """True for grid points with as many equal neighbours as the shortest run has."""
    n, count = len(ids), np.ones(len(i), np.int64)
    for side in (1, -1):
        alive = np.arange(len(i))
        for d in range(1, _NEIGHBOURS):
            x = i[alive] + side * d
            inside = (x >= 0) & (x + p[alive] < n)
            alive, x = alive[inside], x[inside]
            alive = alive[ids[x] == ids[x + p[alive]]]
            count[alive] += 1
    return count >= _NEIGHBOURS


def stretch(ids: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """(start, end) of the longest stretch around i in which words p apart are equal."""
    n, end, chunk = len(ids), i, _FIRST_CHUNK
    while end + p < n:
        m = min(chunk, n - p - end)
        same = ids[end : end + m] == ids[end + p : end + p + m]
        if not same.all():
            end += int(same.argmin())
            break
        end, chunk = end + m, 2 * chunk
    start, chunk = i, _FIRST_CHUNK
    while start:
        m = min(chunk, start)
        same = ids[start - m : start] == ids[start - m + p : start + p]
        if not same.all():
            start -= int(same[::-1].argmin())
            break
        start, chunk = start - m, 2 * chunk
    return start, end + p


def runs_of(ids: np.ndarray) -> list[Run]:
    """All (start, length, period) of a text's word ids, by start, then period."""
    n, found, spans, low = len(ids), [], set(), 1
    while n >= LEAST_WORDS and low <= n // 2:
        high = min(2 * low, n // 2 + 1)
        i, p = probe(ids, low, high)
        if found and len(i):
            keep = outside(i, p, found, low, high, n)
            i, p = i[keep], p[keep]
        keep = supported(ids, i, p)
        period, upto = 0, 0
        for x, q in zip(i[keep].tolist(), p[keep].tolist(), strict=True):
            if q == period and x + q < upto:
                continue
            start, upto = stretch(ids, x, q)
            period = q
            if upto - start >= max(LEAST_WORDS, 2 * q) and (start, upto) not in spans:
                spans.add((start, upto))
                found.append((start, upto - start, q))
        low *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(ws: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(ws)
    change = np.zeros(len(ws) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([ws[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


def word_ids(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text (split at ASCII white space) and their numbers."""
    ws = (text or "").encode().split()
    number = {w: k for k, w in enumerate(dict.fromkeys(ws))}
    return ws, np.array([number[w] for w in ws], np.int32)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, text_col: str | Column = "text") -> DataFrame:
    """(row, runs, collapsed): the other columns, all runs by start and period, and the text without their repeats."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), (F.col(text_col) if isinstance(text_col, str) else text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, kept, size, first = [], [], 0, 0
            for k in range(batch.num_rows):
                ws, ids = word_ids(batch.column(1)[k].as_py())
                runs = runs_of(ids)
                made.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(collapsed(ws, runs).decode())
                size += len(kept[-1])
                if size >= BATCH_CHARS or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first : k + 1], pa.array(made, pa.list_(_RUN)), pa.array(kept, pa.string())], ["row", "runs", "collapsed"])
                    made, kept, size, first = [], [], 0, k + 1

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text, for a tenth of the ids with its words from a place on replaced by repeats of the first of them."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, at(i).cast("int")))))

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = find_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = out.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.concat_ws("", said).alias("said"), "collapsed")
    return out.select(
        "doc_id", "n_runs", (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("m.length") / -F.col("m.period")).alias("exponent_milli"),
        F.sha2("said", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
