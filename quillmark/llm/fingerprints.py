"""Document fingerprints: digests of statistically improbable byte windows.

Each window of 64 bytes has an entropy (in thousandths of the possible). Rarity is the corpus frequency of an
entropy value, counted over all windows of all documents (1,001 counts, whatever the corpus size); values of
nearly constant or nearly random windows are never used. Among any 64 windows in a row the leftmost of rarest
entropy gains a point, and windows of 16 points or more are the features. Features enter Bloom filters of
2,048 bits by five 11-bit hashes; a filter takes 160 features, then the next of the chain begins. Likeness
compares each filter of the shorter chain with its best partner: common bits, between what chance gives and the
most possible, weighted by the filter's bits.

Entropies along a text come from one stable sort and running sums, in integers, without a loop over bytes.

The next document by id: ids are cut into ranges at approximate quantiles (at most ``MOST_RANGES`` numbers on
the driver), documents are shuffled by range and sorted, and the first document of each range is also
sent to the range before it (of the first range: to the last). That is one shuffle of the texts.

Edge cases: a null text counts as empty; a text under 64 bytes has one feature, the whole text (none if empty);
two empty chains are alike (1), an empty and another chain are not (0). Rows of one id are in order of text;
rows without an id come first. A single document is its own next one. An empty table gives no rows; other
columns are not read. Texts are used whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WINDOW, POPULAR, FILTER_BITS, FILTER_FEATURES, HASHES = 64, 16, 2048, 160, 5
LEAST_FEATURES = 16
WEAK_BELOW, WEAK_ABOVE = 100, 990
DOCS_A_RANGE, MOST_RANGES = 500, 50_000
_UNIT = 1 << 16
_PLOGP = np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 2)], np.int64)
_GAIN = np.diff(_PLOGP)
_FACTORS = np.random.default_rng(5).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_ACROSS = np.arange(WINDOW)


def entropies(x: np.ndarray) -> np.ndarray:
    """Entropy of each window of WINDOW bytes, from 0 to 1000."""
    n = len(x)
    if n < WINDOW:
        return np.empty(0, np.int64)
    order = np.argsort(x, kind="stable")
    key = (x[order].astype(np.int64) << 32) + order
    rank = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW) - rank  # same bytes in the window that starts here
    behind[order] = rank - np.searchsorted(key, key - (WINDOW - 1))  # same bytes in the 63 before
    s = np.empty(n - WINDOW + 1, np.int64)
    s[0] = _PLOGP[np.bincount(x[:WINDOW])].sum()
    np.cumsum(_GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - WINDOW] - 1], out=s[1:])
    s[1:] += s[0]
    full = int(WINDOW * np.log2(WINDOW) * _UNIT)
    return (full - s) * 1000 // full


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy value, rarest first; weak values rank last, from 1001 on."""
    rank = np.empty(1001, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1001)
    rank[: WEAK_BELOW + 1] = rank[WEAK_ABOVE + 1 :] = 1001
    return rank


def features(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """64-bit hashes of the selected windows, distinct, in order of place."""
    if len(x) < WINDOW:
        return np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little")] if len(x) else [], np.uint64)
    place = rank[entropies(x)]
    a = (place << 32) + np.arange(len(place))
    step = 1
    while step < WINDOW and len(a) > step:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    points = np.bincount(a & 0xFFFFFFFF, minlength=len(place))
    chosen = np.flatnonzero((points >= POPULAR) & (place <= 1000))
    if len(chosen) < LEAST_FEATURES:
        chosen = np.sort(np.lexsort((np.arange(len(place)), place, -points))[:LEAST_FEATURES])
    h = (x[chosen[:, None] + _ACROSS].astype(np.uint64) * _FACTORS).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def filters(h: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters as rows of bits."""
    bits = np.zeros((-(-len(h) // FILTER_FEATURES), FILTER_BITS), np.float32)
    row = np.arange(len(h)) // FILTER_FEATURES
    for i in range(HASHES):
        bits[row, (h >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)] = 1
    return bits


def digest(text: str, rank: np.ndarray) -> np.ndarray:
    return filters(features(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), rank))


def written(bits: np.ndarray) -> str:
    """Number of filters, a colon, and the filters in base64."""
    return f"{len(bits)}:{base64.b64encode(np.packbits(bits.astype(bool), axis=1).tobytes()).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    na, nb = a.sum(1), b.sum(1)
    most, chance = np.minimum(na[:, None], nb), na[:, None] * nb / FILTER_BITS
    cut = chance + 0.3 * (most - chance)
    s = np.clip((a @ b.T - cut) / np.maximum(most - cut, 1e-6), 0, 1)
    forth, back = float((s.max(1) * na).sum() / na.sum()), float((s.max(0) * nb).sum() / nb.sum())
    return forth if len(a) < len(b) else back if len(b) < len(a) else (forth + back) / 2


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each entropy."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(entropies(np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)), minlength=1001)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["e", "n"])

    rows = docs.select("text").mapInArrow(count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1001, np.int64)
    out[rows.column("e").to_numpy()] = rows.column("n").to_numpy()
    return out


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs (id, text) dealt by id range and sorted, with ``tail`` rows: the document after the range's last."""
    spark = docs.sparkSession
    n = docs.select("id").count()
    ranges = max(1, min(MOST_RANGES, n // DOCS_A_RANGE))
    cuts: list[int] = []
    if ranges > 1:
        shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        cuts = sorted(set(docs.agg(F.percentile_approx("id", shares, max(10_000, 20 * ranges)).alias("q")).first()["q"] or []))
    sent = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(sent.value, ids.fillna(0).astype("int64"), side="right")).astype("int32"))

    docs = docs.withColumn("range", range_of("id"))
    # nulls come first: the first row of a range is one without an id if there is any
    firsts = sorted(docs.select("id", "range").groupBy("range").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("bare")).collect(), key=lambda r: r.range)
    before = [(r.range, None if r.bare else r.first, firsts[i - 1].range) for i, r in enumerate(firsts)]
    table = spark.createDataFrame(before, "range int, first long, before int")
    rows = docs.join(F.broadcast(table), "range")
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    to = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    rows = rows.select("id", "text", F.explode(to).alias("at")).select("id", "text", "at.range", "at.tail")
    return rows.repartition("range").sortWithinPartitions("range", "tail", F.col("id").asc_nulls_first(), "text")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, both fingerprints, near_edited and near_next."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(rarity(entropy_counts(docs)))

    def one(doc: tuple, after: tuple) -> tuple:
        key, text, own = doc
        k = len(text) // 4
        edited = text[: len(text) - k] + after[1][:k]
        changed = digest(edited, sent.value)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return key, len(text), sha, written(own), written(changed), likeness(own, changed), likeness(own, after[2])

    schema = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, done = None, None, []
        for batch in batches:
            for key, text, where, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and last is None:
                    continue  # further rows with the id of a tail row
                if where != at:
                    at, last = where, None
                doc = key, text, digest(text, sent.value)
                if last is not None:
                    done.append(one(last, doc))
                last = None if tail else doc
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []

    return in_ranges(docs).mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir, "doc_id", "text"))
