"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts cover every labelled training row: each task adds up one (languages x buckets) table with
``numpy.bincount``, Spark sums the tables, and the driver receives at most languages x ``buckets`` cells,
whatever the corpus size. The smoothed log-probabilities are broadcast as one matrix (buckets x languages,
float32); tasks score Arrow batches as products of a sparse matrix of texts by n-grams with it.

A text is lower-cased, every run of other characters than letters becomes one space, and 1- to 3-grams of
code points are hashed.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing was
learned (no labelled rows). Rows without a language aren't learned from. Repeated rows count each in
training. Ties go to the first language by code point. An empty table gives no rows. Other columns are not
read, or passed on; ``predict`` takes other names for its own two columns where docs has columns of these names.
Texts are used whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_mod

BUCKETS = 1 << 14
BLOCK_GRAMS = 1 << 19
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all 1- to 3-grams of a text; empty if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays, as a space
    c = np.where(letter, c, np.uint32(32))[keep]
    shift, grams, h = np.uint32(32 - buckets.bit_length() + 1), [], np.zeros(len(c), np.uint32)
    for n, by in enumerate(_MULTIPLIERS, 1):
        h = h[: len(c) - n + 1] * np.uint32(31) + (c[n - 1 :] + np.uint32(n)) * np.uint32(by)
        grams.append((h * np.uint32(0x9E3779B1)) >> shift)
    return np.concatenate(grams).astype(np.int32)


def count_ngrams(labelled: DataFrame, lang_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows with a language; bucket -1 counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = ngrams(text.as_py(), buckets)
                if len(grams):
                    table = tables.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    table[1:] += np.bincount(grams, minlength=buckets)
                    table[0] += 1
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(table[at])], ["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, matrix of buckets x languages of log-probabilities, log priors)."""
    cells = count_ngrams(labelled, lang_col, text_col, buckets).toArrow()
    langs = sorted(set(cells.column("lang").to_pylist()), key=lambda x: x.encode())
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), buckets + 1))
    counts[[at[x] for x in cells.column("lang").to_pylist()], cells.column("bucket").to_numpy() + 1] = cells.column("n").to_numpy()
    share = counts[:, 1:] + smoothing
    prior = counts[:, 0] / max(counts[:, 0].sum(), 1)
    return langs, np.ascontiguousarray(np.log(share / share.sum(1, keepdims=True)).T.astype(np.float32)), np.log(np.maximum(prior, 1e-12))


def log_probabilities(texts: list[str | None], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages of log P(language, text), n-grams of each text).

    The batch is a sparse matrix of texts by buckets, held as the columns and row ends of its entries; its product
    with the log-probability matrix is taken in blocks of at most ``BLOCK_GRAMS`` entries.
    """
    out, sizes = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    block, ids, total = [], [], 0

    def multiply() -> None:
        columns = np.concatenate(block)
        ends = np.cumsum([len(g) for g in block])
        for at in range(0, len(columns), BLOCK_GRAMS):  # of a longer text, piece by piece
            upto = min(at + BLOCK_GRAMS, len(columns))
            first = np.searchsorted(ends, at, side="right")
            last = np.searchsorted(ends, upto, side="left")
            starts = np.maximum(np.concatenate([[0], ends[:-1]])[first : last + 1], at) - at
            out[np.array(ids)[first : last + 1]] += np.add.reduceat(matrix[columns[at:upto]], starts, dtype=np.float64)

    for i, text in enumerate(texts):
        grams = ngrams(text, len(matrix))
        sizes[i] = len(grams)
        if len(grams):
            block.append(grams)
            ids.append(i)
            total += len(grams)
        if total >= BLOCK_GRAMS:
            multiply()
            block, ids, total = [], [], 0
    if block:
        multiply()
    return out, sizes


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", columns: list[Column] | None = None,
    keep_text: bool = False, lang_pred: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """The given columns (all others of docs by default), and under the given names the language and its posterior."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = sent.value
        for batch in batches:
            n = batch.num_rows
            picked, scores = [UNKNOWN] * n, np.zeros(n)
            if langs and n:
                log, sizes = log_probabilities(batch.column(batch.num_columns - 1).to_pylist(), matrix, prior)
                best = log.argmax(1)
                told = sizes > 0
                scores = np.where(told, 1 / np.exp(log - log[np.arange(n), best][:, None]).sum(1), 0.0)
                picked = [langs[b] if known else UNKNOWN for b, known in zip(best.tolist(), told.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(picked, pa.string()), pa.array(scores, pa.float64())], [*names, lang_pred, score])

    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if columns is None else columns
    rows = docs.select(*others, F.col(text_col))
    names = rows.columns if keep_text else rows.columns[:-1]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(run, f"{fields}`{lang_pred}` string, `{score}` double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = id_mod(F.col("doc_id"), 4) == 2
    return predict(docs, fit(docs.where(~held_out)), "text", [F.col("doc_id"), held_out.alias("held_out")])
