"""Toxicity: class-conditional Kneser-Ney models over the letters of words.

A text is taken as its distinct words (runs of letters and digits in lower case; a line said a hundred times counts
once), a word as its letters between two ends. Two models, of toxic and of ordinary texts, give the probability of each
letter after the three before it:

    P_c(x | abc) = max(n_c(abcx) - D, 0) / n_c(abc) + D * t_c(abc) / n_c(abc) * P(x | bc)

n_c counts documents' words of class c, t_c the letters seen after abc, and P(x | bc) is one interpolated Kneser-Ney
model for both classes: its counts are of distinct letters before bcx in the texts of either class. So a rare
expression that neither class has seen gets the shared probability, and only the weights of backing off are left in the
comparison. ``margin`` is the difference of the two log-likelihoods over (letters + LENGTH_OFFSET) ** LENGTH_POWER, as
the noise of a sum grows with the root of its length; a rising curve over margins of labelled rows that were kept out of
the counts turns it into a score.

The fit uses the ``TRAIN_ROWS`` labelled training rows of lowest seeded hash (a documented parameter, the same at every
corpus size), so that their ids can be broadcast and no text is shuffled: every fifth of them, up to ``CURVE_ROWS``, is
kept for the curve, all others are counted. Tasks count the words of their rows, Spark sums the letter counts, and the
driver receives at most 64 ** ORDER rows (letters are told apart by 64 signs: a-z, digits, 36 classes of other letters by
code point, and the end of a word). The model is broadcast (a few MB) and tasks score Arrow batches of all documents;
scores of words are kept in a bounded table.

Edge cases: a null or empty text, or one without letters and digits, has margin 0; without rows of both classes every
score is the share of toxic rows (0.5 if there are none); repeated labels of a document count once, as the highest;
repeated documents are counted and scored each; an empty table gives no rows. Other columns are passed through by
``score``, or those asked for, under their names; the names of the added columns are parameters. Texts are used whole.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_mod

ORDER = 4
DISCOUNT, SHARED_DISCOUNT = 0.5, 0.75
LENGTH_OFFSET, LENGTH_POWER = 300, 0.5
TRAIN_ROWS, CURVE_ROWS = 200_000, 20_000
CACHED_WORDS, LONG_WORD = 400_000, 64
COUNTED_WORDS = 200_000
ROWS_AT_ONCE = 500
_BITS = 6
_SIGNS = 1 << _BITS
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """The sign of each code point: 1-26 for a-z, 27 for digits, 28-63 for other letters; 0 ends a word."""
    table = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(128, sys.maxunicode + 1):
        if chr(c).isalnum():
            table[c] = 28 + c % 36
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = 27
    return table


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def grams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all grams of ``ORDER`` signs, number of grams of each word); no gram reaches into another word."""
    if not ws:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = _signs()[np.frombuffer(("\0".join(ws) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(w) for w in ws]) + 1
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = c.copy()
    for back in range(1, ORDER):
        earlier = np.concatenate([np.zeros(back, np.int64), c[:-back]])[: len(c)]
        code += np.where(place >= back, earlier, 0) << (_BITS * back)
    return code, sizes


def count_grams(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(gram, n0, n1): of each gram the words of ordinary and toxic rows that hold it, a word once a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]

        def counted() -> pa.RecordBatch:
            codes, n = [], []
            for c in (0, 1):
                code, sizes = grams(list(seen[c]))
                both = np.zeros((2, len(code)), np.int64)
                both[c] = np.repeat(np.fromiter(seen[c].values(), np.int64, len(seen[c])), sizes)
                codes.append(code)
                n.append(both)
                seen[c].clear()
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            sums = [np.bincount(at, x, len(code)).astype(np.int64) for x in np.concatenate(n, axis=1)]
            return pa.RecordBatch.from_arrays([pa.array(code), *map(pa.array, sums)], ["gram", "n0", "n1"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[label].update(words_of(text.as_py()))
                if len(seen[0]) + len(seen[1]) >= COUNTED_WORDS:
                    yield counted()
        yield counted()

    rows = labelled.select(F.col(label_col).cast("int"), text_col)
    return rows.mapInArrow(count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_model(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(x | bc) for all grams of ORDER - 1 signs, from counts of distinct signs before them in both classes."""
    counts, code, total = [], gram, n
    for k in range(ORDER - 1, 0, -1):
        space, first = _SIGNS**k, _SIGNS ** (k - 1)
        shorter = code & (space - 1)
        left = np.bincount(shorter, minlength=space).astype(np.float64)
        said = np.bincount(shorter, total, space)
        left[:first] = said[:first]  # nothing stands before the start of a word
        counts.append(left)
        code = np.flatnonzero(left)
        total = left[code]
    p = np.full(_SIGNS, 1 / _SIGNS)
    for left in reversed(counts):
        rows = left.reshape(-1, _SIGNS)
        after, taken = rows.sum(1, keepdims=True), np.minimum(rows, SHARED_DISCOUNT).sum(1, keepdims=True)
        shorter = p.reshape(-1, _SIGNS)[np.arange(len(rows)) % (len(p) // _SIGNS)]
        p = np.where(after > 0, (np.maximum(rows - SHARED_DISCOUNT, 0) + taken * shorter) / np.where(after > 0, after, 1), shorter).ravel()
    return p


class Model:
    """Both models' log-probabilities of known grams, their weights of backing off, and the curve."""

    def __init__(self, gram: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = np.argsort(gram)
        self.gram, n = gram[order], np.stack([n0, n1])[:, order].astype(np.float64)
        space = _SIGNS ** (ORDER - 1)
        shared = shared_model(self.gram, n.sum(0)) if len(gram) else np.full(space, 1 / _SIGNS)
        before, rest = self.gram >> _BITS, self.gram & (space - 1)
        self.shared = np.log(shared)
        self.known, self.weight = np.zeros((2, len(gram))), np.zeros((2, space))
        for c in (0, 1):
            after = np.bincount(before, n[c], space)
            taken = np.bincount(before, np.minimum(n[c], DISCOUNT), space)
            weight = np.where(after > 0, taken / np.where(after > 0, after, 1), 1.0)
            self.weight[c] = np.log(np.maximum(weight, 1e-12))
            self.known[c] = np.log(np.maximum(n[c] - DISCOUNT, 0) / np.where(after > 0, after, 1)[before] + weight[before] * shared[rest])
        self.curve, self.share = (np.zeros(1), np.zeros(1)), None

    def of_words(self, ws: list[str]) -> np.ndarray:
        """(words x 3): log-likelihood as ordinary, as toxic, and signs of each word."""
        code, sizes = grams(ws)
        out = np.empty((len(ws), 3))
        out[:, 2] = sizes
        at = np.minimum(np.searchsorted(self.gram, code), max(len(self.gram) - 1, 0))
        hit = self.gram[at] == code if len(self.gram) else np.zeros(len(code), bool)
        starts = np.cumsum(sizes) - sizes
        for c in (0, 1):
            unseen = self.weight[c][code >> _BITS] + self.shared[code & (_SIGNS ** (ORDER - 1) - 1)]
            if len(ws):
                out[:, c] = np.add.reduceat(np.where(hit, self.known[c][at], unseen) if len(self.gram) else unseen, starts)
        return out

    def margin(self, sums: np.ndarray) -> np.ndarray:
        return (sums[:, 1] - sums[:, 0]) / (sums[:, 2] + LENGTH_OFFSET) ** LENGTH_POWER

    def score(self, sums: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(sums), self.share)
        m = self.margin(sums)
        return 0.99 * np.interp(m, *self.curve) + 0.01 * (0.5 + np.arctan(m) / np.pi)


class Likelihoods:
    """(texts x 3) sums over the distinct words of texts; words are looked up in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.at, self.values = model, {}, np.empty((0, 3))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        sets, out = [words_of(t) for t in texts], np.zeros((len(texts), 3))
        if len(self.at) > CACHED_WORDS:
            self.at, self.values = {}, np.empty((0, 3))
        new = set().union(*sets) - self.at.keys() if sets else set()
        long = [w for w in new if len(w) > LONG_WORD]
        new = sorted(new.difference(long))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.values = np.concatenate([self.values, self.model.of_words(new)])
        spare = dict(zip(long, self.model.of_words(long), strict=True))
        for i, ws in enumerate(sets):
            kept = ws.difference(spare) if spare else ws
            out[i] = self.values[[self.at[w] for w in sorted(kept)]].sum(0)
            for w in sorted(ws - kept) if spare else ():
                out[i] += spare[w]
        return out


def curve_of(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, share of toxic rows) of the rising curve closest to the labels: neighbouring groups of rows that
    would fall are pooled. A pooled share counts two rows of the overall share more, so that no small group is certain."""
    order, groups = np.argsort(margins, kind="stable"), []
    for x, y in zip(margins[order].tolist(), labels[order].tolist(), strict=True):
        groups.append((x, float(y), 1.0))
        while len(groups) > 1 and groups[-2][1] * groups[-1][2] >= groups[-1][1] * groups[-2][2]:
            last = groups.pop()
            groups[-1] = tuple(a + b for a, b in zip(groups[-1], last, strict=True))
    x, y, n = np.array(groups).T
    return x / n, np.maximum.accumulate((y + 2 * labels.mean()) / (n + 2))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, curve_rows: int = CURVE_ROWS,
) -> Model:
    """Fits on at most ``rows`` labelled documents, those of lowest hash of the id; a fifth, at most ``curve_rows``, fits the curve."""
    told = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    order = F.xxhash64("id", F.lit("toxic"))
    told = cut(told.orderBy(order, "id").limit(rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted, apart = told.where(F.pmod(order, F.lit(5)) != 4), told.where(F.pmod(order, F.lit(5)) == 4).orderBy(order, "id").limit(curve_rows)
    cells = count_grams(texts.join(F.broadcast(counted), "id"), "text", "y").toArrow()
    model = Model(*[cells.column(c).to_numpy() for c in ("gram", "n0", "n1")])
    kept_out = likelihoods(texts.join(F.broadcast(apart), "id"), model, "text", [F.col("y")]).toArrow()
    y = kept_out.column("y").to_numpy()
    if len(set(y.tolist())) < 2 or not (cells.num_rows and min(np.sum(cells.column(c).to_numpy()) for c in ("n0", "n1"))):
        share = told.agg(F.avg("y")).first()[0]
        model.share = 0.5 if share is None else float(share)
        return model
    sums = np.stack([kept_out.column(c).to_numpy() for c in ("ll_ordinary", "ll_toxic", "signs")], 1)
    order = np.lexsort((y, model.margin(sums)))
    model.curve = curve_of(model.margin(sums)[order], y[order])
    return model


def _over_texts(docs: DataFrame, model: Model, text_col: str, columns: list | None, fields: str, of_sums) -> DataFrame:
    """The given columns (all others of docs by default) and the arrays that ``of_sums(model, sums)`` makes of a batch."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if columns is None else columns
    rows = docs.select(*others, F.col(text_col))
    passed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Likelihoods(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = of_sums(sent.value, of(part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, made)], [str(k) for k in range(part.num_columns - 1 + len(made))])

    return rows.mapInArrow(run, passed + fields)


def likelihoods(docs: DataFrame, model: Model, text_col: str = "text", columns: list | None = None, names: tuple[str, str, str] = ("ll_ordinary", "ll_toxic", "signs")) -> DataFrame:
    """The given columns, both log-likelihoods of the text's words, and the signs that they are over."""
    return _over_texts(docs, model, text_col, columns, ", ".join(f"`{n}` double" for n in names), lambda m, sums: list(sums.T))


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list | None = None, score_col: str = "score", predicted_col: str = "predicted", threshold: float = 0.3) -> DataFrame:
    """The given columns, and under the given names the score and the class."""

    def of_sums(m: Model, sums: np.ndarray) -> list[np.ndarray]:
        p = m.score(sums)
        return [p, (p >= threshold).astype(np.int32)]

    return _over_texts(docs, model, text_col, columns, f"`{score_col}` double, `{predicted_col}` int", of_sums)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = id_mod(F.col("doc_id"), 4) == 2
    return score(docs, fit(docs, labels.where(~held_out)), "text", [F.col("doc_id"), held_out.alias("held_out")])
