"""Similar titles and nearest vectors, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import written
from .select import cap_per_group


#: Members of a class that are paired as one list.
_CHUNK = 256
#: Rows of one token that meet each other in one task.
_BLOCK = 2048


def _classes(df: DataFrame, row_id: str, words: str, least: int, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Classes (c, w, size, group) of rows with equal token sets of at least so many tokens, and lists of members (c, ids)."""
    sets = df.select(F.col(row_id).alias("id"), *group, F.array_sort(F.array_distinct(words)).alias("w")).where((F.size("w") >= least) & F.col("id").isNotNull())
    classes = written(sets.groupBy(*group, "w").agg(F.count("*").alias("size")).withColumn("c", F.monotonically_increasing_id()))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / _CHUNK)).alias("part")
    return classes, sets.join(classes, [*group, "w"]).groupBy("c", part).agg(F.collect_list("id").alias("ids")).drop("part")


def _expanded(pairs: DataFrame, classes: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Pairs (ca, cb, shared, ``name``) of classes, and classes with themselves, as pairs (a, b, shared, ``name``) of rows.

    What is joined and dealt over tasks are lists of members, so that no class is one task's.
    """
    own = classes.where("size > 1").select(F.col("c").alias("ca"), F.col("c").alias("cb"), F.size("w").alias("shared"), F.lit(1.0).alias(name))
    lists = pairs.unionByName(own).join(members.toDF("ca", "x"), "ca").join(members.toDF("cb", "y"), "cb")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.repartition(tasks, F.element_at("x", 1), F.element_at("y", 1), "ca", "cb")
    each = lists.withColumn("a", F.explode("x")).drop("x").withColumn("b", F.explode("y"))
    each = each.where(F.when(F.col("ca") == F.col("cb"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", name)


def similar_titles(df: DataFrame, row_id: str, words: str, threshold: float = 0.82, least: int = 3) -> DataFrame:
    """Pairs (a, b, similarity) of token sets with an overlap coefficient of at least the threshold.

    Rows with equal sets are one class; only classes are compared, and pairs of classes become pairs of rows at the end.
    The coefficient is over the smaller set, so a pair shares one of the smaller set's first
    n - ceil(threshold * n) + 1 tokens, rarest first. Those are joined with all tokens of the other side; the
    frequent tokens that make an inverted index explode are in no set's first tokens unless they are all it has.
    """
    classes, members = _classes(df, row_id, words, least, [])
    sets = classes.select(F.col("c").alias("id"), "w")
    entries = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("t"))
    rarity = entries.groupBy("t").agg(F.count("*").alias("df"))
    ranked = entries.join(rarity, "t").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("by"))
    first = ranked.select("id", "n", F.explode(F.slice("by", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("x")).select("id", "n", "x.t")
    a, b = first.toDF("a", "na", "t"), entries.select(F.col("id").alias("b"), F.col("n").alias("nb"), "t")
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, "t").where(smaller).select("a", "b").distinct()
    x, y = sets.toDF("a", "wa"), sets.toDF("b", "wb")
    shared = F.size(F.array_intersect("wa", "wb"))
    scored = pairs.join(x, "a").join(y, "b").select(F.col("a").alias("ca"), F.col("b").alias("cb"), shared.alias("shared"), (shared / F.least(F.size("wa"), F.size("wb"))).alias("similarity"))
    scored = scored.where((F.col("shared") >= least) & (F.col("similarity") >= threshold))
    return _expanded(scored, classes, written(members), "similarity").select("a", "b", "similarity")


def sharing_tokens(df: DataFrame, row_id: str, group: str, words: str, least: int) -> DataFrame:
    """Pairs (a, b, shared, overlap) of rows of one group that share at least so many tokens.

    Rows of a group with equal sets are one class, as in ``similar_titles``. With tokens of a group rarest first, and
    without those of one class, the first token that a pair shares stands before the last least - 1 of each. Classes go
    by each such token with all their tokens and a list of their rows, so that a pair is told, counted where that
    token is its first, and expanded in one task; no pair is moved. A token of many rows is dealt over blocks of
    ``_BLOCK`` rows, and each two blocks meet in a task of their own.
    """
    classes, members = _classes(df.where(F.col(group).isNotNull()).withColumn("g", F.col(group)), row_id, words, least, ["g"])
    members = written(members)
    entries = classes.select("c", "g", F.size("w").alias("n"), F.explode("w").alias("t"))
    shared = written(entries.groupBy("g", "t").agg(F.count("*").alias("df")).where("df > 1").withColumn("k", F.monotonically_increasing_id()))
    ranked = entries.join(shared, ["g", "t"]).groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("by"))
    ranked = ranked.where(F.size("by") >= least).select("c", "n", F.transform("by", lambda x: x["k"]).alias("by"))
    lists = written(ranked.join(members, "c"))
    keyed = lists.withColumn("k", F.explode(F.slice("by", F.lit(1), F.size("by") - (least - 1))))
    wide = keyed.groupBy("k").agg(F.sum(F.size("ids")).alias("m")).where(F.col("m") > _BLOCK).select("k", F.ceil(F.col("m") / _BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(F.broadcast(wide), "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int"))
    rows = [F.col(c).alias(c + side) for side in "xy" for c in ("c", "n", "by", "ids")]
    x = placed.select("k", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *rows[:4])
    y = placed.select("k", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *rows[4:])
    common = F.array_intersect("byx", "byy")
    met = x.join(y, ["k", "i", "j"]).where(F.when(F.col("i") == F.col("j"), F.col("cx") < F.col("cy")).otherwise(F.col("cx") != F.col("cy")))
    met = met.withColumn("common", common).where((F.size("common") >= least) & (F.col("common")[0] == F.col("k")))
    met = met.select("idsx", "idsy", F.size("common").alias("shared"), (F.size("common") / F.least("nx", "ny")).alias("overlap"))
    each = met.withColumn("a", F.explode("idsx")).drop("idsx").withColumn("b", F.explode("idsy")).where("a <> b")
    none = df.sparkSession.createDataFrame([], "ca long, cb long, shared int, overlap double")
    own = _expanded(none, classes, members, "overlap")
    return own.unionByName(each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "overlap"))


#: Rows of vectors that are multiplied at once; what a block of scores takes is this times the queries of a block.
_ROWS = 1024


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Lists as a matrix of doubles; what is null, or missing at the end, adds nothing, as in SQL's sums."""
    flat, size = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out, place = np.zeros((len(size), width)), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = place < width
    out[np.repeat(np.arange(len(size)), size)[inside], place[inside]] = flat[inside]
    return out


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the first element on, as SQL does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class _Best:
    """The k best rows of each query so far, as exact sums; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.sizes = np.abs(vectors).sum(1)
        self.least = np.full(len(ids), -np.inf)
        self.held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # place of the query, id, score

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # A product of matrices adds up in any order: what it rules out is below the k-th score by more than that can be.
        # (NaN rules nothing out.)
        slack = 1e-15 * vectors.shape[1] * self.sizes * np.abs(vectors).max(initial=0.0)
        rows, places = np.nonzero(~(vectors @ self.vectors.T < self.least - slack))
        other = ids[rows] != self.ids[places]
        rows, places = rows[other], places[other]
        if not len(rows):
            return
        score = np.concatenate([_sums(self.vectors[p], vectors[r]) for p, r in zip(np.array_split(places, len(places) // 65536 + 1), np.array_split(rows, len(rows) // 65536 + 1), strict=True)])
        place, near, score = (np.concatenate(x) for x in zip(self.held, (places, ids[rows], score), strict=True))
        order = np.lexsort((near, -score, ~np.isnan(score), place))
        place, near, score = place[order], near[order], score[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        full = place[rank == self.k - 1]
        self.least[full] = score[rank == self.k - 1]
        self.held = [x[rank < self.k] for x in (place, near, score)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query, neighbour, score): the k rows of largest dot product for each stated query.

    Queries are taken in blocks of about ``block`` by a hash of their ids; a block is sent to all tasks (a few MB), so
    what a task holds doesn't grow with the queries. A task multiplies a batch of rows with a block as matrices, which
    rules out all pairs but those near a query's k-th score so far; these are summed exactly, in the order of the
    elements, so that equal vectors tie. What moves is k rows a query and task. Every query meets every row.

    Edge cases: rows without an id or a vector are no neighbours and no queries; repeated ids are rows each, and none
    is a neighbour of its own id; null elements and those that the other vector lacks add nothing; scores that are no
    number are the largest; no queries give no rows.
    """
    spark, kind, own = vectors.sparkSession, "query long, neighbour long, score double", vectors.schema[row_id].dataType
    rows, q = (df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v")).dropna() for df in (vectors, queries))
    blocks, found = max(1, -(-q.count() // block)), []
    for i in range(blocks):
        table = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        lists = table.column("v").combine_chunks()
        of = _vectors(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
        found.append(rows.mapInArrow(_compared(spark.sparkContext.broadcast((table.column("id").to_numpy(), of)), k), kind))
    best = cap_per_group(reduce(DataFrame.unionByName, found), "query", [F.desc("score"), "neighbour"], k)
    return best.select(F.col("query").cast(own).alias("query"), F.col("neighbour").cast(own).alias("neighbour"), "score")


def _compared(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of = sent.value
        best = _Best(ids, of, k)
        for batch in batches:
            near, v = batch.column(0).to_numpy(), _vectors(batch.column(1), of.shape[1])
            for at in range(0, len(near), _ROWS):
                best.add(near[at : at + _ROWS], v[at : at + _ROWS])
        place, near, score = best.held
        yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(near), pa.array(score)], ["query", "neighbour", "score"])

    return run
