"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix X.

Overlaps are entries of X * X^T. The product is never formed whole; it is taken in column blocks, and pairs
that the set sizes rule out are dropped between blocks:

1. Rows of X with equal n-gram sets become one class (two 64-bit set hashes and the size).
2. All n-grams get one global order: by 64-bit hash, the frequent ones last. (Which are frequent is counted
   over all documents for the lowest part of the hash range, where prefixes lie: a quarter, half or all of it
   for long, medium and short sets. Any order gives right results, a good one gives short columns.) Two sets
   of Jaccard >= t share one of their first n - ceil(t * n) + 1 n-grams in that order, so only this prefix
   block of X is multiplied first.
3. Columns of up to ``column`` entries are multiplied in full and the overlaps accumulated a pair. A pair
   stays only if that overlap, plus all that the sizes leave outside the block, can still reach
   ceil(t / (1 + t) * (n_a + n_b)).
4. Longer columns (one passage or one group of copies in thousands of documents) are not multiplied in full.
   Each member is first compared with a pivot, the most central member of its columns (the original of a
   group of copies has the largest share of its n-grams in long columns). Members that turn out connected
   need no further products. Two others with overlaps o_a and o_b with one pivot can reach the needed overlap
   only if they share enough n-grams outside the pivot (those columns are multiplied instead, by the same rules: a
   pivot for long ones, then the prefixes that the sizes leave), or if o_a and o_b are both that large. Members of
   one column with different pivots are multiplied in full. Joins with what is known of a wide column or of a pivot
   are dealt over tasks by their members. No link between two components is lost.
5. Surviving pairs get their whole overlap from the whole sets, computed again from the texts of the
   documents involved only. Pairs inside one component are skipped, as they cannot change the result.

Components come from hooking and contraction on tables (components.py); nothing that grows with the corpus
is sent to the driver. Intermediate tables go to the shared checkpoint folder.

Edge cases: a null, empty or blank text has an empty set, is linked with nothing and is its own component; a
text of fewer words than the n-gram width has one n-gram, the whole sequence; equal texts link (one class);
rows with the same id are one document for the component: each of their texts is compared, and what any of
them links is one component; rows with a null id are never linked and get a null component; an empty table
gives no rows; other columns are not read. Texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents
from .components import connected_components, joined_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Set size from which on only that share of the hash range is counted.
_COUNTED = ((400, 0.25), (128, 0.5), (0, 1.0))
FREQUENT = 1 << 20  # most frequent n-grams that tasks hold, 8 MB
BROADCAST_IDS = 1 << 19  # rows of four numbers, about 50 MB
PARTS = 64
CACHED_WORDS = 400_000


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct n-gram hashes (signed 64-bit) of a text; word hashes are cached up to a bound."""

    def __init__(self, width: int):
        self.width, self.seen = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        seen, ws = self.seen, (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not ws:
            return np.empty(0, np.int64)
        for w in set(ws):
            if w not in seen:
                seen[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.array([seen[w] for w in ws], np.uint64)
        if len(seen) > CACHED_WORDS:
            seen.clear()
        n = min(self.width, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = _mix(s + h[i : len(h) - n + 1 + i], 0xBF58476D1CE4E5B9)
        return np.unique(s.view(np.int64))


def _counted_below(n: int) -> float:
    return -(2.0**63) + next(share for least, share in _COUNTED if n >= least) * 2.0**64


def frequent_ngrams(docs: DataFrame, width: int, more_than: int) -> np.ndarray:
    """Sorted n-grams of the counted range in more than so many documents, the ``FREQUENT`` most frequent at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            found = [s[: np.searchsorted(s, _counted_below(len(s)))] for s in (shingles(t.as_py()) for t in batch.column(0))]
            if found:
                s, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], ["s", "n"])

    rows = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = rows.where(F.col("n") > more_than).orderBy(F.desc("n"), "s").limit(FREQUENT)
    return np.sort(rows.select("s").toArrow().column("s").to_numpy())


def _set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of n-grams."""
    u = s.view(np.uint64)
    one, two = _mix(u, 0xBF58476D1CE4E5B9), _mix(~u, 0xD6E8FEB86659FD93)
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (one, two))


def prefixes(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(id, k, n, s1, s2, prefix): hash of id and text, set size, two set hashes, and the first n-grams in the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last = Shingler(width), sent.value
        for batch in batches:
            ns, s1, s2, firsts = [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py())
                n = len(s)
                ns.append(n)
                for c, x in zip((s1, s2), _set_hashes(s), strict=True):
                    c.append(x)
                if n and len(last):
                    rare = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] != s
                    s = np.concatenate([s[rare], s[~rare]])
                firsts.append(s[: n + (-percent * n) // 100 + 1] if n else s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                ["id", "k", "n", "s1", "s2", "prefix"],
            )

    return docs.select("id", _row_hash(), "text").mapInArrow(rows, "id long, k long, n long, s1 long, s2 long, prefix array<long>")


def _row_hash():
    return F.xxhash64("id", "text").alias("k")


def sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(rep, s): whole n-gram sets of the given classes, from the text of one row each (which k finds)."""
    wanted = cut(classes.select("k", "rep", "s1", "s2"))
    docs = docs.select(_row_hash(), "text")
    if wanted.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(wanted), "k")
    else:
        docs = docs.join(wanted, "k")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(3)]
            right = [_set_hashes(s) == x for s, x in zip(found, zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True), strict=True)]
            sets = pa.array([s for s, ok in zip(found, right, strict=True) if ok], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right, pa.bool_())), sets], ["rep", "s"])

    return docs.select("rep", "s1", "s2", "text").mapInArrow(rows, "rep long, s array<long>").dropDuplicates(["rep"])


def _needed(percent: int):
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def _sized(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _in_short_prefix(percent: int):
    """True for the first n - ceil(2t / (1 + t) * n) + 1 entries of a row; a set that is no smaller can't miss them all."""
    return F.col("at") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))


def beside(rows: DataFrame, keys: list[str], *columns) -> DataFrame:
    """rows (with rep) and aggregates of their group; the members of a wide group are dealt over ``PARTS`` tasks."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS)))
    spread = dealt.select(*keys, "part").distinct().join(rows.groupBy(*keys).agg(*columns), keys)
    return dealt.join(spread, [*keys, "part"]).drop("part")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, column: int = 48) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable by links of Jaccard >= percent / 100."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    heads = cut(prefixes(docs, width, percent, frequent_ngrams(docs, width, column)))
    named = heads.where("id IS NOT NULL AND n > 0")
    # One node a class of equal sets, numbered in order of the smallest id that has it.
    classes = named.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "k")).alias("at")).orderBy("at", "s1", "s2", "n")
    classes = cut(classes.select("s1", "s2", "n", F.col("at.id").alias("low"), "at.k", F.monotonically_increasing_id().alias("rep")))
    firsts = named.select("k", "s1", "s2", "n", "prefix").join(classes.select("k", "s1", "s2", "n", "rep"), ["k", "s1", "s2", "n"]).dropDuplicates(["rep"])
    entries = firsts.select("rep", "n", F.size("prefix").alias("p"), F.posexplode("prefix").alias("at", "s"))
    columns = cut(entries.groupBy("s").agg(F.count("*").alias("width")).where("width > 1"))
    block = cut(entries.join(columns, "s"))
    short, long = block.where(F.col("width") <= column), block.where(F.col("width") > column)
    beyond = cut(long.groupBy("rep").agg(F.count("*").alias("in_long")))
    long = cut(long.join(beyond, "rep").select("s", "rep", "n", _in_short_prefix(percent).alias("early"), F.struct((F.col("in_long") / F.col("p")).alias("share"), (-F.col("rep")).alias("low")).alias("central")))

    # 3. short columns in full
    row = cut(short.join(beyond, "rep", "left").select("s", "rep", "n", (F.col("n") - F.col("p") + F.coalesce("in_long", F.lit(0))).alias("rest")))
    a = row.select("s", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    b = row.select("s", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    pairs = a.join(b, "s").where("a < b").where(_sized(percent))
    pairs = pairs.groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.count("*").alias("shared"))
    pairs = cut(pairs.where(F.col("shared") + F.greatest("ra", "rb") >= _needed(percent)).select("a", "b", "na", "nb"))

    involved = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(long.select("rep")).distinct()
    sets = cut(sets_of(docs, classes.join(involved, "rep", "left_semi"), width))

    def links(candidates: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
        both = candidates.join(left, "a").join(right, "b")
        return both.where(F.size(F.array_intersect("sa", "sb")) >= _needed(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def tagged(rows: DataFrame, rep: str, labels: DataFrame, c: str) -> DataFrame:
        """rows with the component c of their column rep."""
        known = labels.select(F.col("node").alias(rep), F.col("component").alias(c))
        return rows.join(known, rep, "left").withColumn(c, F.coalesce(c, rep))

    def unsettled(labels: DataFrame) -> DataFrame:
        """Entries of long columns whose members are in several components."""
        every = cut(tagged(long, "rep", labels, "c"))
        return cut(beside(every, ["s"], F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").drop("c0", "c1"))

    def with_sets(of: DataFrame) -> DataFrame:
        """of (p, rep, ...), many members rep with few pivots p, and both sets sx and sp; a pivot's members are dealt over tasks."""
        dealt = cut(of).withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS)))
        whole = sets.join(dealt.select(F.col("p").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("p"), F.col("s").alias("sp"))
        whole = dealt.select("p", "part").distinct().join(whole, "p")
        return dealt.join(sets.withColumnRenamed("s", "sx"), "rep").join(whole, ["p", "part"])

    def with_pivots(rows: DataFrame) -> DataFrame:
        """(rep, n, p, np, o, u): for each member the most central pivot of its columns, the overlap, and the n-grams outside it."""
        of = beside(rows, ["s"], F.max(F.struct("central", "rep", "n")).alias("pivot")).groupBy("rep", "n").agg(F.max("pivot").alias("pivot"))
        both = with_sets(of.select("rep", "n", F.col("pivot.rep").alias("p"), F.col("pivot.n").alias("np")))
        return cut(both.select("rep", "n", "p", "np", F.size(F.array_intersect("sx", "sp")).alias("o"), F.array_except("sx", "sp").alias("u")))

    def ends(rows: DataFrame, x: str) -> DataFrame:
        """The columns of one end of a pair."""
        return rows.select(*[c for c in ("s", "p", "v") if c in rows.columns], *[F.col(c).alias(x if c == "rep" else c + x) for c in ("rep", "n", "c", "o", "r") if c in rows.columns])

    def residual(rows: DataFrame) -> DataFrame:
        """Each member's n-grams outside of its pivot, with k, how many members of that pivot have them."""
        members = rows.select("rep", "n", "c", "p", "o", "u").dropDuplicates(["rep"])
        outside = members.select("rep", "n", "c", "p", "o", F.size("u").alias("size"), F.explode("u").alias("v"))
        return cut(beside(cut(outside), ["p", "v"], F.count("*").alias("k"), F.min(F.struct("rep", "n", "c")).alias("low")))

    def second_pivots(rows: DataFrame) -> DataFrame:
        """Links of members of a long column outside of their pivot (a family inside a group of copies) with its first member."""
        of = residual(rows).where(F.col("k") > column).groupBy("rep", "n", "c").agg(F.max_by("low", F.struct("k", "low")).alias("low"))
        of = of.where(F.col("low.c") != F.col("c")).select("rep", F.col("n").alias("nb"), F.col("low.rep").alias("p"), F.col("low.n").alias("na"))
        both = with_sets(of.where(_sized(percent)))
        return both.where(F.size(F.array_intersect("sx", "sp")) >= _needed(percent)).select(F.col("rep").alias("u"), F.col("p").alias("v"))

    def possible(rows: DataFrame) -> DataFrame:
        """Pairs of unconnected members of long columns that the overlaps with their pivots don't rule out.

        With one pivot p, |x & y| <= min(|x & p|, |y & p|) + |(x - p) & (y - p)|: a pair either shares
        n-grams outside of p, or both overlap p as much as the pair itself must.
        """
        apart = (F.col("ca") != F.col("cb")) & _sized(percent)
        outside = residual(rows)
        # x shares at least ceil(t * n) - o n-grams outside of p with any partner, so among its first
        # size - that + 1 of them, rarest first, one is shared
        least = F.greatest(F.ceil(F.lit(percent) * F.col("n") / 100) - F.col("o"), F.lit(1))
        order = F.row_number().over(Window.partitionBy("rep").orderBy("k", "v"))
        first = outside.withColumn("place", order).withColumn("m", F.greatest(F.col("size") - least + 1, F.lit(0))).where("place <= m AND k > 1")
        first = first.withColumn("r", F.col("size") - F.col("m"))
        shared = ends(first, "a").join(ends(first, "b"), ["p", "v"]).where("a < b").where(apart)
        shared = shared.groupBy("a", "b", "na", "nb", "oa", "ob", "ra", "rb").agg(F.count("*").alias("shared"))
        shared = shared.where(F.col("shared") + F.greatest("ra", "rb") + F.least("oa", "ob") >= _needed(percent))
        # the smaller set of a pair shares one of its early n-grams, and must itself overlap p by 2t / (1 + t)
        smaller = rows.where("early").where((100 + percent) * F.col("o") >= 2 * percent * F.col("n"))
        inside = ends(smaller, "a").join(ends(rows, "b"), ["s", "p"]).where("na < nb OR na = nb AND a < b").where(apart)
        inside = inside.where(F.least("oa", "ob") >= _needed(percent))
        # members of one column with different pivots
        several = beside(rows, ["s"], F.min("p").alias("p0"), F.max("p").alias("p1")).where("p0 <> p1 AND p <> p1").drop("p0", "p1")
        few = ends(several, "a").withColumnRenamed("p", "pa")
        across = few.join(ends(rows, "b").withColumnRenamed("p", "pb"), "s").where("pa <> pb").where(apart)
        pick = lambda x, y, name: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(name)
        across = across.select(F.least("a", "b").alias("a0"), F.greatest("a", "b").alias("b0"), pick("na", "nb", "n0"), pick("nb", "na", "n1")).toDF("a", "b", "na", "nb")
        return shared.select("a", "b", "na", "nb").union(inside.select("a", "b", "na", "nb")).union(across).distinct()

    # 4. and 5. each document against its smallest partner, the other pairs, pivots, then what is not connected yet
    nearest = pairs.groupBy("b").agg(F.min_by(F.struct("a", "na", "nb"), "a").alias("x")).select("x.a", "b", "x.na", "x.nb")
    labels = connected_components(links(nearest))
    left = tagged(tagged(pairs, "a", labels, "ca"), "b", labels, "cb").where("ca <> cb").select("a", "b", "na", "nb")
    labels = joined_components(labels, links(left))
    rows = unsettled(labels)
    if not rows.isEmpty():
        pivoted = with_pivots(rows)
        direct = pivoted.where("rep <> p").where(F.col("o") >= F.ceil(F.lit(percent) * (F.col("n") + F.col("np")) / F.lit(100 + percent)))
        labels = joined_components(labels, direct.select(F.col("rep").alias("u"), F.col("p").alias("v")))
        known = pivoted.select("rep", "p", "o", "u")
        labels = joined_components(labels, second_pivots(cut(unsettled(labels).join(known, "rep"))))
        labels = joined_components(labels, links(possible(cut(unsettled(labels).join(known, "rep")))))

    # Rows of one id are one document: all their classes are connected.
    rows = heads.select("id", "n", "s1", "s2")
    named_twice = cut(heads.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"))
    again = None
    if not named_twice.isEmpty():
        held = cut(rows.join(named_twice, "id", "left_semi").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("id", "rep").distinct())
        again = cut(held.groupBy("id").agg(F.min("rep").alias("first")))
        labels = joined_components(labels, held.join(again, "id").where("rep <> first").select(F.col("first").alias("u"), F.col("rep").alias("v")))

    of_class = tagged(classes.select("s1", "s2", "n", "rep"), "rep", labels, "c")
    least = of_class.select("c").distinct().join(classes.select(F.col("rep").alias("c"), "low"), "c")
    of_class = cut(of_class.join(least, "c").select("s1", "s2", "n", "rep", "low"))
    rows = rows.join(of_class, ["s1", "s2", "n"], "left")
    if again is not None:  # a blank row takes the component of the id's other rows
        others = again.join(of_class.select(F.col("rep").alias("first"), F.col("low").alias("other")), "first").select("id", "other")
        rows = rows.join(others, "id", "left").withColumn("low", F.coalesce("low", "other"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z za ON za.doc_id = x JOIN z zb ON zb.doc_id = y WHERE 100 * k >= 85 * (za.n + zb.n - k)),
c AS (SELECT doc_id AS x, doc_id AS r FROM d UNION SELECT l.y, c.r FROM c JOIN l ON l.x = c.x)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT x AS doc_id, min(r) AS component_id FROM c GROUP BY 1) m USING (doc_id)
"""
