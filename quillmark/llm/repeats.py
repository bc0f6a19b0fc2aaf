"""Removal of long repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Two equal strings must
meet in one task, whatever documents they stand in, and no task may get an unbounded group:

1. Every window of ``length`` bytes names its minimizer, the 32-byte gram of least hash inside it. Equal windows
   name equal grams at equal places, so only windows of one gram can be equal. The windows that share one
   minimizer follow each other; their bytes are a segment. Segments are a hundredth of the text in rows.
2. Grams are counted alone first, so that those of one occurrence, most of the text, drop out before anything else of
   a segment is shuffled or written. Equal segments of the other grams are collapsed and counted (map-side first). A
   segment that occurs twice is repeated as a whole.
3. Grams with different segments go, as blocks of about ``BLOCK_BYTES``, through a Burrows-Wheeler transform
   each. Starting from strings of eight bytes, the intervals of all longer strings, byte by byte, are found breadth
   first by extension to the left; the first interval that ends at a place of the suffix order fixes the common
   prefix there, in increasing order. At the minimum length the search stops: suffixes between two fixed
   places share a prefix of at least that length, so windows that stand together there are repeated.
   (The suffix order is needed to that length only, and intervals of shorter strings are right under any order
   of longer ties.)
4. A gram of over ``MOST_SEGMENTS`` different segments (the edge of a passage in very many documents) would
   make a block too large; its windows are told apart by their own 128-bit hashes, in rows that Spark counts.
5. Each segment's repeated windows are joined back to all its occurrences, and a last pass cuts the texts.

Texts become Python objects in slices of about ``SLICE_BYTES``, as a worker keeps the memory of its largest step.
Tables of places are broadcast if they have at most ``BROADCAST_BYTES`` bytes, else joined by a shuffle. Bitmaps of keys
(``MOST_BITS`` bits, 32 MB at most, broadcast) keep rows of grams that occur once, and texts without places, out of
shuffles; what they let through is joined exactly, so more keys than bits cost shuffles, not results.

Edge cases: a null text counts as empty; texts shorter than ``length`` lose nothing; overlapping repeats inside
one document count; rows with equal ids and equal texts are two documents, so both go (from length on); rows
without an id are documents too, told apart by two 64-bit hashes of their texts; an empty table gives no rows; other columns are not read. Texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

GRAM = 32
BLOCK_BYTES = 1 << 20
MOST_SEGMENTS = 4096
SLICE_BYTES = 1 << 21
BROADCAST_BYTES, KEY_BYTES, ROW_BYTES = 32 << 20, 64, 40  # of an entry's key and of one of its places
MOST_BITS, _BUCKET = 1 << 28, 1 << 15
_PIECE, _TOGETHER = 1 << 23, 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
_RANDOM = np.random.default_rng(9)
_OF_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**64, 12, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of each 32-byte gram."""
    h = _OF_BYTE[x]
    for i, step in enumerate((1, 2, 4, 8, 16)):
        h = h[:-step] * _FACTORS[i] + h[step:]
    return _mixed(h)


def _ranges(x: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, hash of the segment, first window, last window) of texts that stand one after the other in x."""
    h = grams(x)
    a = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while 2 * step <= width:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    if width > step:
        a = np.minimum(a[: len(a) - (width - step)], a[width - step :])
    at = (a & _PLACE).astype(np.int64)
    # windows that run over the end of their text are none; a gram of the next text begins a segment of its own
    inside = np.ones(len(at), bool)
    for end in starts[1:].tolist():
        inside[max(end - length + 1, 0) : end] = False
    window = np.flatnonzero(inside)
    at = at[window]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))[: len(at)]
    lo, hi = window[first], window[np.concatenate([first[1:], [len(at)]])[: len(first)] - 1]
    size = hi - lo + length
    s = _mixed(h[hi + length - GRAM] + size.astype(np.uint64) * _FACTORS[5])
    for k in range(2 * length // GRAM + 1):
        more = np.flatnonzero((k + 1) * GRAM <= size)
        s[more] = _mixed(s[more] * _FACTORS[6] + h[lo[more] + k * GRAM])
    return h[at[first]].view(np.int64), s.view(np.int64), lo, hi


def all_segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(gram, hash of the segment, number of the text, first window, last window) of all segments of texts.

    Short texts are read together, so many that their hashes stay in a cache; long ones in pieces of ``_PIECE`` windows.
    """
    found, some, size = [np.empty((5, 0), np.int64)], [], 0

    def read(some: list[int], base: int = 0) -> None:
        raw = texts[some[0]][base : base + _PIECE + length - 1] if len(some) == 1 else b"".join(texts[i] for i in some)
        sizes = np.array([len(texts[i]) for i in some])
        starts = np.cumsum(sizes) - sizes
        g, s, lo, hi = _ranges(np.frombuffer(raw, np.uint8), starts, length)
        of = np.searchsorted(starts, lo, side="right") - 1
        found.append(np.stack([g, s, np.array(some)[of], lo - starts[of] + base, hi - starts[of] + base]))

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > _PIECE:
            for base in range(0, len(t) - length + 1, _PIECE):
                read([i], base)
            continue
        if some and size + len(t) > _TOGETHER:
            read(some)
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        read(some)
    return tuple(np.concatenate(found, axis=1))


def segments(x: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, hash of the segment, first window, last window) of a text's segments."""
    g, s, _, lo, hi = all_segments([x.tobytes()], length)
    return g, s, lo, hi


def first_bytes(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros past the end)."""
    key = np.zeros(len(x) + 7, np.uint64)
    key[: len(x)] = x
    for size in (1, 2, 4):
        part = key[:-size] << np.uint64(8 * size)
        part |= key[size:]
        key = part
    return key


def suffix_order(x: np.ndarray, length: int) -> np.ndarray:
    """Start places in the order of their first ``length`` bytes at least (the text is followed by zeros)."""
    n, bits = len(x), int(len(x)).bit_length()  # of a rank; two of them and a place are one number, if they fit
    kind = np.int32 if bits < 32 else np.int64
    held = first_bytes(x)
    order = np.argsort(held).astype(kind)  # equal keys may stand in any order
    rank, slots = np.zeros(n + 1, kind), np.arange(n, dtype=kind)
    held, step = held[order], 8
    while True:
        # rank: one more than the first slot of all equal ones; 0 past the end
        heads = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))[: len(held)].astype(kind)
        del held
        sizes = np.diff(np.concatenate([heads, [len(slots)]]))
        rank[order[slots]] = np.repeat(slots[heads] + 1, sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]  # those that are alone have their place
        if step >= length or not len(slots):
            return order
        at = order[slots]
        held = rank[at].astype(np.int64)
        held <<= bits
        held |= rank[np.minimum(at + step, n)]
        if bits <= 21:
            held <<= bits
            held |= at
            held.sort()
            at = (held & ((1 << bits) - 1)).astype(kind)
            held >>= bits
        else:
            by = np.argsort(held)
            held, at = held[by], at[by]
        order[slots] = at
        step *= 2


def prefix_borders(x: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """border[i]: suffixes i - 1 and i of the order share less than ``length`` bytes (border[0] and [n] hold).

    Breadth-first extension to the left over the Burrows-Wheeler transform; an interval is (first, last). It begins
    with strings of eight bytes, as one number tells those apart: the intervals that the shorter ones would have left.
    """
    n = len(x)
    bwt = x[order - 1]  # of place 0: the last byte, a closing mark
    step_left = np.empty(n, order.dtype)
    step_left[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=order.dtype)
    key = first_bytes(x)[order]
    border = np.concatenate([[True], key[1:] != key[:-1], [True]])
    # the others end where already strings of seven bytes do
    key >>= np.uint64(8)
    ends = np.flatnonzero(border).astype(order.dtype)
    first, last = ends[:-1], ends[1:] - 1
    new = np.flatnonzero(key[last[:-1]] == key[first[1:]])
    first, last = first[new], last[new]
    del key, ends
    for _ in range(8, length):  # the intervals at hand are of strings of this length
        size = last - first + 1
        one, a = first[size == 1], first[size == 2]
        same = bwt[a] == bwt[a + 1]
        left, right = step_left[a], step_left[a + 1]
        apart = ~same
        a, size = first[size > 2], size[size > 2]
        where = np.repeat(a - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        # by interval and byte, then place: one number each, as a block has far less than 2 ** 24 places
        tag = np.repeat(np.arange(len(a)), size)
        for bits, part in ((8, bwt[where]), (31, where)):
            tag <<= bits
            tag |= part
        tag.sort()
        where = (tag & ((1 << 31) - 1)).astype(order.dtype)
        tag >>= 31
        head = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))[: len(tag)]
        tail = np.concatenate([head[1:], [len(tag)]])[: len(head)] - 1
        first = np.concatenate([step_left[one], left, right[apart], step_left[where[head]]])
        last = np.concatenate([first[: len(one)], np.where(same, right, left), right[apart], step_left[where[tail]]])
        new = ~border[last + 1]
        first, last = first[new], last[new]
        if not len(first):
            break
        border[last + 1] = True
    return border


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text of a block: which of its windows start in two or more places of the block.

    A mark closes each text, so what windows share never runs over the end of a text.
    """
    x, starts = _joined(texts)
    order = suffix_order(x, length)
    border = prefix_borders(x, order, length)
    alone = border[:-1] & border[1:]
    twice = np.empty(len(x), bool)
    twice[order] = ~alone
    return [twice[s : s + len(t) - length + 1] for s, t in zip(starts, texts, strict=True)]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each closed by a mark that no text holds, as bytes."""
    used = np.zeros(256, bool)
    whole = b"".join(texts)
    used[np.frombuffer(whole, np.uint8)] = True
    if used.all():
        raise ValueError("UTF-8 text never holds every byte")
    mark = bytes([int(np.flatnonzero(~used)[0])])
    sizes = np.array([len(t) for t in texts])
    return np.frombuffer(mark.join([*texts, b""]), np.uint8), np.cumsum(sizes + 1) - sizes - 1


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return edge[::2], edge[1::2] - 1


def _raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, without a copy, in slices of at most ``SLICE_BYTES`` bytes of their column text, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            most = (ends[at - 1] if at else 0) + SLICE_BYTES
            upto = max(at + 1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def gram_counts(docs: DataFrame, length: int) -> DataFrame:
    """(gram, n): how many segments name each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            g, n = np.unique(all_segments([_raw(t) for t in batch.column(0).to_pylist()], length)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n, pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(gram, s, id, h, lo, hi): every segment of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            g, s, i, lo, hi = all_segments([_raw(t) for t in batch.column(2).to_pylist()], length)
            i = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), batch.column(0).take(i), batch.column(1).take(i), pa.array(lo), pa.array(hi)], ["gram", "s", "id", "h", "lo", "hi"])

    return docs.select("id", "h", "text").mapInArrow(run, "gram long, s long, id long, h long, lo long, hi long")


def marks(keys: DataFrame, *cols: str) -> tuple[int, DataFrame]:
    """(number of bits, table of bitmaps by bucket): a bit a key's hash is set, out of 8 to 16 a key, ``MOST_BITS`` at most."""
    bits = min(MOST_BITS, max(_BUCKET, 1 << int(8 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*cols), F.lit(bits))
    slots = keys.select(F.floor(slot / _BUCKET).alias("bucket"), (slot % _BUCKET).alias("bit")).repartition("bucket")
    return bits, cut(slots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")))


def marked(df: DataFrame, of: tuple[int, DataFrame], *cols: str) -> DataFrame:
    """df with a column may: false for rows whose key is certainly none of those marked. Nothing is shuffled."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(of[0]))
    byte = F.substring("map", F.floor(F.col("slot") % _BUCKET / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (F.col("slot") % 8).cast("int"))
    df = df.withColumn("slot", slot).withColumn("bucket", F.floor(F.col("slot") / _BUCKET)).join(F.broadcast(of[1]), "bucket", "left")
    return df.withColumn("may", F.coalesce(bit == 1, F.lit(False))).drop("slot", "bucket", "map")


def _with_places(docs: DataFrame, places: DataFrame, places_col: str, how: str = "inner") -> DataFrame:
    """docs joined with a table of one row a text of an id (id, h), broadcast if its places are few; else only those
    texts are shuffled that a bitmap of the table's keys doesn't rule out."""
    places = cut(places)
    size = places.agg(F.coalesce(F.sum(KEY_BYTES + ROW_BYTES * F.size(places_col)), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(places), ["id", "h"], how)
    told = marked(docs, marks(places, "id", "h"), "id", "h")
    rows = told.where("may").drop("may").join(places, ["id", "h"], how)
    if how == "left":
        rows = rows.unionByName(told.where(~F.col("may")).drop("may"), allowMissingColumns=True)
    return rows


def cut_out(docs: DataFrame, spots: DataFrame, length: int) -> DataFrame:
    """(gram, s, id, h, lo, bytes) of the segments at spots (gram, s, id, h, lo, hi)."""
    places = spots.groupBy("id", "h").agg(F.collect_list(F.struct("gram", "s", "lo", "hi")).alias("spots"))
    rows = _with_places(docs, places, "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # rows of one id and text hold the same spots; each is sent once a task
        for batch in slices(batches, 2):
            out = [[] for _ in range(6)]
            for key, h, text, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, h) in done:
                    continue
                done.add((key, h))
                raw = _raw(text)
                for p in spots:
                    for c, v in zip(out, (p["gram"], p["s"], key, h, p["lo"], raw[p["lo"] : p["hi"] + length]), strict=True):
                        c.append(v)
            kinds = [*[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["gram", "s", "id", "h", "lo", "bytes"])

    return rows.select("id", "h", "text", "spots").mapInArrow(run, "gram long, s long, id long, h long, lo long, bytes binary")


def expand_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """(gram, s, bytes) by gram -> (gram, s, a, b): runs of repeated windows, counted from the segment's first."""

    def solved(block: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        out = [[] for _ in range(4)]
        for (g, s, _), flags in zip(block, repeated_starts([x[2] for x in block], length), strict=True):
            for a, b in zip(*(x.tolist() for x in _runs(flags)), strict=True):
                for c, v in zip(out, (g, s, a, b), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["gram", "s", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, last = [], 0, None
        for batch in batches:
            for g, s, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != last and total >= BLOCK_BYTES:
                    yield solved(block)
                    block, total = [], 0
                if block and block[-1][:2] == (g, s):
                    continue  # the same segment again (a repeated row)
                block.append((g, s, raw))
                total += len(raw)
                last = g
        if block:
            yield solved(block)

    return pieces.select("gram", "s", "bytes").repartition("gram").sortWithinPartitions("gram", "s").mapInArrow(run, "gram long, s long, a long, b long")


def window_hashes(pieces: DataFrame, length: int) -> DataFrame:
    """(w1, w2, id, h, lo): every window of the given segments with a 128-bit hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, (lo, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                g = grams(np.frombuffer(raw, np.uint8))
                n = len(raw) - length + 1
                w1, w2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for at in [*range(0, length - GRAM, GRAM), length - GRAM]:
                    w1, w2 = _mixed(w1 * _FACTORS[7] + g[at : at + n]), _mixed(w2 * _FACTORS[8] ^ (g[at : at + n] * _FACTORS[9]))
                parts.append((w1.view(np.int64), w2.view(np.int64), np.full(n, i), np.arange(lo, lo + n)))
            w1, w2, i, lo = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 4
            i = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), batch.column(0).take(i), batch.column(1).take(i), pa.array(lo)], ["w1", "w2", "id", "h", "lo"])

    return pieces.select("id", "h", "lo", "bytes").mapInArrow(run, "w1 long, w2 long, id long, h long, lo long")


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """(id, h, start, end): stretches of bytes covered by repeated windows; they may overlap."""
    place = F.struct("id", "h", "lo", "hi")
    grams_kept = marks(cut(gram_counts(docs, length).where("n > 1").select("gram")), "gram")  # rows of other grams stay where they are

    def kept() -> DataFrame:
        return marked(occurrences(docs, length), grams_kept, "gram").where("may").drop("may")

    distinct = cut(kept().groupBy("gram", "s").agg(F.count("*").alias("c"), F.min(place).alias("at")))
    of_gram = cut(distinct.groupBy("gram").agg(F.sum("c").alias("n"), F.count("*").alias("kinds")).where("n > 1"))
    shared = cut(distinct.join(of_gram, "gram").select("gram", "s", "c", "kinds", "at.*"))
    whole = shared.where("c > 1").select("gram", "s", F.lit(0).cast("long").alias("a"), (F.col("hi") - F.col("lo")).alias("b"))
    mixed = shared.where(F.col("kinds").between(2, MOST_SEGMENTS))
    parts = expand_blocks(cut_out(docs, mixed, length), length)
    flagged = cut(whole.unionByName(parts))
    runs = kept().join(flagged, ["gram", "s"]).select("id", "h", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + length).alias("end"))
    many = cut(shared.where(F.col("kinds") > MOST_SEGMENTS).where("c = 1"))
    if not many.isEmpty():
        # Segments that occur once, and one occurrence of those that occur twice, so that their windows meet.
        again = shared.where(F.col("kinds") > MOST_SEGMENTS).where("c > 1")
        windows = cut(window_hashes(cut_out(docs, many.unionByName(again), length), length))
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        runs = runs.unionByName(windows.join(twice, ["w1", "w2"]).select("id", "h", F.col("lo").alias("start"), (F.col("lo") + length).alias("end")))
    return runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no id"), text))  # with h: 128 bits of hash
    docs = docs.select(key.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), F.col(id_col).cast("long").alias("given"))
    # Rows of one id and text have the same runs, which count once: a group is never larger than one text's runs.
    by_doc = repeated_runs(docs, length).groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    rows = _with_places(docs, by_doc, "runs", "left").select("given", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = [[] for _ in range(6)]
            for given, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, kept, at, gone, spans = _raw(text), [], 0, 0, 0
                end = 0
                for r in sorted((r["start"], r["end"]) for r in runs or ()):
                    if r[0] > end or not spans:
                        kept.append(raw[end : r[0]] if spans else raw[: r[0]])
                        spans += 1
                        at = r[0]
                        gone += r[1] - at
                        end = r[1]
                    elif r[1] > end:
                        gone += r[1] - end
                        end = r[1]
                kept.append(raw[end:])
                left = b"".join(kept)
                for c, v in zip(out, (given, len(raw), gone, spans, hashlib.sha256(left).hexdigest(), left), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text")).drop("kept")
