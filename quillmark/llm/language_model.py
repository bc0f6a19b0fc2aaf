"""LM scoring: a gated recurrent language model with class-factored output.

What covers all training documents: the count of every token (Spark sums task counters; the table grows with the
corpus and stays in Spark), their total N and number V, the totals of each spelling group, and the recurrent weights:
all training rows are dealt by a hash of id and text into shards of about ``SHARD_TOKENS`` tokens, whose symbols are
written once. Each of ``PASSES`` rounds takes all shards: each is fitted by truncated backpropagation in numpy from the
same start (in blocks of ``TRAIN_BLOCK`` tokens), and the next start is the mean of the shards' weights by tokens, which
Spark adds up. So every training token is learned from ``PASSES`` times. Bounded:

* tokens with a share of at least ``SHARE`` of N (so 1 / ``SHARE`` at most) have symbols of their own; every other
  token is the symbol of its spelling group (a hash of its last two bytes), times its smoothed share of that group,
  (c + 1) / (N_g + V_g + 1), so that the probabilities of all known tokens and one unknown a group add up to 1;
* the counts of the ``FREQUENT`` most frequent training tokens are broadcast (a few MB); the others of a document are
  counted a document at a time and joined with the table of counts, as rows of (row, 64-bit hash, times).

Output: P(symbol) = P(class) * P(symbol in class), classes being bands of frequency, narrow where
symbols are frequent. Scoring runs documents side
by side in ``LANES`` lanes (longest first onto the shortest lane) and in windows of ``WINDOW`` steps; the state
is carried from window to window and set to zero where a document begins, so each document is scored whole.

Edge cases: a null, empty or blank text is the end token alone; without training documents N and V are 0, all
base scores 0 and the model is uniform; repeated rows are counted and scored each; rows without an id count as
training (crc32 of no text); an empty table gives no rows; other columns are not read. Texts are used whole.
"""

from __future__ import annotations

import copy
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_mod

SHARE, GROUPS, CLASSES, FREQUENT = 4e-5, 48, 32, 100_000
PASSES, SHARD_TOKENS, TRAIN_BLOCK, WEIGHTS, FAN = 3, 1_000_000, 1_000_000, 4096, 64
HIDDEN, INPUT, LANES, WINDOW = 24, 24, 512, 64
TRAIN_LANES, TRAIN_WINDOW, LEAST_STEPS = 256, 32, 64
BLOCK_TOKENS = 1_000_000
COUNTED = 400_000
END = b""
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LN10 = float(np.log(10))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end token (the empty word)."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    ws.append(END)
    return ws


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(keys, tokens of each text) of a batch (key, text), cut after every ``BLOCK_TOKENS`` tokens as they are counted:
    neither the length of words nor the rows of a batch make a block larger, only a single text can."""
    keys, docs, total = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        keys.append(key)
        docs.append(tokens(text.as_py()))
        total += len(docs[-1])
        if total >= BLOCK_TOKENS:
            yield keys, docs
            keys, docs, total = [], [], 0
    if keys:
        yield keys, docs


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % GROUPS


def token_hash(word: bytes) -> int:
    """As Spark's xxhash64 of the word."""
    import xxhash

    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(tokens(t.as_py()))
            if len(counts) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Symbols of frequent tokens (in order of frequency) and of spelling groups, with what tails need."""

    def __init__(self, words: list[bytes], counts: list[int], group_size: np.ndarray, group_kinds: np.ndarray, total: int, kinds: int):
        frequency = np.concatenate([np.array(counts, np.float64), group_size])
        names = [*words, *range(GROUPS)]
        order = np.argsort(-frequency, kind="stable")
        self.symbol = {names[j]: i for i, j in enumerate(order)}
        self.frequency = frequency[order] + 0.5
        self.end = self.symbol[END]
        self.of_group = np.array([self.symbol[g] for g in range(GROUPS)])
        self.tail = np.log10(group_size + group_kinds + 1)
        self.total, self.kinds = total, kinds

    def __len__(self) -> int:
        return len(self.frequency)


def lanes(sizes: list[int], most: int) -> list[list[int]]:
    """Documents dealt onto lanes, longest first onto the lane that is shortest so far."""
    heap = [(0, i) for i in range(max(1, min(most, len(sizes))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort([-s for s in sizes], kind="stable").tolist():
        total, i = heap[0]
        dealt[i].append(d)
        heapq.heapreplace(heap, (total + sizes[d], i))
    return dealt


def laid_out(docs: list[np.ndarray], end: int, most: int) -> tuple[np.ndarray, ...]:
    """(input, target, first, document) by step and lane; document is -1 past a lane's end."""
    dealt = lanes([len(d) for d in docs], most)
    steps = max((sum(len(docs[d]) for d in lane) for lane in dealt), default=0)
    x, y = np.full((steps, len(dealt)), end, np.int32), np.full((steps, len(dealt)), end, np.int32)
    first, doc = np.zeros((steps, len(dealt)), bool), np.full((steps, len(dealt)), -1, np.int32)
    for i, lane in enumerate(dealt):
        at = 0
        for d in lane:
            n = len(docs[d])
            y[at : at + n, i], doc[at : at + n, i], first[at, i] = docs[d], d, True
            x[at + 1 : at + n, i] = docs[d][:-1]
            at += n
    return x, y, first, doc


def busy(w: slice, x: np.ndarray, y: np.ndarray, first: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same without the lanes that are through before window w, once these are a fifth of all."""
    on = doc[w.start] >= 0
    return (x, y, first, doc, h) if 5 * on.sum() > 4 * len(on) else (x[:, on], y[:, on], first[:, on], doc[:, on], h[on])


def room(shape: tuple[int, int], kind: type = np.float32) -> tuple[np.ndarray, ...]:
    """Arrays by step and lane for what the backward pass needs: states before, gates, new states, their recurrent part."""
    return tuple(np.empty((*shape, k * HIDDEN), kind) for k in (1, 2, 1, 1))


def _exponents(e: np.ndarray, weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(log softmax at each row's own place, exponents, their sums) of products of states and weights, with a bias."""
    e += bias
    if (np.abs(weights).sum(0) + np.abs(bias)).max() > 60:  # states are in -1..1: else no exponent can overflow
        e -= e.max(1, keepdims=True)
    said = e[rows, own]
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    return said - np.log(total), e, total


class GatedModel:
    """A gated recurrent unit over symbols, with the output factored into classes (bands of symbols)."""

    def __init__(self, frequency: np.ndarray, classes: int = CLASSES, seed: int = 3):
        random, s = np.random.default_rng(seed), len(frequency)
        # bands of equal sums of square roots of frequency: of all bands, those with the fewest expected symbols a token
        roots = np.cumsum(np.sqrt(frequency))
        inner = np.searchsorted(roots, roots[-1] * np.arange(1, min(classes, s)) / min(classes, s)) if s else []
        self.bounds = np.unique([0, *inner, s]).astype(int)
        self.class_of = np.searchsorted(self.bounds, np.arange(s), side="right") - 1
        c = len(self.bounds) - 1
        small = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        of_class = np.add.reduceat(frequency, self.bounds[:-1])
        self.p = {
            "E": small(s, INPUT), "W": small(INPUT, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "U": small(HIDDEN, 3 * HIDDEN),
            "C": small(HIDDEN, c), "cb": np.log(of_class / of_class.sum()).astype(np.float32),
            "S": small(s, HIDDEN), "sb": np.log(frequency / of_class[self.class_of]).astype(np.float32),
        }

    def run(self, gates: np.ndarray, x: np.ndarray, first: np.ndarray, h: np.ndarray, kept: tuple | None = None) -> np.ndarray:
        """States after each step, from state h on."""
        n, out, u = HIDDEN, np.empty((*x.shape, HIDDEN), h.dtype), self.p["U"]
        again = (~first).astype(h.dtype)[:, :, None]
        for t in range(len(x)):
            h = h * again[t]
            a, g = gates[x[t]], h @ u
            zr = a[:, : 2 * n] + g[:, : 2 * n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new = zr[:, n:] * g[:, 2 * n :]
            new += a[:, 2 * n :]
            np.tanh(new, out=new)
            if kept is not None:
                for of, value in zip(kept, (h, zr, new, g[:, 2 * n :]), strict=True):
                    of[t] = value
            h = np.add(new, zr[:, :n] * (h - new), out=out[t])
        return out

    def gates(self) -> np.ndarray:
        return self.p["E"] @ self.p["W"] + self.p["b"]

    def log_probability(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(y) at states h; with grads, adds gradients of the loss, times scale, and returns that of h."""
        p, k = self.p, self.class_of[y]
        order = np.argsort(k.astype(np.uint8), kind="stable")  # by class; classes are at most 256
        h, y, k, rows = h[order], y[order], k[order], np.arange(len(y))
        said, e, total = _exponents(h @ p["C"], p["C"], p["cb"], rows, k)
        dh = None
        if grads is not None:
            e *= (scale / total)[:, None]
            e[rows, k] -= scale
            grads["C"] += h.T @ e
            grads["cb"] += e.sum(0)
            dh = e @ p["C"].T
        ends = np.searchsorted(k, np.arange(len(self.bounds)), side="left")
        for c in range(len(self.bounds) - 1):
            at = slice(ends[c], ends[c + 1])
            if at.start == at.stop:
                continue
            lo, hi = self.bounds[c], self.bounds[c + 1]
            rows_c, own_c, hc, s = rows[: at.stop - at.start], y[at] - lo, h[at], p["S"][lo:hi]
            own, e, total = _exponents(hc @ s.T, s.T, p["sb"][lo:hi], rows_c, own_c)
            said[at] += own
            if grads is not None:
                e *= (scale / total)[:, None]
                e[rows_c, own_c] -= scale
                grads["S"][lo:hi] += e.T @ hc
                grads["sb"][lo:hi] += e.sum(0)
                dh[at] += e @ s
        out = np.empty_like(said)
        out[order] = said
        if dh is None:
            return out, None
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def backward(self, x: np.ndarray, first: np.ndarray, kept: tuple, dout: np.ndarray, grads: dict) -> None:
        """Adds the gradients of one window, from its last step to its first."""
        n, ut, shape = HIDDEN, self.p["U"].T.copy(), (*x.shape, 3, HIDDEN)
        h, zr, new, gn = kept
        z, r = zr[..., :n], zr[..., n:]
        # what a state's gradient is multiplied by to give those of the sums inside z, r and the new state
        of_a = np.empty(shape, dout.dtype)
        np.multiply(1 - z, 1 - new * new, out=of_a[:, :, 2])
        np.multiply(of_a[:, :, 2] * gn, r * (1 - r), out=of_a[:, :, 1])
        np.multiply(h - new, z * (1 - z), out=of_a[:, :, 0])
        of_g = of_a.copy()
        of_g[:, :, 2] *= r
        again, dh, dhs = (~first).astype(dout.dtype)[:, :, None], np.zeros_like(dout[0]), dout.copy()
        for t in range(len(x) - 1, -1, -1):
            dhs[t] += dh
            of_g[t] *= dhs[t][:, None, :]
            dh = (dhs[t] * z[t] + of_g[t].reshape(-1, 3 * n) @ ut) * again[t]
        of_a *= dhs[:, :, None, :]
        grads["U"] += h.reshape(-1, n).T @ of_g.reshape(-1, 3 * n)
        # the gradients of the gates, added up a symbol
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        symbols, starts = np.unique(x.ravel()[order], return_index=True)
        of = np.add.reduceat(of_a.reshape(-1, 3 * n)[order], starts)
        grads["E"][symbols] += of @ self.p["W"].T
        grads["W"] += self.p["E"][symbols].T @ of
        grads["b"] += of.sum(0)

    def fit(self, docs: list[np.ndarray], end: int, state: dict, turn: int = 0, rate: float = 0.02) -> None:
        """Truncated backpropagation through time with Adam, once over docs, in round turn of PASSES; state is carried
        from one block of a shard to the next."""
        most = int(np.clip(sum(map(len, docs)) // (TRAIN_WINDOW * LEAST_STEPS), 4, TRAIN_LANES))
        x, y, first, doc = laid_out(docs, end, most)
        if not state:
            state |= {"m": {k: np.zeros_like(w) for k, w in self.p.items()}, "v": {k: np.zeros_like(w) for k, w in self.p.items()}, "step": 0}
        m, v, step = state["m"], state["v"], state["step"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        at = upto = 0
        while upto < len(x):
            # a window is longer where few lanes are left, so that updates are of about as many tokens
            at, upto = upto, upto + TRAIN_WINDOW * int(np.clip(most // x.shape[1], 1, 8))
            w = slice(at, upto)
            x, y, first, doc, h = busy(w, x, y, first, doc, h)
            real = doc[w] >= 0
            grads, kept = {k: np.zeros_like(g) for k, g in self.p.items()}, room(x[w].shape)
            states = self.run(self.gates(), x[w], first[w], h, kept)
            # of the summed loss: those of the mean are small enough for their squares to lose digits
            _, dh = self.log_probability(states[real], y[w][real], grads)
            dout = np.zeros_like(states)
            dout[real] = dh
            self.backward(x[w], first[w], kept, dout, grads)
            h, step = states[-1], step + 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / real.sum()
            lr = np.float32(rate * np.sqrt(real.sum() / (most * TRAIN_WINDOW)) * min(1.0, 1.0 / max(norm, 1e-9)) * (1 - 0.9 * (turn + at / len(x)) / PASSES))
            of_m, of_v = np.float32(1 / (1 - 0.9**step)), np.float32(1 / (1 - 0.99**step))
            for k, g in grads.items():
                m[k] += np.float32(0.1) * (g - m[k])
                v[k] += np.float32(0.01) * (g * g - v[k])
                self.p[k] -= lr * of_m * m[k] / (np.sqrt(of_v * v[k]) + np.float32(1e-8))
        state["step"] = step

    def flat(self) -> np.ndarray:
        """All weights, one after the other."""
        return np.concatenate([w.ravel() for w in self.p.values()])

    def take(self, flat: np.ndarray) -> None:
        """Weights as flat() gives them."""
        at = 0
        for k, w in self.p.items():
            self.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """log10 probability of each document's symbols."""
        x, y, first, doc = laid_out(docs, end, LANES)
        out, gates, h = np.zeros(len(docs)), self.gates(), np.zeros((x.shape[1], HIDDEN), np.float32)
        for at in range(0, len(x), WINDOW):
            w = slice(at, at + WINDOW)
            x, y, first, doc, h = busy(w, x, y, first, doc, h)
            states = self.run(gates, x[w], first[w], h)
            h, real = states[-1], doc[w] >= 0
            out += np.bincount(doc[w][real], self.log_probability(states[real], y[w][real])[0], len(docs))
        return out / _LN10


class Lexicon:
    """What is known of frequent tokens, by their place in a list, for whole blocks of tokens at once."""

    def __init__(self, vocabulary: Vocabulary, frequent: dict[bytes, int]):
        words = list(frequent.keys() | (vocabulary.symbol.keys() - set(range(GROUPS))))
        self.place, self.of_group = {w: i for i, w in enumerate(words)}, vocabulary.of_group
        groups = np.array([group_of(w) for w in words], np.int64)
        own = np.array([w in vocabulary.symbol for w in words], bool)
        self.symbols = np.array([vocabulary.symbol[w] if w in vocabulary.symbol else self.of_group[g] for w, g in zip(words, groups, strict=True)], np.int32)
        self.log = np.array([np.log10(frequent.get(w, 0) + 1) for w in words], np.float64)
        self.known = np.array([frequent.get(w, 0) > 0 for w in words], bool)
        # of tokens in a spelling group: log10(c + 1) less the group's total (of rare ones log10(c + 1) comes by the join)
        self.share = np.where(own, 0.0, self.log - vocabulary.tail[groups])
        self.tail = vocabulary.tail

    def read(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(place of each token or -1, symbols, tokens without a place, their groups), all docs in a row."""
        get = self.place.get
        at = np.array([get(w, -1) for ws in docs for w in ws], np.int32)
        symbols = self.symbols[at]
        missing = np.flatnonzero(at < 0)
        flat = [w for ws in docs for w in ws] if len(missing) else []
        rare = [flat[i] for i in missing.tolist()]
        groups = np.array([group_of(w) for w in rare], np.int64)
        symbols[missing] = self.of_group[groups]
        return at, symbols, rare, groups


def shards(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(shard, h, symbols as unsigned 16-bit numbers) of all rows of docs (id, text), a shard in one file and in order of h."""
    spark, n = docs.sparkSession, max(1, round(vocabulary.total / SHARD_TOKENS))
    sent = spark.sparkContext.broadcast(Lexicon(vocabulary, {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # deals rows of the same id and text out over the shards

        def written(keys: list[int], docs: list[list[bytes]]) -> pa.RecordBatch:
            symbols = sent.value.read(docs)[1].astype(np.uint16)
            parts = [x.tobytes() for x in np.split(symbols, np.cumsum([len(d) for d in docs])[:-1])]
            dealt = []
            for h in keys:
                dealt.append((h + seen[h]) % n)
                seen[h] += 1
            return pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["shard", "h", "symbols"])

        for batch in batches:
            for keys, docs in blocks(batch):
                yield written(keys, docs)

    rows = docs.select(F.xxhash64("id", "text").alias("h"), "text").mapInArrow(run, "shard int, h long, symbols binary")
    return cut(rows.repartition(n, "shard").sortWithinPartitions("shard", "h"))


def fit_round(parts: DataFrame, model: GatedModel, end: int, turn: int) -> int:
    """Sets the weights to the mean, by tokens, of those fitted to each shard of parts from the present ones; returns the tokens."""
    sent = parts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed, seen = np.zeros(sent.value.flat().size), 0
        own, state, shard, block, size, read = None, {}, None, [], 0, 0
        start = sent.value.p

        def end_block() -> None:
            nonlocal block, size, read
            if block:
                own.fit(block, end, state, turn)
            block, size, read = [], 0, read + size

        def end_shard() -> None:
            nonlocal seen, summed, read
            end_block()
            if read:
                summed += own.flat() * float(read)
            seen, read = seen + read, 0

        for batch in batches:
            for s, symbols in zip(batch.column("shard").to_pylist(), batch.column("symbols"), strict=True):
                if s != shard:
                    end_shard()
                    own, state, shard = copy.copy(sent.value), {}, s
                    own.p = {k: w.copy() for k, w in start.items()}
                block.append(np.frombuffer(symbols.as_py(), np.uint16))
                size += len(block[-1])
                if size >= TRAIN_BLOCK:
                    end_block()
        end_shard()
        if seen:
            sums = [summed[i : i + WEIGHTS].tobytes() for i in range(0, len(summed), WEIGHTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([seen] * len(sums), pa.int64()), pa.array(sums, pa.binary())], ["k", "n", "w"])

    def add(table: pa.Table) -> pa.Table:
        w = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("w"))
        return pa.table({"k": table.column("k").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "w": pa.array([w.tobytes()], pa.binary())})

    fitted = parts.select("shard", "symbols").mapInArrow(run, "k int, n long, w binary")
    # the weights of FAN tasks are added up first, then those sums
    some = fitted.withColumn("fan", F.floor(F.spark_partition_id() / FAN)).groupBy("k", "fan").applyInArrow(add, "k int, n long, w binary")
    got = sorted(some.groupBy("k").applyInArrow(add, "k int, n long, w binary").collect())
    if not got:
        return 0
    model.take(np.concatenate([np.frombuffer(bytes(r.w), np.float64) for r in got]) / got[0].n)
    return got[0].n


def learn(docs: DataFrame) -> tuple[Vocabulary, dict[bytes, int], GatedModel, DataFrame]:
    """(vocabulary, counts of frequent tokens, model, table of (hash, c) of the other tokens) from docs (id, text)."""
    counts = cut(count_tokens(docs))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    words, numbers = top.column("word").to_pylist(), top.column("c").to_pylist()
    own, own_counts = [list(x) for x in zip(*[(w, c) for w, c in zip(words, numbers, strict=True) if c >= SHARE * total])] or ([], [])
    if END not in own:
        own, own_counts = [*own, END], [*own_counts, dict(zip(words, numbers, strict=True)).get(END, 0)]
    names = docs.sparkSession.createDataFrame([(bytearray(w),) for w in own], "word binary")
    group = F.pmod(F.crc32(F.when(F.length("word") > 2, F.expr("substring(word, length(word) - 1, 2)")).otherwise(F.col("word"))), F.lit(GROUPS))
    groups = counts.join(F.broadcast(names), "word", "left_anti").groupBy(group.alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    size, kinds_in = np.zeros(GROUPS), np.zeros(GROUPS)
    size[groups.g], kinds_in[groups.g] = groups.n, groups.v
    vocabulary = Vocabulary(own, own_counts, size, kinds_in, total, kinds)
    frequent = dict(zip(words, numbers, strict=True))
    model = GatedModel(vocabulary.frequency)
    if total:
        parts = shards(docs, vocabulary)
        for turn in range(PASSES):
            fit_round(parts, model, vocabulary.end, turn)
    held = docs.sparkSession.createDataFrame([(token_hash(w),) for w in words], "h long") if words else None
    others = counts.select(F.xxhash64("word").alias("h"), "c")
    return vocabulary, frequent, model, others.join(F.broadcast(held), "h", "left_anti") if held is not None else others


def score_block(keys: list[int], docs: list[list[bytes]], lexicon: Lexicon, end: int, model: GatedModel) -> pa.RecordBatch:
    """What is known of a block of documents: numbers of tokens, sums of logarithms, their rare tokens, the model's score."""
    size = np.array([len(ws) for ws in docs])
    ends = np.cumsum(size)
    at, symbols, rare, groups = lexicon.read(docs)
    missing = np.flatnonzero(at < 0)
    known, inside, share = lexicon.known[at].astype(np.int64), lexicon.log[at], lexicon.share[at]
    known[missing], inside[missing], share[missing] = 0, 0.0, -lexicon.tail[groups]
    known, inside, share = (np.add.reduceat(x, ends - size) for x in (known, inside, share))
    found = np.searchsorted(missing, np.concatenate([[0], ends]))
    # a token of a document is one row (hash, times) of the join
    hashed = np.array([token_hash(w) for w in rare], np.int64)
    parts = [np.unique(hashed[i:j], return_counts=True) for i, j in zip(found[:-1], found[1:], strict=True)]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]), pa.int32())
    hashes, times = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in zip(*parts, strict=True))
    neural = model.score(np.split(symbols, ends[:-1]), end)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(size), pa.array(known), pa.array(inside), pa.array(share), hashes, times, pa.array(neural)],
        ["id", "n_tokens", "known", "inside", "share", "rare", "times", "neural"],
    )


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score and score; training marks the rows to learn from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), training.alias("training"))
    vocabulary, frequent, model, others = learn(rows.where("training").select("id", "text"))
    sent = docs.sparkSession.sparkContext.broadcast((Lexicon(vocabulary, frequent), vocabulary.end, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, end, model = sent.value

        for batch in batches:
            for keys, docs in blocks(batch):
                yield score_block(keys, docs, lexicon, end, model)

    done = rows.select("id", "text").mapInArrow(run, "id long, n_tokens long, known long, inside double, share double, rare array<long>, times array<long>, neural double")
    done = cut(done.withColumn("row", F.monotonically_increasing_id()))
    held = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), "x.times")
    found = held.join(others, "h").groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    out = done.drop("rare", "times").join(found, "row", "left").na.fill({"k": 0, "more": 0.0})
    whole = float(np.log10(vocabulary.total + 1 * (vocabulary.kinds + 1)))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.col("k")).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("inside") + F.col("more") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("neural") + F.col("share") + F.col("more")).alias("score"),
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: id_mod(F.col(c), 7) == 2
    out = score_documents(documents(spark, sf_dir, "doc_id", "text"), ~held_out("doc_id"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
