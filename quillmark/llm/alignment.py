"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes of a text.

A block of an Arrow batch is worked on at once. The texts' bytes are laid end to end; the ends of all A tokens and of
all B tokens are running sums of token lengths over the whole block, each counted once by ``numpy.bincount``. Where both
counts are set, both tokenizers end a token: these cuts bound the groups. A stretch between two neighbouring ends of
either kind is the overlap of exactly one A token with one B token, a link. Running sums over the bytes, read at the
texts' byte offsets, give each text's groups and links back.

How often a pair of ids is linked in the whole corpus is a sum over blocks: each block gives its distinct pairs once,
Spark adds them up and finds the highest count of each B id (a group of at most as many rows as A has tokens). The
counts go back to blocks, not to texts: a block's distinct pairs are joined with them, and the block's texts and its
counted pairs are grouped by block, whose size is bounded by ``BLOCK_CHARS`` (or one longer text). So no group grows with
the corpus, a pair that every text holds costs one row a block, and no table of pairs is broadcast.

The tokenizer files are read where the work runs; A is a byte-level BPE in JSON, B a piece model with byte fallback that
puts a space before the text. Bytes of an A token: its entry through the byte-level alphabet; of a B piece: its UTF-8 with
U+2581 as a space, or the byte it names.

Edge cases: a text that is null or empty, or whose tokens' bytes are not a space and the text (B may change characters),
has no tokens, groups or links; strings of special tokens are ordinary text; of pairs with the same highest count each is
a best one; repeated rows are counted each; an empty table gives no rows. Other columns are passed through inside
``row``, so their names can't clash. Texts are used whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

BLOCK_CHARS = 1_000_000
BLOCK_ROWS = 2_000
KNOWN_CHARS, CHUNKS_AT_ONCE = 4_000_000, 300
_CUT = r"(?<=[\w!-/:-@\[-`{-~])(?= [\w!-/:-@\[-`{-~])"
_SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 on, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte, self.a_bytes = byte_alphabet(), [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << 31:
            raise ValueError("a pair of ids must fit into 31 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        said = lambda v, ends: np.array([[f"{k}{e}" for k in range(len(v))] for e in ends], object)
        inside = any(_SPACE in p.lstrip(_SPACE) for k, p in enumerate(pieces) if not self.b.is_byte(k))
        self.cut, self.b_space = re.compile("$^" if inside else _CUT), [self.b.piece_to_id(_SPACE)]
        self.forget()
        self.a_said, self.b_said = said(self.a_bytes, ",|"), said(self.b_bytes, [",", ";", ""])

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that weren't seen yet and notes whether the bytes of their tokens are theirs."""
        if self.known_chars > KNOWN_CHARS:
            self.forget()
        new = list(set(chunks) - self.known.keys())
        if not new:
            return
        joined = ["".join(new[k : k + CHUNKS_AT_ONCE]) for k in range(0, len(new), CHUNKS_AT_ONCE)]
        a = np.array([i for e in self.a.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.int32)
        a_ends = np.searchsorted(np.cumsum(self.a_size[a]), np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in new])) + 1
        b = [ids if c != " " else self.b_space for c, ids in zip(new, self.b.encode([c[1:] for c in new], num_threads=1), strict=True)]
        b_ends = np.cumsum([len(ids) for ids in b])
        b = np.array(list(chain.from_iterable(b)), np.int32)
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.a_flat, self.b_flat = np.concatenate([self.a_flat, a]), np.concatenate([self.b_flat, b])
        self.a_at = np.concatenate([self.a_at, self.a_at[-1] + a_ends])
        self.b_at = np.concatenate([self.b_at, self.b_at[-1] + b_ends])
        same = [self._same(new, entries, ids, ends) for entries, ids, ends in ((self.a_bytes, a, a_ends), (self.b_bytes, b, b_ends))]
        self.same = np.concatenate([self.same, same[0] & same[1]])
        self.known_chars += sum(map(len, new))

    @staticmethod
    def _same(chunks: list[str], entries: list[bytes], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which chunks are the bytes of their tokens: all at once, and one by one only if any isn't."""
        said, sizes = [entries[i] for i in ids.tolist()], [len(c) if c.isascii() else len(c.encode()) for c in chunks]
        upto = np.concatenate([[0], np.cumsum([len(x) for x in said])])[ends]
        if np.array_equal(upto, np.cumsum(sizes)) and b"".join(said) == "".join(chunks).encode():
            return np.ones(len(chunks), bool)
        return np.array([b"".join(said[i:k]) == c.encode() for c, i, k in zip(chunks, [0, *ends], ends, strict=False)])

    def forget(self) -> None:
        self.known, self.known_chars, self.same = {}, 0, np.empty(0, bool)
        self.a_flat = self.b_flat = np.empty(0, np.int32)
        self.a_at = self.b_at = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, number of each text, ids of B, number of each text); none where the bytes don't match.

        No token of either tokenizer reaches over a space that has a sign or letter at both of its sides, so texts are
        cut there and each distinct chunk is encoded once. (A starts a token there by its pattern; B has no entry with
        a space after another character, which is tested when it is read, else its texts are one chunk.)
        """
        chunks = [self.cut.split(" " + t) if t else [] for t in texts]
        every = list(chain.from_iterable(chunks))
        self.learn(every)
        k = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        text = np.repeat(np.arange(len(texts)), [len(cs) for cs in chunks])
        good = np.bincount(text, ~self.same[k], len(texts)) == 0
        k, text = k[good[text]], text[good[text]]
        a, b = self._gather(self.a_flat, self.a_at, k), self._gather(self.b_flat, self.b_at, k)
        n_a, n_b = (np.bincount(text, (at[1:] - at[:-1])[k], len(texts)).astype(np.int64) for at in (self.a_at, self.b_at))
        return a, n_a, b, n_b

    @staticmethod
    def _gather(flat: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        sizes = at[k + 1] - at[k]
        return flat[np.repeat(at[k] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].astype(np.int64)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def align_block(t: Tokenizers, texts: list[str | None]) -> dict[str, list | np.ndarray]:
    """Numbers of tokens, groups and links of each text, its groups as text, and its distinct pairs with their links."""
    a, n_a, b, n_b = t.encode(texts)
    a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    total = int(a_ends[-1]) if len(a_ends) else 0
    of_text = np.concatenate([[0], a_ends])[np.cumsum(n_a)]  # where each text's bytes end
    ends_a, ends_b = np.bincount(a_ends, minlength=total + 1) > 0, np.bincount(b_ends, minlength=total + 1) > 0
    cuts = np.cumsum(ends_a & ends_b)
    ends = np.flatnonzero(ends_a | ends_b)
    between = np.cumsum(ends_a | ends_b)

    def per_text(running: np.ndarray) -> np.ndarray:
        return np.diff(running[of_text], prepend=0)

    pair = a[np.cumsum(ends_a)[ends - 1]] * len(t.b_bytes) + b[np.cumsum(ends_b)[ends - 1]]
    n_groups, n_links = per_text(cuts), per_text(between)
    pairs, links = np.unique((np.repeat(np.arange(len(texts)), n_links) << 31) | pair, return_counts=True)
    pair_ends = np.searchsorted(pairs >> 31, np.arange(len(texts)), side="right")
    pairs = pairs & ((1 << 31) - 1)
    block_pairs, at = np.unique(pairs, return_inverse=True)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "pairs": pairs, "links": links, "pair_ends": pair_ends,
        "block_pairs": block_pairs, "block_links": np.bincount(at, links, len(block_pairs)).astype(np.int64),
        "groups": _groups(t, a, b, a_ends, b_ends, cuts, of_text, n_a + n_b),
    }


def _groups(t: Tokenizers, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray, of_text: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``: every id with the sign after it, put in place at once."""
    if not len(a):
        return [""] * len(sizes)
    group_a, group_b = cuts[a_ends - 1], cuts[b_ends - 1]
    before = lambda group: np.cumsum(np.bincount(group, minlength=int(cuts[-1])))
    out = np.empty(len(a) + len(b), object)
    last_a, last_b = cuts[a_ends] > group_a, cuts[b_ends] > group_b
    ends_text = np.zeros(len(cuts), bool)
    ends_text[of_text] = True
    out[np.arange(len(a)) + np.concatenate([[0], before(group_b)])[group_a]] = t.a_said[last_a.astype(int), a]
    out[np.arange(len(b)) + before(group_a)[group_b]] = t.b_said[np.where(ends_text[b_ends], 2, last_b), b]
    upto = np.cumsum(sizes)
    return ["".join(out[i:j].tolist()) for i, j in zip((upto - sizes).tolist(), upto.tolist(), strict=True)]


def blocks_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of blocks of rows with at most ``BLOCK_CHARS`` bytes, or one longer text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and (size + n > BLOCK_CHARS or k - first >= BLOCK_ROWS):
            yield first, k
            first, size = k, 0
        size += n
    if sizes:
        yield first, len(sizes)


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Per row its tokens', groups' and links' numbers, its groups as text, its pairs and their links, and its block.

    ``row`` holds the other columns. A pair is the A id times B's size plus the B id. The first row of a block also
    has the block's distinct pairs and their links; block numbers hold for one run, so the result is to be written
    before it is used twice.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = Tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, end in blocks_of(batch.column(1)):
                got, n = align_block(t, batch.column(1)[first:end].to_pylist()), end - first
                whole = np.full(n, len(got["block_pairs"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:end], pa.array(np.full(n, number)), *[pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                        pa.array(got["groups"], pa.string()), _lists(got["pairs"], got["pair_ends"], pa.int32()), _lists(got["links"], got["pair_ends"], pa.int32()),
                        _lists(got["block_pairs"], whole, pa.int32()), _lists(got["block_links"], whole, pa.int64()),
                    ],
                    ["row", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links", "block_pairs", "block_links"],
                )
                number += 1

    return rows.mapInArrow(
        run,
        f"row {rows.schema['row'].dataType.simpleString()}, block long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "pairs array<int>, links array<int>, block_pairs array<int>, block_links array<long>",
    )


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best) over the corpus: links that hold the pair, and if no pair of its B id has more."""
    from pyspark.sql import Window

    each = aligned.select(F.explode(F.arrays_zip("block_pairs", "block_links")).alias("z"))
    counts = each.groupBy(F.col("z.block_pairs").alias("pair")).agg(F.sum("z.block_links").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.col("pair") % b_size))
    return counts.select("pair", "count", (F.col("count") == highest).alias("best"))


def score_links(aligned: DataFrame, b_size: int) -> DataFrame:
    """The written result of ``align`` without pairs, with n_best and count_sum: links that are best, counts over links."""
    of_block = aligned.where(F.size("block_pairs") > 0).select("block", F.explode("block_pairs").alias("pair"))
    told = of_block.join(pair_counts(aligned, b_size), "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    docs = aligned.drop("block_pairs", "block_links")
    keep = [c for c in docs.columns if c not in ("pairs", "links")]

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        lists, links = texts.column("pairs").combine_chunks(), texts.column("links").combine_chunks().flatten().to_numpy().astype(np.int64)
        pair, order = found.column("pair").to_numpy(), np.argsort(found.column("pair").to_numpy())
        at = order[np.searchsorted(pair[order], lists.flatten().to_numpy())] if len(pair) else np.empty(0, int)
        text = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        add = lambda values: pa.array([int(x) for x in _sums(text, values, len(lists))], pa.int64())
        best, count = found.column("best").to_numpy(zero_copy_only=False).astype(np.int64), found.column("count").to_numpy()
        return texts.select(keep).append_column("n_best", add(links * best[at])).append_column("count_sum", add(links * count[at]))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep]
    return docs.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(score, ", ".join([*fields, "n_best long", "count_sum long"]))


def _sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers by group."""
    out = np.zeros(n, np.int64)
    np.add.at(out, group, values)
    return out


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = align(documents(spark, sf_dir, "doc_id", "text"), a_path, b_path)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    out = score_links(cut(aligned.select(*[c for c in aligned.columns if c != "groups"], sha)), b_size)
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
