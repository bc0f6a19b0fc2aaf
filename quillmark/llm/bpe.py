"""Byte-level BPE encoding and decoding with DuckDB queries inside each partition.

The rank file is read once by the driver and broadcast (under 1 MB). In a task, texts are cut at single
spaces and line ends, and every distinct chunk of a block is split by the tokenizer's pattern and encoded
once (a text with other or repeated white space is split whole):

* a piece that is itself a token takes its rank;
* all others become words of byte ids in DuckDB. A recursive query unnests them into token-position rows,
  joins neighbours with the merge table (left id, right id -> rank of the joined bytes), contracts each word's
  leftmost pair of minimum rank, and goes on with the words that still had a pair.
* Pieces of over ``LONG_PIECE`` bytes are a table, all of a block together (``LONG_BYTES_A_QUERY`` bytes; a longer
  piece alone), which each round replaces. A round contracts every pair that no merge near it can forestall (no token
  that a pair within reach of the longest token could become part of has a lower rank) and each piece's leftmost pair
  of minimum rank, which gives the tokens of one contraction at a time in rounds that hardly depend on the length.

The merge table holds every split of every token into two tokens, which makes the joins equal to looking the
joined bytes up among the ranks. Decoding joins (document, position, id) rows with the vocabulary and
aggregates the bytes of each document in order of position.

Blocks are bounded by characters (``BLOCK_CHARS``; a longer text is a block of its own), DuckDB by
``memory_limit`` and one thread, and the caches by counts, so memory doesn't grow with the partition. There is
no shuffle, and a lost task is simply run again.

Edge cases: a null or empty text has no tokens and decodes to no bytes; ids that the vocabulary lacks raise an
error in decoding; null ids lists decode to no bytes; repeated rows are encoded each; an empty table gives
no rows; other columns of the input are passed through. Texts are used whole.
"""

from __future__ import annotations

import base64
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BLOCK_CHARS = 2_000_000
WORDS_A_QUERY = 20_000
CACHED_CHUNKS, CACHED_PIECES = 250_000, 150_000
LONG_PIECE, LONG_BYTES_A_QUERY = 256, 500_000
MEMORY_LIMIT = "120MB"

ENCODE_SQL = """
WITH RECURSIVE step AS (
    SELECT w, ids, true AS open FROM words
  UNION ALL
    SELECT w, CASE WHEN best IS NULL THEN ids
                   ELSE ids[:(best & 1048575) - 1] || [CAST(best >> 20 AS INTEGER)] || ids[(best & 1048575) + 2:] END, best IS NOT NULL
    FROM (SELECT * FROM step WHERE open) o LEFT JOIN (
      SELECT w, min(rank * 1048576 + p) AS best
      FROM (SELECT w, CAST(unnest(ids[:-2]) AS BIGINT) * 4294967296 + unnest(ids[2:]) AS pair, generate_subscripts(ids[2:], 1) AS p
            FROM step WHERE open) n JOIN merges USING (pair)
      GROUP BY w) USING (w)
)
SELECT ids FROM step WHERE NOT open ORDER BY w
"""
#: A round over long pieces, which are the table ``piece`` (w, p, id; p counts on over all pieces). A pair is contracted
#: if neither neighbour comes first and no pair within {reach} places that does come before it can lead to a token of no
#: higher rank (and, where its own token is part of one of lower rank, if no pair there comes before it at all); the leftmost
#: of least rank of each piece always. Ranks are doubled, so that a bound can lie between two.
LONG_TAKEN_SQL = """
CREATE OR REPLACE TABLE taken AS
WITH ranked AS (
    SELECT w, p, rank, after, CASE WHEN after > rank THEN 2 * after ELSE 2 * rank END AS soon
    FROM (SELECT w, p, CAST(id AS BIGINT) * 4294967296 + lead(id) OVER (PARTITION BY w ORDER BY p) AS pair FROM piece) LEFT JOIN near USING (pair)),
  seen AS (
    SELECT w, p, rank, after, lag(rank) OVER o AS left_rank, lead(rank) OVER o AS right_rank,
           min(rank) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS lowest,
           min(soon) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING) AS before,
           min(soon + CAST(after < rank AS INTEGER)) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN 1 FOLLOWING AND {reach} FOLLOWING) AS behind,
           min(rank * 4294967296 + p) OVER (PARTITION BY w) AS first
    FROM ranked WINDOW o AS (PARTITION BY w ORDER BY p)),
  judged AS (
    SELECT w, p, rank, p - row_number() OVER (PARTITION BY w, rank ORDER BY p) AS run,
           rank * 4294967296 + p = first
           OR 2 * rank < coalesce(before, 2 * rank + 1) AND 2 * rank < coalesce(behind, 2 * rank + 1)
              AND rank <= coalesce(left_rank, rank) AND rank <= coalesce(right_rank, rank) AND (after > rank OR rank = lowest) AS safe
    FROM seen WHERE rank IS NOT NULL)
SELECT w, p, rank FROM (SELECT w, p, rank, row_number() OVER o AS k, bool_and(safe) OVER o AS safe
                        FROM judged WINDOW o AS (PARTITION BY w, rank, run ORDER BY p))
WHERE safe AND k % 2 = 1
"""
#: A piece of which nothing was taken has no pair left, as the leftmost of least rank would have been.
LONG_DONE_SQL = "INSERT INTO done SELECT w, p, id FROM piece WHERE w NOT IN (SELECT w FROM taken)"
LONG_CONTRACTED_SQL = """
CREATE OR REPLACE TABLE piece AS
SELECT r.w, row_number() OVER (ORDER BY r.p) AS p, CAST(coalesce(t.rank, r.id) AS INTEGER) AS id
FROM piece r LEFT JOIN taken t ON t.p = r.p
WHERE r.w IN (SELECT w FROM taken) AND r.p - 1 NOT IN (SELECT p FROM taken)
"""
#: Rows are put in order of document and position before they are aggregated, by one thread.
DECODE_SQL = """
SELECT k >> 32 AS d, string_agg(piece, '') AS chars, count(*) - count(piece) AS unknown
FROM (SELECT k, piece FROM (SELECT d * 4294967296 + generate_subscripts(ids, 1) AS k, unnest(ids) AS id FROM id_lists)
      LEFT JOIN vocabulary USING (id) ORDER BY k)
GROUP BY 1
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def connect():
    import duckdb

    folder = os.path.join(tempfile.gettempdir(), f"quillmark-duckdb-{os.getpid()}")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY_LIMIT, "temp_directory": folder, "preserve_insertion_order": True})
    con.execute("SET disabled_optimizers = 'join_order,build_side_probe_side'")
    return con


class Codec:
    """Encodes and decodes blocks of texts; one a Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split, self.ranks = regex.compile(pattern).findall, ranks
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.other_space = set(regex.findall(r"\s", "".join(map(chr, range(0x3001))))) - {" ", "\n"}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.con = connect()
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        self.merges = left, right, rank
        of = [(r, (t[i] << 16) | (t[i + 1] << 8) | t[i + 2]) for t, r in ranks.items() for i in range(len(t) - 2)]
        self.triples = np.array(of, np.int32).reshape(-1, 2).T.copy()
        self.create("merges", pa.table({"pair": left * (1 << 32) + right, "rank": rank}))
        self.create("vocabulary", pa.table({"id": np.fromiter(ranks.values(), np.int32, len(ranks)), "piece": [t.decode("latin-1") for t in ranks]}))

    def create(self, name: str, table: pa.Table) -> None:
        self.con.register("given", table)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.con.unregister("given")

    def query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.con.register(name, table)
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def contract(self, raw: list[bytes]) -> list[bytes]:
        """Token ids, as bytes of int32, of each of the given words."""
        n = np.array([len(x) for x in raw])
        ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
        out = self.query(ENCODE_SQL, "words", pa.table({"w": np.arange(len(raw)), "ids": lists})).column("ids").combine_chunks()
        flat, ends = out.flatten().to_numpy().astype(np.int32).tobytes(), (np.cumsum(out.value_lengths().to_numpy()) * 4).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def possible(self, data: np.ndarray) -> np.ndarray:
        """Of each rank, whether the bytes hold every three bytes in a row of its token (other tokens can't come up)."""
        seen = np.zeros(1 << 24, bool)
        seen[(data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]] = True
        known = np.ones(max(self.ranks.values()) + 1, bool)
        known[self.triples[0][~seen[self.triples[1]]]] = False
        return known

    def contract_long(self, raw: list[bytes]) -> list[bytes]:
        """Token ids, as bytes of int32, of each of the given long words: rounds over a table of their present tokens."""
        n, data = np.array([len(x) for x in raw]), np.frombuffer(b"".join(raw), np.uint8)
        ids = self.byte_ids[data]
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        known = self.possible(data)
        left, right, rank = (x[known[self.merges[2]]] for x in self.merges)
        after = np.full(len(known), 1 << 31)  # the least rank of a pair with the token
        np.minimum.at(after, left, rank)
        np.minimum.at(after, right, rank)
        self.create("near", pa.table({"pair": left * (1 << 32) + right, "rank": rank, "after": after[rank]}))
        self.create("piece", pa.table({"w": np.repeat(np.arange(len(raw)), n), "p": np.arange(1, len(ids) + 1), "id": ids}))
        self.con.execute("CREATE OR REPLACE TABLE done AS FROM piece LIMIT 0")
        reach = max(len(token) for token, r in self.ranks.items() if known[r])
        while self.con.execute("SELECT count(*) FROM piece").fetchall()[0][0]:
            for sql in (LONG_TAKEN_SQL.format(reach=reach), LONG_DONE_SQL, LONG_CONTRACTED_SQL):
                self.con.execute(sql)
        out = self.con.sql("SELECT w, id FROM done ORDER BY w, p").to_arrow_table()
        flat, ends = out.column(1).to_numpy().astype(np.int32).tobytes(), (np.cumsum(np.bincount(out.column(0).to_numpy(), minlength=len(raw))) * 4).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def learn_pieces(self, pieces: set[str]) -> None:
        """Puts the tokens of pieces into the cache."""
        rest = []
        for w in pieces:
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is None:
                rest.append((w, raw))
            else:
                self.pieces[w] = whole.to_bytes(4, "little")
        short = [x for x in rest if len(x[1]) <= LONG_PIECE]
        for i in range(0, len(short), WORDS_A_QUERY):
            part = short[i : i + WORDS_A_QUERY]
            self.pieces.update(zip([w for w, _ in part], self.contract([raw for _, raw in part]), strict=True))
        long = [x for x in rest if len(x[1]) > LONG_PIECE]
        for i, j in _blocks(np.array([len(raw) for _, raw in long], np.int64), LONG_BYTES_A_QUERY):
            self.pieces.update(zip([w for w, _ in long[i:j]], self.contract_long([raw for _, raw in long[i:j]]), strict=True))

    def chunked(self, text: str) -> list[str] | None:
        """Chunks that the pattern splits alike alone and in place: cut at single spaces and line ends.

        A chunk that follows a space is kept without it; other chunks start with a tab (the first of the text)
        or a line end. None if other white space, or white space in a row, stands in the text.
        """
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or not self.other_space.isdisjoint(text):
            return None
        return ("\t" + text.replace("\n", " \n")).split(" ")

    def learn_chunks(self, chunks: list[str]) -> None:
        split = [self.split(c if c[0] == "\n" else c[1:] if c[0] == "\t" else " " + c) for c in chunks]
        self.learn_pieces({p for ps in split for p in ps if p not in self.pieces})
        of = self.pieces
        for c, ps in zip(chunks, split, strict=True):
            self.chunks[c] = of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks = {}
        if len(self.pieces) > CACHED_PIECES:
            self.pieces = {}
        every: list[str] = []
        upto, odd = np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            if text:
                chunks = self.chunked(text)
                if chunks is None:
                    odd[i] = text
                else:
                    every += chunks
            upto[i] = len(every)
        words = pa.array(every, pa.string()).dictionary_encode()
        del every
        distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        self.learn_chunks([c for c in distinct if c not in self.chunks])
        of = self.chunks
        tokens = [of[c] for c in distinct]
        flat, size = np.frombuffer(b"".join(tokens), np.int32), np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(size) - size)[at] - ends[:-1], n) + np.arange(ends[-1])]
        counts = np.diff(ends[upto], prepend=0)
        if odd:
            parts = np.split(ids, ends[upto][:-1])
            for i, text in odd.items():
                pieces = self.split(text)
                self.learn_pieces({p for p in pieces if p not in self.pieces})
                of = self.pieces
                parts[i] = np.frombuffer(b"".join([of[p] for p in pieces]), np.int32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each list of ids."""
        out = self.query(DECODE_SQL, "id_lists", pa.table({"d": np.arange(len(ids)), "ids": ids}))
        texts = [b""] * len(ids)
        for d, chars, unknown in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True):
            if unknown:
                raise ValueError("an id is not in the vocabulary")
            texts[d] = chars.encode("latin-1")
        return texts


_CODECS: dict = {}


def _codec(sent, pattern: str) -> Codec:
    """This worker's codec for a broadcast vocabulary."""
    ranks = sent.value
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many characters together (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The columns of docs with the text replaced by its token ids, array<int>."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col))
    names = [*kept, ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.array([len(t) for t in texts.fill_null("").to_pylist()], np.int64)
            for start, end in _blocks(sizes, BLOCK_CHARS):
                ids, n = codec.encode(texts[start:end].to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c[start:end] for c in batch.columns[:-1]], lists], names)
        codec.chunks, codec.pieces = {}, {}  # the worker may go on to other work

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}`{ids_col}` array<int>")


def decode(tokens: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """The columns of tokens and the decoded bytes."""
    sent = tokens.sparkSession.sparkContext.broadcast(ranks)
    rows = tokens.select(*[F.col(f"`{c}`") for c in tokens.columns if c != ids_col], F.col(ids_col))
    names = [*rows.columns, bytes_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for start, end in _blocks(sizes, BLOCK_CHARS // 4):
                part = lists[start:end]
                yield pa.RecordBatch.from_arrays([*[c[start:end] for c in batch.columns], pa.array(codec.decode(part), pa.binary())], names)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}`{bytes_col}` binary")


def digests(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = encode(documents(spark, sf_dir, "doc_id", "text"), ranks, public_tokenizers.PATTERN)
    out = decode(ids, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digests(F.col("ids")).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
