"""Alignment, toxicity and periodic runs against brute-force versions, on whole small tables and on edge cases."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import alignment, periods, queries, toxicity

RANDOM = random.Random(11)
SCHEMA = "doc_id long, text string, source string, row string, block long, pairs string, n_a string, y int, id string, runs string, collapsed string, score double"
LONG = " ".join(RANDOM.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(RANDOM.randint(0, 400)) for _ in range(6000))
TEXTS = [
    None, "", "   \n\t ", "one", "a a a a a a a a a a a a", "a b " * 20, LONG, LONG, LONG + " " + LONG, "x" * 3000, "the cat sat " * 5 + "end",
    "ﬁne ½ café café Å", "日本語のテキスト、空白なし。" * 20, "line\nline\nline\n\nother\x0b\x0c\r\n tab\t", "\x00nul \x1f control \x85 \xa0  ", "👩‍👩‍👧 and 🎉",
    "▁marked▁ text", "<|endoftext|> <s> </s> <unk> <0x41>", "  double  spaces ", "İstanbul ﬀ ß",
]


@pytest.fixture(scope="module")
def edge(spark):
    data = [(i, t, None if i % 5 == 0 else f"s{i % 3}", "x", None, "p", "q", 1, "z", None, "c", None) for i, t in enumerate(TEXTS)]
    data += [data[5], data[5], (None, "no id here here", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    """Each text's tokens, groups and links by walking over byte positions; counts over all texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    vocab, byte = {i: e for e, i in json.load(open(a_path, encoding="utf-8"))["model"]["vocab"].items()}, alignment.byte_alphabet()
    out, count = [], Counter()
    for t in texts:
        want, ta, tb = (" " + (t or "")).encode(), [], []
        if t:
            at = 0
            for i in a.encode(" " + t, add_special_tokens=False).ids:
                at += len(bytes(byte[c] for c in vocab[i]))
                ta.append((i, at))
            said = b""
            for i in b.encode(t):
                p = b.id_to_piece(i)
                said += bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                tb.append((i, len(said)))
            joined = b"".join(bytes(byte[c] for c in vocab[i]) for i, _ in ta)
            if joined != want or said != want:
                ta, tb = [], []
        links, k, m = [], 0, 0
        while k < len(ta) and m < len(tb):
            links.append((ta[k][0], tb[m][0]))
            ea, eb = ta[k][1], tb[m][1]
            k, m = k + (ea <= eb), m + (eb <= ea)
        cuts = sorted({e for _, e in ta} & {e for _, e in tb})
        groups, k, m = [], 0, 0
        for c in cuts:
            sides = []
            for v, at in ((ta, k), (tb, m)):
                end = at
                while end < len(v) and v[end][1] <= c:
                    end += 1
                sides.append((",".join(str(i) for i, _ in v[at:end]), end))
            groups.append(f"{sides[0][0]}|{sides[1][0]}")
            k, m = sides[0][1], sides[1][1]
        out.append((len(ta), len(tb), len(groups), links, ";".join(groups)))
        count.update(links)
    highest = defaultdict(int)
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return [(x, y, g, len(li), sum(count[p] == highest[p[1]] for p in li), sum(count[p] for p in li), s) for x, y, g, li, s in out]


def aligned_rows(spark, docs):
    from quillmark.llm.common import cut

    out = alignment.score_links(cut(alignment.align(docs, *paths())), 32_000)
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()


def test_alignment_equals_plain_loops(spark, edge, empty):
    rows = edge.select("doc_id", "text").collect()
    want = plain_alignment([r.text for r in rows])
    got = aligned_rows(spark, edge)
    assert Counter((r.doc_id, want[k]) for k, r in enumerate(rows)) == Counter((r[0], tuple(r[1:])) for r in got)
    assert aligned_rows(spark, empty) == []


def test_alignment_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain_alignment([r.text for r in docs])
    got = {r.doc_id: tuple(r[1:]) for r in queries.queries()["op11_alignment"](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert got == {r.doc_id: (*w[:6], sha(w[6])) for r, w in zip(docs, want, strict=True)}


def test_alignment_blocks(monkeypatch):
    """Blocks of any size give the same texts; a text without tokens moves no offsets."""
    t = alignment.Tokenizers(*paths())
    whole = alignment.align_block(t, TEXTS)
    apart = [alignment.align_block(t, [x]) for x in TEXTS]
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups"):
        assert list(whole[name]) == [x for a in apart for x in a[name]]
    assert Counter(dict(zip(whole["block_pairs"].tolist(), whole["block_links"].tolist(), strict=True))) == sum(
        (Counter(dict(zip(a["block_pairs"].tolist(), a["block_links"].tolist(), strict=True))) for a in apart), Counter()
    )
    assert alignment.align_block(t, [None, ""])["groups"] == ["", ""]
    import pyarrow as pa

    monkeypatch.setattr(alignment, "BLOCK_CHARS", 50)
    spans = list(alignment.blocks_of(pa.array(TEXTS, pa.string())))
    assert [k for i, j in spans for k in range(i, j)] == list(range(len(TEXTS))) and list(alignment.blocks_of(pa.array([], pa.string()))) == []


# 12


def test_toxicity_probabilities_against_plain_loops():
    """Both models gram by gram from their definition, and that they sum to one after any three signs."""
    words = [["idiot", "the", "then", "idiots"], ["the", "then", "there", "and", "an", "é", "日本", "a1"]]
    n = [Counter(), Counter()]
    for c, ws in enumerate((words[1], words[0])):  # ordinary, toxic
        for w in ws:
            code, _ = toxicity.grams([w])
            n[c].update(code.tolist())
    code = np.array(sorted(set(n[0]) | set(n[1])))
    model = toxicity.Model(code, *[np.array([n[c][g] for g in code.tolist()]) for c in (0, 1)])
    signs, mask = 64, 64**3 - 1
    cells = {3: defaultdict(float), 2: defaultdict(float), 1: defaultdict(float)}
    total = {g: n[0][g] + n[1][g] for g in code.tolist()}
    for k in (3, 2, 1):
        lefts, sums = defaultdict(int), defaultdict(float)
        for g, x in total.items():
            lefts[g % signs**k] += 1
            sums[g % signs**k] += x
        cells[k] = {g: sums[g] if g < signs ** (k - 1) else lefts[g] for g in lefts}
        total = cells[k]

    def shared(g, k):
        if k == 0:
            return 1 / signs
        same = [v for h, v in cells[k].items() if h // signs == g // signs]
        low = shared(g % signs ** (k - 1), k - 1) if k > 1 else 1 / signs
        if not same:
            return low
        return (max(cells[k].get(g, 0) - 0.75, 0) + sum(min(0.75, v) for v in same) * low) / sum(same)

    def p(c, g):
        same = [v for h, v in n[c].items() if h // signs == g // signs]
        low = shared(g & mask, 3)
        if not same:
            return low
        return (max(n[c].get(g, 0) - 0.5, 0) + 0.5 * len(same) * low) / sum(same)

    for w in ["idiot", "the", "zebra", "ant", "é", "日", "x9"]:
        grams, _ = toxicity.grams([w])
        got = model.of_words([w])[0]
        assert got[:2] == pytest.approx([sum(np.log(p(c, g)) for g in grams.tolist()) for c in (0, 1)], abs=1e-9) and got[2] == len(w) + 1
    for before in {g // signs for g in code.tolist()}:
        for c in (0, 1):
            assert sum(p(c, before * signs + x) for x in range(signs)) == pytest.approx(1, abs=1e-9)


def test_toxicity_grams_stay_inside_words():
    both, sizes = toxicity.grams(["ab", "abcde"])
    assert sizes.tolist() == [3, 6] and np.array_equal(both, np.concatenate([toxicity.grams([w])[0] for w in ("ab", "abcde")]))
    assert toxicity.words_of("Idiot, IDIOT\nid-iot a_b") == {"idiot", "id", "iot", "a", "b"}


def test_toxicity_curve_rises_and_pools():
    x = np.array([0.0, 1, 2, 3, 4, 5, 6, 7])
    at, share = toxicity.curve_of(x, np.array([0, 0, 1, 0, 0, 1, 1, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all() and 0 < share.min() and share.max() < 1
    at, share = toxicity.curve_of(x, np.array([1, 1, 1, 1, 0, 0, 0, 0]))
    assert len(at) == 1 and share[0] == pytest.approx(0.5)


def test_toxicity_finds_planted_words(spark, edge, empty):
    """Documents that hold one of a few expressions, some of them only in forms not seen in training."""
    r, plain = random.Random(4), ["".join(random.Random(k).choice(["an", "the", "ou", "re", "ti", "so"]) for _ in range(random.Random(k).randint(1, 4))) for k in range(300)]
    data = []
    for k in range(900):
        ws = [r.choice(plain) for _ in range(r.randint(30, 90))]
        if k % 6 == 0:
            for _ in range(3):
                ws.insert(r.randrange(len(ws)), r.choice(["gromf", "wazzik"]) + r.choice(["", "er", "ing", "s", "ou", "re"] if k < 600 else ["est", "ti", "so"]))
        data.append((k, " ".join(ws), int(k % 6 == 0)))
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.where("doc_id < 600").select("doc_id", "toxic"))
    got = toxicity.score(docs.where("doc_id >= 600"), model).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97 and got.score.between(0, 1).all()
    assert got.score[got.toxic == 1].min() > got.score[got.toxic == 0].quantile(0.9)
    scored = toxicity.score(edge, model, score_col="score_2").collect()
    assert len(scored) == edge.count() and scored[0].asDict().keys() == {*edge.columns} - {"text"} | {"score_2", "predicted"}
    by_text = {row.doc_id: row.score_2 for row in scored}
    assert by_text[0] == by_text[1] == by_text[2] and by_text[6] == by_text[7]
    for none, share in ((docs.where("toxic = 0"), 0.0), (docs.limit(0), 0.5)):
        flat = toxicity.fit(docs.select("doc_id", "text"), none.select("doc_id", "toxic"))
        assert {row.score for row in toxicity.score(edge.select("doc_id", "text"), flat).collect()} == {share}
    assert toxicity.score(empty.select("doc_id", "text"), model).count() == 0


def test_toxicity_sums_against_single_texts(spark, sf):
    """Likelihoods in Spark, with its table of words, equal sums over the words of each text alone."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    for r in toxicity.likelihoods(docs, model, columns=[F.col("text").alias("t")]).collect():
        ws = sorted(toxicity.words_of(r.t))
        assert [r.ll_ordinary, r.ll_toxic, r.signs] == pytest.approx(model.of_words(ws).sum(0).tolist() if ws else [0, 0, 0], abs=1e-6)
    query = queries.queries()["op12_toxicity"](spark, sf).toPandas()
    assert len(query) == docs.count() and ((query.score >= 0.3) == (query.predicted == 1)).all()
    assert (query.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in query.doc_id]).all()


# 13


def plain_runs(ids):
    """All runs by walking along every period; of equal spans the smallest period counts."""
    n, out = len(ids), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ids[j] == ids[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_loops():
    rng = np.random.default_rng(7)
    for k in range(1500):
        ids = rng.integers(0, rng.integers(1, 5), rng.integers(0, 90))
        if k % 2:
            w = rng.integers(0, 6, rng.integers(1, 9))
            ids = np.concatenate([ids[:20], np.tile(w, rng.integers(1, 9)), ids[20:40], np.tile(w, 2)])
        if k % 3 == 0:
            ids = np.concatenate([ids, ids, ids[: len(ids) // 2]])
        assert periods.runs_of(ids.astype(np.int32)) == plain_runs(ids.tolist())


def test_runs_of_long_texts():
    """One word, one word with few others, one long period, and a repeat that is one word short, in bounded time."""
    n, began = 60_000, time.time()
    same = np.zeros(n, np.int32)
    assert periods.runs_of(same) == [(0, n, 1)]
    assert periods.runs_of(np.tile(np.arange(20_000, dtype=np.int32), 3)) == [(0, n, 20_000)]
    assert periods.runs_of(np.concatenate([np.arange(30_000), np.arange(29_999)]).astype(np.int32)) == []
    same[[20_000, 41_000]] = 1
    assert {(0, 20_000, 1), (20_001, 20_999, 1), (41_001, 18_999, 1)} <= set(periods.runs_of(same))
    assert time.time() - began < 60


def plain_periods(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = plain_runs(ws)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in drop)))


def test_periodic_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 12000 OR text IS NULL").collect()
    got = {r.doc_id: tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in docs:
        assert got[r.doc_id] == plain_periods(r.doc_id, r.text)


def test_periods_of_edge_texts(spark, edge, empty):
    out = periods.find_runs(edge).collect()
    want = Counter()
    for r in edge.collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = plain_runs(ws) if len(ws) < 5000 else periods.runs_of(periods.word_ids(r.text)[1])
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        want[r.doc_id, tuple(runs), " ".join(w for i, w in enumerate(ws) if i not in drop)] += 1
    assert Counter((r.row.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in out) == want
    twice = next(r for r in out if r.row.doc_id == 8)
    assert [tuple(x) for x in twice.runs] == [(0, 12_000, 6000)] and twice.collapsed == LONG
    assert periods.find_runs(empty).count() == 0
