"""The language model's blocks of tokens: bounded whatever words and batches are, and whole."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.llm import language_model


def test_blocks_are_bounded_by_tokens(monkeypatch):
    """Words of one letter count as any others, though they are short: a block is never a token past its last text."""
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 1000)
    texts = [None, "", "a " * 300, "b " * 5000, *["c d"] * 700, "longer words in it " * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    got = list(language_model.blocks(batch))
    assert [k for keys, _ in got for k in keys] == list(range(len(texts)))
    assert [ws for _, docs in got for ws in docs] == [language_model.tokens(t) for t in texts]
    assert all(sum(map(len, docs[:-1])) < 1000 for _, docs in got) and len(got) > 3
    assert list(language_model.blocks(batch.slice(0, 0))) == []


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 13}" for k in range(1 + i % 40))) for i in range(120)], "id long, text string").coalesce(1)
    learn, fitted = language_model.learn, []
    monkeypatch.setattr(language_model, "learn", lambda docs: fitted.append(learn(docs)) or fitted[0] if not fitted else fitted[0])
    scores = []
    for most in (1 << 20, 300):
        monkeypatch.setattr(language_model, "BLOCK_TOKENS", most)
        got = language_model.score_documents(rows, F.lit(True), "id").collect()
        scores.append(sorted((x.id, x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 3)) for x in got))
    assert scores[0] == scores[1] and len(scores[0]) == 120
