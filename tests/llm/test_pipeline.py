"""The pipeline's stages against brute-force versions."""

import re
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_operators import brute_components, edge, tiktoken_encoding  # noqa: F401

from quillmark.llm import mixing
from quillmark.llm.common import cut


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(cut(stage(spark, seen[-1], sf)))
    start, told, single, private, mixed, ids = seen
    assert all(x.columns == columns for x in (told, single, private, mixed))
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in start.collect() if re.search(r"[^\W\d_]", r.text or "")}
    data = [(r.doc_id, r.text) for r in told.collect()]
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in brute_components(data, 5, 80).items() if i == c}
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (single, private))
    assert set(before) == set(after)
    changed = {i for i in before if before[i] != after[i]}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert {i for i, t in before.items() if mail.search(t)} <= changed and not any(mail.search(t) for t in after.values())
    assert all(r.n_chars == len(r.text) for r in private.collect())
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= set(after)
    ranks, pattern, own = tiktoken_encoding()
    want = Counter((r.doc_id, tuple(own.encode_ordinary(r.text))) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == want


def test_mixture_keeps_rows_without_an_id_and_of_one_id(spark, sf):
    texts = ["a b c", "d e f g", "h i", "k l m n o", "p"]
    docs = spark.createDataFrame(list(zip([None, None, 1, 1, 2], texts, ["s"] * 5, strict=True)), "doc_id long, text string, source string")
    assert sorted(r.text for r in cp.mixture(spark, docs, sf).collect()) == sorted(texts)


def test_edge_rows_through_all_stages(spark, sf, edge):  # noqa: F811
    seen = [edge.withColumn("n_chars", F.length("text").cast("long"))]
    for _, stage in cp.STAGES:
        seen.append(cut(stage(spark, seen[-1], sf)))
    start, told, single, private, mixed, ids = seen
    lost = lambda df: df.where("doc_id IS NULL").count()
    assert lost(start) == lost(told) == lost(single) == lost(private) == 1
    sized = mixing.mix_sources(private)
    assert mixed.count() == ids.count() == sized.agg(F.sum("times")).first()[0]
    assert lost(mixed) == lost(ids) == sized.where("doc_id IS NULL").agg(F.sum("times")).first()[0] > 0


def test_columns_of_any_name_pass_through(spark, sf):
    names = ["score", "lang_pred", "times", "ids", "n_tokens", "copy", "row", "count", "component_id", "k", "rep"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, sf))
    got = docs.collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names) and all(len(r["ids_"]) == r["n_tokens_"] for r in got)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, sf))
        assert docs.count() == 0
