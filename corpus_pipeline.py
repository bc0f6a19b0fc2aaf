"""A corpus pipeline: language ID, near duplicates, PII, mixing and tokens, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Stages between two writes keep nothing in memory, so a lost executor costs the tasks of one stage.

Edge cases follow the operators: null, empty and letterless texts are rejected by the first stage; of rows with
equal ids and texts the duplicate stage keeps one, and all rows without an id; the mixing stage takes each row as often
as its own place asks for, also rows without an id or of one id; an empty table passes through with its columns;
further columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, language_id, mixing, ngram_join, pii
from quillmark.llm.common import cut, free_name, shared_dir

#: A document is rejected if its language can't be told at all, or not with this posterior.
LEAST_LANGUAGE_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the documents' own language labels; rejected documents go."""
    lang, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    told = language_id.predict(docs, language_id.fit(docs), keep_text=True, lang_pred=lang, score=score)
    told = told.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return told.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard of 0.8 over five-word shingles, the one with the smallest id stays."""
    found = ngram_join.jaccard_components(docs, width=5, percent=80)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi")
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by the name of their kind; n_chars follows the text."""
    return pii.redact_pii(docs, pii.train(spark)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: none, once, or up to three times."""
    mixed = mixing.mix_sources(docs, row_col="row").where("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns ids and n_tokens of each document, with the columns of docs but the text (``ids_`` if docs has one of that name)."""
    import public_tokenizers

    ids_col, n_col = free_name("ids", docs.columns), free_name("n_tokens", docs.columns)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN, ids_col=ids_col)
    return ids.withColumn(n_col, F.size(ids_col).cast("long"))


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("pii", private_data),
    ("mixing", mixture),
    ("bpe", tokens),
]
#: Training, hashing and a tokenizer are not SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written under the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
