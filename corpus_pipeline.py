"""A training-data pipeline over ``documents``: toxic documents go, near copies and repeated passages go, benchmark passages go,
the rest becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes before the next stage starts; a stage
first deletes the scratch tables of the stages before it. All stages but the last return the columns of ``documents``, with
``n_chars`` of the text as it is. Every stage takes null texts, empty tables and repeated rows as its operator does.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innings_engine.llm import decontaminate, lexicon, repeats, simhash, toxicity
from innings_engine.llm.queries import BYTE_TOKENIZER
from innings_engine.llm.scratch import drop_written, keep, table
from innings_engine.session import shared_folder


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model is fitted on labels of documents that are not held out."""
    drop_written(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; of rows that share this doc_id one, the same at any layout.

    A row without a doc_id can't be named as a copy or as the head of a group: all such rows stay. The heads grow with the
    documents, so they are merged and never broadcast; both joins read one shuffle of the documents.
    """
    drop_written(spark)
    heads = simhash.near_duplicates(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    heads = keep(heads, "heads").hint("merge")
    one = docs.join(heads.where("times = 1"), "doc_id", "left_semi").select(*docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.xxhash64(row))
    several = docs.join(heads.where("times > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")
    return one.unionByName(several).unionByName(docs.where("doc_id is null"))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that an earlier document has."""
    drop_written(spark)
    return _sized(repeats.without_repeats(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the spans that match a test item."""
    drop_written(spark)
    return _sized(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    drop_written(spark)
    return lexicon.encoded(docs, BYTE_TOKENIZER, with_text=True).drop("decoded")


STAGES = [
    ("toxicity", clean_language),
    ("simhash_near_dedup", one_of_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("bpe_encoding", token_ids),
]

#: SQL can express neither the toxicity model nor fingerprints; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
