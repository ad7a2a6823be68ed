"""A training corpus from `documents`: each stage takes what its predecessor kept and returns its own rows.

STAGES are (name, function of spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.mixing import label_domains, mix
from lodestone.llm.secrets import redact
from lodestone.llm.sentencepieces import encode_documents
from lodestone.llm.shared import Scratch, forget, settle
from lodestone.llm.similar import keep_first_similar
from lodestone.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 over five-word shingles the one with the smallest doc_id stays."""
    return keep_first_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; no document goes."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce domains are repeated until the domains meet their tempered token shares."""
    return mix(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with digests and whether decoding gives the text back."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Models are trained on the way, which SQL cannot express; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table and read again by the next. A stage's own tables go with its end,
    and its input when it is written; the last stage's input stays, as its result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, first = docs, name == STAGES[0][0]
        with Scratch() as scratch:
            docs = scratch.keep(settle(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if not first:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
