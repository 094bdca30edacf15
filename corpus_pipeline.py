"""From raw documents to packed training sequences: toxicity, near duplicates, secrets, source mix, packing.

Each stage works on all rows of its predecessor and returns the columns of ``documents``; the last returns the pieces of
the packed sequences.

* toxicity: documents scored at or above the limit go; the model learns from the rows of ``labels`` that may be learned from
* near_duplicates: of each group one row of the document with the smallest id stays, and every document without a group
* secrets: every span is replaced in the text, the document stays
* source_mix: one row per pass of a document in training order; a pass that a target ends is cut there
* packing: pieces of sequences of at most 2048 tokens

Null and empty texts pass all stages and end as one-token documents, but for the mix, which takes no words of them. Empty
input gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import curriculum, neardup, packing, secrets, toxicity
from trackloom.operators.materialize import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn_from(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

# No stage but the mix can be said in SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
