"""The corpus pipeline: documents in, places in packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; the last returns the packing of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import mixing, near, packing, secrets, toxicity
from corpusflow.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on ``labels`` and these documents."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found credentials are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.train())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target shares: each document as often as the mixture starts it, at least once."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of equal capacity, in an order that keeps the mixture.

    Best fit is planned within runs of sequences; each run holds the same share of every source, so that a training run
    that stops early has seen the target shares too.
    """
    return packing.pack_in_order(mixing.in_order(docs, packing.RUN))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, MinHash and inferred automata are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
