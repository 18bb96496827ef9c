"""A training corpus from documents: five stages, each written as Parquet and read by the next.

Toxic documents go; of near copies (five-word shingles, Jaccard similarity of 0.8 or more) one stays;
passages that occur earlier are cut out; sources are mixed to their target weights; what is left is
packed into sequences.  All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import jaccard, labelled, mixing, packing, substring, toxicity
from kinfold.llm.store import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the tables (not of the held-out fold), filters ``docs``."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = labelled.fold(F.col("doc_id"), toxicity.HELD_OUT_MOD) != toxicity.HELD_OUT_IS
    return toxicity.keep_clean(docs, toxicity.fit(source, labels, train))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage learns its grammar, which SQL can't express; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
            scratch.sweep()
    return docs
