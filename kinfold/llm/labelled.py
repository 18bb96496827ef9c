"""A bounded, deterministic sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.store import bounded


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as the empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows for which ``train`` (on doc_id) holds.

    The rows with the smallest hash of their id are taken; rows without id or label are left out, and
    of several labels of one id the largest counts.  The chosen ids are bounded by ``limit``, so they
    are broadcast to the scan of the documents and no text is shuffled."""
    return _with_text(docs, _first(_labels(labels, label, train), limit))


def of_each(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """The same with at most ``limit`` rows of label 1 and as many of label 0, in one scan of the documents."""
    of = _labels(labels, label, train)
    return _with_text(docs, _first(of.where("label = 1"), limit).unionByName(_first(of.where("label = 0"), limit)))


def _labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def _first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _with_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    bounded(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
