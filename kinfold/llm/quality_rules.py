"""Quality rules: gradient-boosted trees over document statistics, behind fixed base rules.

Scored in one pass over the text without a shuffle.  Null and empty texts have zero statistics, and
so fail the base rules.  Repeated rows are scored alike, one result for each input row.
A long text is one slice, read whole.  An empty table gives no rows, other columns don't matter.  With labels
of one class, or none, the trees have nothing to split on and give every text the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import labelled, stats, trees
from kinfold.llm import words as W

#: Labelled rows used for fitting, at most.
SAMPLE = 12_000
#: A document is kept if the trees' probability of label 1 is at least this.
KEEP_AT = 0.3
#: More of these can only lower the score.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_word_share": -1, "bang_share": -1, "bar_share": -1}
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in W.slices(batches):
        x = stats.compute(data, offsets)["features"]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, train=None, *, label: str = "quality", limit: int = SAMPLE) -> trees.Forest:
    """Fits the trees on at most ``limit`` labelled rows; only their statistics reach the driver."""
    train = F.lit(True) if train is None else train
    rows = labelled.sample(docs, labels, label, train, limit).mapInArrow(_features, "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(stats.NAMES))
    order = np.lexsort(x.T)  # the order in which tasks end has no influence
    return trees.fit(x[order], np.array(rows.column("label"), dtype=float)[order], {stats.NAMES.index(k): v for k, v in MONOTONE.items()})


def score(docs: DataFrame, forest: trees.Forest, *, keep_at: float = KEEP_AT) -> DataFrame:
    """Base counts, base verdict, score and verdict of each document, with SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.slices(batches):
            s = stats.compute(data, offsets)
            p = forest.probability(s["features"])
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
            counts = [s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns = [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
