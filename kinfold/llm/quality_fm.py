"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), so pairwise
interactions cost time linear in the number of non-zero inputs.  Inputs: the words of the whole text
hashed to buckets (square root of the count, scaled to unit norm), standardised statistics, and
metadata that follow from the text (its size class).  Empty and null texts have only the latter.
A long text is one slice, read whole.  Repeated rows are scored one by one, an empty table gives no rows,
other columns don't matter.  With labels of one class the score is near that class for all texts; without
labels all texts score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import labelled, stats
from kinfold.llm import words as W

#: Labelled rows used for fitting, at most.
SAMPLE = 10_000
BUCKETS = 1 << 13
FACTORS = 6
EPOCHS = 6
HELD_OUT_MOD, HELD_OUT_IS = 5, 0
PREDICT_AT = 0.3
#: Classes of size (base-4 logarithm of the bytes) that enter as one-hot metadata.
SIZE_CLASSES = 12

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -4, 4)

    def margin(self, features: np.ndarray, size_class: np.ndarray, bucket: np.ndarray, value: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Sparse inputs (bucket, value) of each row lie in [ptr[i], ptr[i+1])."""
        b, d = BUCKETS, self.dense(features)
        nd = d.shape[1]
        out = self.w0 + d @ self.w[b : b + nd] + self.w[b + nd + size_class] + W.sums(self.w[bucket] * value, ptr)
        for f in range(self.v.shape[1]):
            v = self.v[:, f]
            t = v[bucket] * value
            dv, sv = d * v[b : b + nd], v[b + nd + size_class]
            out += 0.5 * ((W.sums(t, ptr) + dv.sum(1) + sv) ** 2 - W.sums(t * t, ptr) - (dv * dv).sum(1) - sv * sv)
        return out


def inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, size class, and the sparse word inputs of each text of a slice."""
    s = stats.compute(data, offsets)
    n, doc = len(offsets) - 1, W.per_doc(s["ptr"])
    key, count = np.unique(doc * BUCKETS + (s["hash"] % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    at, bucket = key // BUCKETS, key % BUCKETS
    ptr = np.searchsorted(at, np.arange(n + 1))
    value = np.sqrt(count) / np.sqrt(np.maximum(s["n_words"], 1))[at]
    size_class = np.minimum(SIZE_CLASSES - 1, np.log2(np.diff(offsets) + 1) / 2).astype(np.int64)
    return s["features"], size_class, bucket, value, ptr


def train(features: np.ndarray, size_class: np.ndarray, sparse: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.08, l2: float = 2e-4, batch: int = 64, seed: int = 7) -> Machine:
    """AdaGrad on logistic loss over mini-batches; deterministic for given rows in given order."""
    rng = np.random.default_rng(seed)
    nd = features.shape[1]
    size = BUCKETS + nd + SIZE_CLASSES
    mean = features.mean(0) if len(y) else np.zeros(nd)
    scale = features.std(0) + 1e-6 if len(y) else np.ones(nd)
    rate0 = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    w0, w, v = float(np.log(rate0 / (1 - rate0))), np.zeros(size), rng.normal(0, 0.02, (size, factors))
    gw, gv = np.full(size, 1e-4), np.full((size, factors), 1e-4)
    dense = np.clip((features - mean) / scale, -4, 4)
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                m = len(rows)
                ids = np.concatenate([np.concatenate([sparse[r][0], BUCKETS + np.arange(nd), [BUCKETS + nd + size_class[r]]]) for r in rows])
                x = np.concatenate([np.concatenate([sparse[r][1], dense[r], [1.0]]) for r in rows])
                row = np.repeat(np.arange(m), [len(sparse[r][0]) + nd + 1 for r in rows])
                ptr = np.searchsorted(row, np.arange(m + 1))
                vx = v[ids] * x[:, None]
                total = np.add.reduceat(vx, ptr[:-1], axis=0)
                margin = w0 + np.add.reduceat(w[ids] * x, ptr[:-1]) + 0.5 * (total**2 - np.add.reduceat(vx * vx, ptr[:-1], axis=0)).sum(1)
                e = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]
                w0 -= rate * 0.1 * e.mean()
                keep, back = np.unique(ids, return_inverse=True)
                ex = e[row] * x
                dw = np.bincount(back, ex, len(keep)) / m + l2 * w[keep]
                part = ex[:, None] * (total[row] - vx)
                dv = np.column_stack([np.bincount(back, part[:, f], len(keep)) for f in range(factors)]) / m + l2 * v[keep]
                gw[keep] += dw**2
                gv[keep] += dv**2
                w[keep] -= rate * dw / np.sqrt(gw[keep])
                v[keep] -= rate * 0.3 * dv / np.sqrt(gv[keep])
    return Machine(w0, w, v, mean, scale)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in W.slices(batches):
        x, size_class, bucket, value, ptr = inputs(data, offsets)
        lists = [pa.LargeListArray.from_arrays(pa.array(ptr, pa.int64()), pa.array(a, t)).cast(pa.list_(t)) for a, t in ((bucket, pa.int32()), (value, pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array(list(x), pa.list_(pa.float64())), pa.array(size_class, pa.int32()), *lists], ["label", "x", "c", "b", "v"])


def fit(docs: DataFrame, labels: DataFrame, train_rows=None, *, label: str = "quality", limit: int = SAMPLE) -> Machine:
    """Fits on at most ``limit`` labelled rows; their sparse inputs are collected, not their texts."""
    cond = F.lit(True) if train_rows is None else train_rows
    rows = labelled.sample(docs, labels, label, cond, limit).mapInArrow(_collected, "label int, x array<double>, c int, b array<int>, v array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return train(np.zeros((0, len(stats.NAMES))), np.zeros(0, np.int64), [], np.zeros(0))
    x = np.array(rows.column("x").to_pylist(), dtype=float)
    c = rows.column("c").to_numpy().astype(np.int64)
    y = rows.column("label").to_numpy().astype(float)
    b, v = rows.column("b").combine_chunks(), rows.column("v").combine_chunks()
    ptr, bv, vv = b.offsets.to_numpy(), b.values.to_numpy(), v.values.to_numpy()
    order = np.lexsort((*x.T, c))  # the order in which tasks end has no influence
    return train(x[order], c[order], [(bv[ptr[i] : ptr[i + 1]].astype(np.int64), vv[ptr[i] : ptr[i + 1]].astype(float)) for i in order], y[order])


def score(docs: DataFrame, machine: Machine, *, at: float = PREDICT_AT) -> DataFrame:
    """Score and prediction of each input row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.slices(batches):
            p = 1 / (1 + np.exp(-np.clip(machine.margin(*inputs(data, offsets)), -40, 40)))
            ids = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(p), pa.array((p >= at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = labelled.fold(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT_IS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels, labelled.fold(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT_IS))
