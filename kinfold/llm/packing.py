"""Packing: vector bin packing of token pieces by the dot-product heuristic.

A sequence is limited at once in tokens, segments and loss-bearing tokens.  Of the pieces that still
fit, the one whose size vector has the largest dot product with the remaining capacity goes in next.
Each task packs the documents of its partition as they stream by: full pieces of long documents are
sequences of their own, the rest waits in a buffer of bounded size.  What no piece fills is filled by
cutting one; when another limit ends a sequence, or the partition ends, its length is brought to a
power of two, which needs no padding, and the excess returns to the buffer.  So nothing is shuffled,
memory is bounded, and a task that runs again gives the same result.

Null text counts as empty: its only id is the closing one.  Repeated rows are packed one by one.
A text of any length is cut into pieces; equal sizes keep the order of arrival.  An empty table gives no
rows.  Added tokens of the vocabulary inside a text have their own ids.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import words as W
from kinfold.llm.store import bounded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
END_ID = 1
#: Sequences of one partition have ids from partition * 2**SEQUENCE_BITS on.
SEQUENCE_BITS = 38
#: Pieces that wait for a sequence, at most.
BUFFER = 768


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 96
    loss: int = 2048


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The byte-level vocabulary as an encoder, with the added tokens of its JSON form.

    The same ids as the ``tokenizers`` library gives with that JSON (tested), several times faster.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.json"), "rb") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(text: bytes, vocabulary: str) -> np.ndarray:
    ids = encoder(vocabulary).encode(text.decode("utf-8", "replace"), allowed_special="all")
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


class Packer:
    """Feeds on documents, yields the pieces of finished sequences."""

    def __init__(self, limits: Limits, first: int = 0, buffer: int = BUFFER):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.sequence, self.room = limits, first, buffer
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.items: list[tuple] = []  # (doc, ids from start on, start, doc_tokens, loss_from)
        self.size = np.zeros((2 * buffer + 8, 3))

    def _vector(self, item: tuple) -> tuple[int, int, int]:
        _, ids, start, _, loss_from = item
        return len(ids), 1, max(0, start + len(ids) - max(start, loss_from))

    def _put(self, item: tuple) -> None:
        if len(self.items) == len(self.size):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.size[len(self.items)] = self._vector(item)
        self.items.append(item)

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.size[i] = self.size[len(self.items)]
        return item

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, ids, start, total, loss_from in pieces:
            n = len(ids)
            yield doc, start, n, crc32(ids.tobytes()), total, self.sequence, offset, max(0, start + n - max(start, loss_from))
            offset += n
        self.sequence += 1

    @staticmethod
    def _cut(item: tuple, n: int) -> tuple[tuple, tuple]:
        doc, ids, start, total, loss_from = item
        return (doc, ids[:n], start, total, loss_from), (doc, ids[n:], start + n, total, loss_from)

    def _fill(self) -> Iterator[tuple]:
        """One sequence from the buffer."""
        left, pieces = self.cap.copy(), []
        while self.items and left.min() > 0:
            size = self.size[: len(self.items)]
            fit = (size <= left).all(1)
            if fit.any():
                i = int(np.argmax(np.where(fit, size @ (left / self.cap**2), -1.0)))
                piece = self._take(i)
            else:
                item = self._take(int(np.argmax(size[:, 0])))
                free = max(0, item[4] - item[2])  # ids before the first loss-bearing one
                piece, rest = self._cut(item, int(min(left[0], free + left[2])))
                self._put(rest)
            pieces.append(piece)
            left -= self._vector(piece)
        yield from self._close(pieces)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        total = sum(len(p[1]) for p in pieces)
        if not total:
            return
        keep = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        while total > keep:
            piece = pieces.pop()
            n = len(piece[1])
            if total - n >= keep:
                self._put(piece)
                total -= n
            else:
                head, tail = self._cut(piece, n - (total - keep))
                pieces.append(head)
                self._put(tail)
                total = keep
        yield from self._emit(pieces)

    def add(self, doc: int | None, ids: np.ndarray, loss_from: int = 0) -> Iterator[tuple]:
        total, start, full = len(ids), 0, self.limits.tokens
        item = (doc, ids, 0, total, loss_from)
        while total - start > full:
            piece, item = self._cut(item, full)
            if self._vector(piece)[2] > self.limits.loss:
                self._put(piece)
            else:
                yield from self._emit([piece])
            start += full
        self._put(item)
        while len(self.items) > self.room:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.items:
            yield from self._fill()


def pack(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k", limits: Limits = Limits(), loss_from: str | None = None) -> DataFrame:
    """One row for each piece, with SCHEMA.  ``loss_from`` names a column with the number of leading
    ids that bear no loss (a prompt); without it every id bears loss."""
    bounded(docs.sparkSession)
    mask = F.lit(0) if loss_from is None else F.coalesce(F.col(loss_from), F.lit(0))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows = Packer(limits, TaskContext.get().partitionId() << SEQUENCE_BITS), []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            rows.clear()
            return out

        for part, data, offsets in W.slices(batches):
            raw, at = data.tobytes(), offsets.tolist()
            ids, lead = (part.column(part.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "lead"))
            for i, doc in enumerate(ids):
                rows.extend(packer.add(doc, encode(raw[at[i] : at[i + 1]], vocabulary), lead[i]))
            if len(rows) > 10_000:
                yield batch()
        rows.extend(packer.finish())
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mask.cast("long").alias("lead")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
