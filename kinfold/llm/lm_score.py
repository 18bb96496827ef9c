"""Language-model scoring: stupid backoff, as relational joins of n-gram counts.

Count tables of all n-grams up to ORDER are partitioned by hash; exploded n-grams of the documents
are joined to them, and each document sums the logarithms:

    S(w | a b) = c(a b w) / c(a b)          if c(a b w) >= min_count
               = alpha * S(w | b)           otherwise, S(w | b) likewise, S(w) = c(w) / N.

Both sides of the join are packed.  Documents are dealt into blocks; a block's distinct n-grams are
one sorted list, cut by hash into parts, and each (block, part) is one row with the list's differences
and local counts, compressed.  A part adds up the rows of all blocks (that is the count table) and
answers each with totals in the order of its list, so answers need no keys.  A frequent n-gram comes
once from each block, and no n-gram is dropped.  Sizes of blocks and parts grow with the square root
of the corpus, so that the number of rows is in proportion to it, up to 32 times; beyond that memory
bounds them and the rows grow with the square of the corpus.

Documents go to their blocks compressed, those of one block and task together.

An n-gram is known by a 64-bit hash (0 stands for none and counts as 1).  Null and empty texts have no words and a sum of 0.
Repeated rows are counted and scored one by one.  An empty table gives no rows, other columns don't matter.
Blocks go by id and checksum of the text, so rows without an id, or of one id, don't meet in one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import words as W
from kinfold.llm.store import bounded

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
HASH_BITS = 64
#: Text of a block and n-grams of a part, for a corpus of up to a gigabyte; both grow with its square root.
BLOCK_BYTES = 8_000_000
PART_GRAMS = 1_500_000
LEAST = 48
#: Text that a task holds before it sends it to the blocks, so that a block's share compresses well.
HELD_BYTES = 32_000_000


@dataclass(frozen=True)
class Layout:
    blocks: int
    parts: int
    words: int


def layout(docs: DataFrame) -> Layout:
    """Numbers of blocks and parts, and the number of words, from one scan."""
    r = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("w")).first()
    size, n = r.b or 0, r.w or 0
    grow = min(32.0, max(1.0, math.sqrt(size / 1e9)))
    return Layout(max(LEAST, math.ceil(size / (BLOCK_BYTES * grow))), max(LEAST, math.ceil(1.6 * n / (PART_GRAMS * grow))), int(n))


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel() if len(planes) else np.zeros(0, np.uint64)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, its rows as a compressed Arrow stream), one row for each block and HELD_BYTES of text."""
    held: list[pa.RecordBatch] = []

    def send() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        block = np.asarray(t.column("block").combine_chunks())
        order = np.argsort(block, kind="stable")
        t, block = t.select(["doc_id", "text"]).take(order), block[order]
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out = []
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                w.write_table(t.slice(i, j - i).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[at], pa.int32()), pa.array(out, pa.binary())], ["block", "rows"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.nbytes for x in held) >= HELD_BYTES:
                yield send()
                held.clear()
    if held:
        yield send()


def _opened(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(r).read_all() for r in table.column("rows").to_pylist()])


def _grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1- to order-grams at each word of a block's texts (0 where they pass the end), and word offsets."""
    parts, counts = [[] for _ in range(order)], [np.zeros(1, np.int64)]
    for _, data, offsets in W.slices(iter(table.to_batches())):
        starts, ends, ptr = W.spans(data, offsets)
        h = W.hashes(data, starts, ends)
        left = ptr[1:][W.per_doc(ptr)] - np.arange(len(h))
        for n in range(1, order + 1):
            g = np.zeros(len(h), np.uint64)
            x = W.grams(h, n)
            g[: len(x)] = np.maximum(x, np.uint64(1))
            g[left < n] = 0
            parts[n - 1].append(g)
        counts.append(np.diff(ptr))
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts], np.cumsum(np.concatenate(counts))


def _listed(grams: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block, their counts, and where each part of the hash range begins."""
    keys, counts = np.unique(np.concatenate(grams), return_counts=True)
    if len(keys) and keys[0] == 0:
        keys, counts = keys[1:], counts[1:]
    cuts = np.array([(i << HASH_BITS) // parts for i in range(parts)], dtype=np.uint64)
    return keys, counts, np.append(np.searchsorted(keys, cuts), len(keys))


def score(docs: DataFrame, *, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, logprob (natural logarithm, summed over the words of the whole text)."""
    bounded(docs.sparkSession)
    size = layout(docs)
    parts, total = size.parts, max(1, size.words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")))), F.lit(size.blocks)).cast("int").alias("block"))
    rows = rows.mapInArrow(_dealt, "block int, rows binary")

    def ask(table: pa.Table) -> pa.Table:
        keys, counts, cut = _listed(_grams(_opened(table), order)[0], parts)
        block = table.column("block")[0].as_py()
        out = {"part": [], "block": [], "keys": [], "counts": []}
        for p in range(parts):
            i, j = cut[p], cut[p + 1]
            if i < j:
                out["part"].append(p)
                out["block"].append(block)
                out["keys"].append(_pack(np.diff(keys[i:j], prepend=np.uint64(0))))
                out["counts"].append(_pack(counts[i:j]))
        return pa.table(out, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(_unpack(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpack(c) for c in table.column("counts").to_pylist()])
        every, back = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.zeros(len(every), np.uint64)
        np.add.at(sums, back, counts)
        ends = np.cumsum([len(x) for x in lists])
        totals = [_pack(sums[back[e - len(x) : e]]) for x, e in zip(lists, ends, strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(totals, pa.binary())})

    def add_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _opened(table)
        grams, ptr = _grams(table, order)
        keys, _, cut = _listed(grams, parts)
        totals = np.zeros(len(keys) + 1, np.uint64)
        for p, raw in zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            totals[cut[p] : cut[p + 1]] = _unpack(raw)
        totals = totals.astype(np.float64)
        count = [np.where(g == 0, 0.0, totals[np.searchsorted(keys, g)]) if len(keys) else np.zeros(0) for g in grams]
        n = len(count[0])
        word = W.per_doc(ptr)
        at = np.arange(n) - ptr[:-1][word] if n else np.zeros(0, np.int64)
        best = np.log(np.maximum(count[0], 1.0) / total) + (order - 1) * math.log(alpha)
        for k in range(2, order + 1):  # the longest n-gram that counts wins
            seen = np.zeros(n)
            seen[k - 1 :] = count[k - 1][: n - k + 1]
            context = np.ones(n)
            context[k - 1 :] = count[k - 2][: n - k + 1]
            use = (at >= k - 1) & (seen >= min_count)
            best = np.where(use, np.log(np.maximum(seen, 1.0) / np.maximum(context, 1.0)) + (order - k) * math.log(alpha), best)
        short = np.minimum(order - 1, at)  # words near the start have fewer orders to back off from
        best -= (order - 1 - short) * math.log(alpha)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(ptr), pa.int64()), "logprob": pa.array(W.sums(best, ptr), pa.float64())})

    asked = rows.groupBy("block").applyInArrow(ask, "part int, block int, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(answer, "block int, part int, totals binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, "doc_id long, n_words long, logprob double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).withColumn("logprob", F.round("logprob", 4))


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, i, w[i] AS w0, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w2
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
c1 AS (SELECT w0, count(*)::DOUBLE AS c1, sum(count(*)) OVER () AS total FROM p GROUP BY w0),
c2 AS (SELECT w1, w0, count(*)::DOUBLE AS c2 FROM p WHERE i > 1 GROUP BY w1, w0),
c3 AS (SELECT w2, w1, w0, count(*)::DOUBLE AS c3 FROM p WHERE i > 2 GROUP BY w2, w1, w0),
s AS (SELECT p.r, CASE
    WHEN p.i > 2 AND c3.c3 >= {MIN_COUNT} THEN ln(c3.c3 / x2.c2)
    WHEN p.i > 1 AND c2.c2 >= {MIN_COUNT} THEN ln(c2.c2 / x1.c1) + CASE WHEN p.i > 2 THEN ln({ALPHA}) ELSE 0 END
    ELSE ln(c1.c1 / c1.total) + least(p.i - 1, 2) * ln({ALPHA}) END AS l
  FROM p JOIN c1 ON p.w0 = c1.w0 LEFT JOIN c2 ON p.w1 = c2.w1 AND p.w0 = c2.w0 LEFT JOIN c3 ON p.w2 = c3.w2 AND p.w1 = c3.w1 AND p.w0 = c3.w0
    LEFT JOIN c1 x1 ON p.w1 = x1.w0 LEFT JOIN c2 x2 ON p.w2 = x2.w1 AND p.w1 = x2.w0)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, round(coalesce(q.l, 0), 4) AS logprob
FROM t LEFT JOIN (SELECT r, sum(l) AS l FROM s GROUP BY r) q ON t.r = q.r
"""
