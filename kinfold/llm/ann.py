"""Nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots.  The index deals all vectors into blocks;
of each block, pivot inverted files hold the vectors under their POST nearest pivots, and are written
once as a table.  A query looks up the files of its PROBE nearest pivots, ranks what it finds by the
footrule distance of the whole permutations, and the best are reranked by cosine in double precision.
Their k-th best is only a bound: each vector also has a home, its nearest pivot, and every home that
the triangle inequality of angles doesn't rule out at that bound is scored in full.  So no neighbour
is lost, whatever the order of the permutations says.  Queries meet every block (a stated query set
against all rows, in blocks); a block and a block of queries are one bounded task, whose result is a
few rows for each query.

Pivots come from a bounded sample of distinct vectors (their smallest hashes), farthest first, so that
neither copies nor a tight cluster take more than their place; every vector is indexed.  Equal
vectors of a block count once in the cut and are all candidates by their smallest ids.  Vectors that
are null, zero, or hold null or non-finite components take no part.  Each dimension is searched by
itself: vectors of different dimensions have no cosine.  Rows that share a vec_id are one query and one
candidate, whose score is the largest over their vectors.  Rows without an id take no part; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.store import Scratch

PIVOTS, POST, PROBE = 128, 14, 12
#: Share of a block's distinct vectors that a query reranks for its first bound, and the least number.
RERANK, RERANK_LEAST = 0.06, 256
#: Distinct vectors that pivots are drawn from, for each pivot.
SAMPLE = 8
#: Queries that are scored against the homes at once, and what rounding may take from a cosine and an angle.
AT_ONCE, SLACK = 256, 1e-9
#: Vectors of a block: an even share of SPREAD blocks, within these bounds; queries of a block.
BLOCK_LEAST, BLOCK, SPREAD, QUERY_BLOCK = 8192, 65536, 64, 16384
SEED = 11

SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array of doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _least(many: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the smallest distinct hashes of a partition."""
    best = None
    for b in batches:
        t = pa.Table.from_batches([b] if best is None else [*best.to_batches(), b])
        best = t.take(np.unique(np.asarray(t.column("h").combine_chunks()), return_index=True)[1][:many])
    if best is not None:
        yield from best.to_batches()


def spread(x: np.ndarray, pivots: int) -> np.ndarray:
    """Up to ``pivots`` rows of unit length, each the farthest from those before it; equal directions count once."""
    at, near = [0], x @ x[0]
    while len(at) < min(pivots, len(x)):
        far = int(near.argmin())
        if near[far] >= 1 - 1e-12:
            break
        at.append(far)
        near = np.maximum(near, x @ x[far])
    return x[at]


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    many = SAMPLE * pivots
    hashed = rows.select("v", F.xxhash64("v", F.lit(SEED)).alias("h"))
    got = hashed.mapInArrow(partial(_least, many), "v array<double>, h long").dropDuplicates(["h"]).orderBy("h").limit(many).collect()
    return spread(unit(np.array([r.v for r in got], dtype=float)), pivots) if got else np.zeros((0, 1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rank of each pivot for each vector (0: nearest)."""
    order = np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")
    rank = np.empty(order.shape, np.uint8 if len(pivots) <= 256 else np.uint16)
    np.put_along_axis(rank, order, np.arange(len(pivots), dtype=rank.dtype)[None].repeat(len(x), 0), 1)
    return rank


def _others(u: np.ndarray, home: np.ndarray, q: np.ndarray, least: np.ndarray, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """For each query, the vectors whose cosine is at least its bound; homes that can't hold one aren't scored."""
    angle = lambda c: np.arccos(np.clip(c, -1, 1))
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(len(pivots) + 1))
    u, own = u[order], angle((u * pivots[home]).sum(1))[order]
    wide = np.array([own[i:j].max() if i < j else -np.inf for i, j in zip(cut[:-1], cut[1:], strict=True)])
    for at in range(0, len(q), AT_ONCE):
        some, bound = q[at : at + AT_ONCE], least[at : at + AT_ONCE] - SLACK
        reach = angle(bound)
        reach[bound < -1] = np.inf
        # arccos near 0 turns a rounding of 1e-16 into an angle of 1e-8
        is_open = angle(some @ pivots.T) - wide <= reach[:, None] + 1e-6
        asks, found = [], []
        for p in np.flatnonzero(is_open.any(0) & (cut[:-1] < cut[1:])):
            who = np.flatnonzero(is_open[:, p])
            a, b = np.nonzero(some[who] @ u[cut[p] : cut[p + 1]].T >= bound[who, None])
            asks.append(who[a])
            found.append(order[cut[p] + b])
        asks, found = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (asks, found))
        by = np.argsort(asks, kind="stable")
        yield from np.split(found[by], np.searchsorted(asks[by], np.arange(1, len(some))))


@dataclass(frozen=True)
class Block:
    """Distinct vectors of a block with their permutations and inverted files; copies[g] lists rows of
    ``ids`` (sorted) that hold vector g, the smallest ids first and each once."""

    ids: np.ndarray
    x: np.ndarray
    rank: np.ndarray
    group: np.ndarray
    files: dict[int, np.ndarray]

    def first(self) -> np.ndarray:
        """A row of each distinct vector."""
        return np.unique(self.group, return_index=True)[1]

    def copies(self, most: int) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(int(self.group.max()) + 1)]
        for i, g in enumerate(self.group.tolist()):
            own = out[g]
            if len(own) <= most and not (own and self.ids[own[-1]] == self.ids[i]):
                own.append(i)
        return out


def build(ids: np.ndarray, x: np.ndarray, rank: np.ndarray, post: int = POST) -> Block:
    """Sorts a block, tells equal vectors, and posts each distinct one under its nearest pivots."""
    order = np.argsort(ids, kind="stable")
    ids, x, rank = ids[order], x[order], rank[order]
    _, first, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
    near = rank[first] < post
    return Block(ids, x, rank, group.ravel(), {p: np.flatnonzero(near[:, p]) for p in range(rank.shape[1]) if near[:, p].any()})


def _nearest(ids: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best (id, score), ties to the smaller id; an id counts once, by its best score."""
    out: dict[int, float] = {}
    for j in np.lexsort((ids, -score)).tolist():
        if len(out) == k:
            break
        out.setdefault(int(ids[j]), float(score[j]))
    return list(out.items())


def search_block(block: Block, q_ids: np.ndarray, q: np.ndarray, q_rank: np.ndarray, pivots: np.ndarray, k: int, probe: int = PROBE) -> list[tuple[int, int, float]]:
    """The k nearest of one block for each query, ties to the smaller id; never the query's own id."""
    first, copies = block.first(), block.copies(k)
    ids, x, own = block.ids, block.x, block.rank[first].astype(np.int16)
    norm = np.sqrt((x * x).sum(1))
    most = max(RERANK_LEAST, math.ceil(RERANK * len(first)))

    def scored(c: np.ndarray, qi: int, qv: np.ndarray) -> list[tuple[int, float]]:
        at = np.array([i for g in c.tolist() for i in copies[g]], dtype=np.int64)
        at = at[ids[at] != qi]
        return _nearest(ids[at], (x[at] * qv).sum(1) / (norm[at] * math.sqrt((qv * qv).sum())), k)

    least = np.full(len(q), -np.inf)
    for n, (qi, qv, qr) in enumerate(zip(q_ids.tolist(), q, q_rank.astype(np.int16), strict=True)):
        seen = np.zeros(len(first), bool)
        for p in np.flatnonzero(qr < probe).tolist():
            if p in block.files:
                seen[block.files[p]] = True
        c = np.flatnonzero(seen)
        if len(c) > most:
            foot = np.abs(own[c] - qr).sum(1, dtype=np.int32)
            c = c[np.argpartition(foot, most - 1)[:most]]
        best = scored(c, qi, qv)
        if len(best) == k:
            least[n] = best[-1][1]
    every = _others(unit(x[first]), own.argmin(1), unit(q), least, pivots)
    return [(qi, i, s) for qi, qv, c in zip(q_ids.tolist(), q, every, strict=True) for i, s in scored(c, qi, qv)]


VECTOR, QUERY, FILE = 0, 1, 2
ROWS = "b int, kind int, at long, v array<double>, perm binary, group int"


def _search_one(rows: DataFrame, asked: DataFrame, scratch: Scratch, k: int, pivots: int, post: int, probe: int) -> DataFrame:
    """query_id, vec_id, score over all blocks, for vectors of one dimension."""
    centres = fit_pivots(rows, pivots)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    kind = np.uint8 if len(centres) <= 256 else np.uint16

    def ranked(batches):
        for b in batches:
            if b.num_rows:
                rank = permutations(_matrix(b.column("v")), centres)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array([r.tobytes() for r in rank], pa.binary())], ["vec_id", "v", "perm"])

    schema = "vec_id long, v array<double>, perm binary"
    index, asked = scratch.write(rows.mapInArrow(ranked, schema)), scratch.write(asked.mapInArrow(ranked, schema))
    many, q_many = index.count(), asked.count()
    blocks = max(1, math.ceil(many / min(BLOCK, max(BLOCK_LEAST, many / SPREAD))))
    q_blocks = max(1, math.ceil(q_many / QUERY_BLOCK))
    # rows of one id and vector count once, so that a hot id doesn't fill a block
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v", F.lit(SEED)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.asarray(table.column("at").combine_chunks())
        return ids, _matrix(table.column("v")), np.frombuffer(b"".join(table.column("perm").to_pylist()), kind).reshape(len(ids), -1)

    def posted(key: tuple, table: pa.Table) -> pa.Table:
        block = build(*arrays(table), post)
        n, files = len(block.ids), sorted(block.files)
        none = [None] * len(files)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(block.x.ravel()), block.x.shape[1]).cast(pa.list_(pa.float64())).to_pylist()
        return pa.table({
            "b": pa.array([key[0].as_py()] * (n + len(files)), pa.int32()), "kind": pa.array([VECTOR] * n + [FILE] * len(files), pa.int32()),
            "at": pa.array([*block.ids.tolist(), *files], pa.int64()), "v": pa.array([*lists, *none], pa.list_(pa.float64())),
            "perm": pa.array([*(r.tobytes() for r in block.rank), *(block.files[p].astype("<i4").tobytes() for p in files)], pa.binary()),
            "group": pa.array([*block.group.tolist(), *none], pa.int32()),
        })

    dealt = index.dropDuplicates(["vec_id", "v"]).select(deal(blocks).alias("b"), F.col("vec_id").alias("at"), "v", "perm")
    files = scratch.write(dealt.groupBy("b").applyInArrow(posted, ROWS))
    left = files.select("*", all_of(q_blocks).alias("q"))
    right = asked.select(all_of(blocks).alias("b"), F.lit(QUERY).alias("kind"), F.col("vec_id").alias("at"), "v", "perm", F.lit(None).cast("int").alias("group"), deal(q_blocks).alias("q"))

    def best(table: pa.Table) -> pa.Table:
        of = {c: table.filter(pa.array(np.asarray(table.column("kind").combine_chunks()) == c)) for c in (VECTOR, QUERY, FILE)}
        found = []
        if of[VECTOR].num_rows and of[QUERY].num_rows:
            group = np.asarray(of[VECTOR].column("group").combine_chunks())
            ids, x, rank = arrays(of[VECTOR])
            order = np.lexsort((group, ids))
            posts = {p: np.frombuffer(raw, "<i4") for p, raw in zip(of[FILE].column("at").to_pylist(), of[FILE].column("perm").to_pylist(), strict=True)}
            found = search_block(Block(ids[order], x[order], rank[order], group[order], posts), *arrays(of[QUERY]), centres, k, probe)
        return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    return left.unionByName(right).groupBy("b", "q").applyInArrow(best, SCHEMA)


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, pivots: int = PIVOTS, post: int = POST, probe: int = PROBE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, ties to the smaller id.

    Both inputs have vec_id and embedding; a row with the query's id is never its candidate."""
    scratch, rows, asked = Scratch(vectors.sparkSession, "ann"), usable(vectors), usable(queries)
    near = vectors.sparkSession.createDataFrame([], SCHEMA)
    for d in sorted(r.d for r in asked.select(F.size("v").alias("d")).distinct().collect()):
        near = near.unionByName(_search_one(rows.where(F.size("v") == d), asked.where(F.size("v") == d), scratch, k, pivots, post, probe))
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
