"""Substring dedup on a compacted de Bruijn graph of word windows.

A window of WINDOW words is a k-mer; its first and last WINDOW - 1 words are nodes.  Texts are cut at
nodes whose content says so, so that equal passages are cut alike, and the k-mers between two such
nodes are one edge (u, v) with a 128-bit hash.  Edges that occur twice or more are the graph.  Where
exactly one edge enters a node and one leaves it, the two are one path: Spark joins edges to the next
ones and doubles the pointers until every edge knows the head of its nonbranching path and its offset.

An edge has a first occurrence; all others are repeats, with every window in them.  Repeats of a
document that lie on one path at one distance from its head are one span if their coordinates in the
source (doc_id, start) say that they follow each other without a gap; otherwise they stay apart.

The earliest occurrence of any window lies in the first occurrence of its edge, so only these (the
``open`` windows) remain.  Most are unique, which their minimizer shows: two equal windows have the
same rarest word n-gram (by hash), so a window whose n-gram occurs once is unique.  The few others
are joined window by window.  Source coordinates decide which occurrence stays, and the removal
covers whole runs of repeated windows.  Everything is judged on the input.

Null and empty texts have no words and stay.  Of rows with one doc_id neither is earlier than the
other; they are told apart by their text's checksum (``t``).  A null doc_id counts as the smallest.
Equal rows lose the same words.  An empty table gives no rows, and other columns pass whatever their
names.  Memory is bounded by a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kinfold.llm import words as W
from kinfold.llm.store import Scratch

WINDOW = 20
#: Words of the n-gram that makes a node one where texts are cut, and the mean length of an edge.
JUNCTION_GRAM, PATH = 4, 16
#: Words of a minimizer.
MINIMIZER = 8

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Text:
    """Word hashes of a slice of texts, and hashes of any span of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.ptr = W.spans(data, offsets)
        self.h = W.hashes(data, self.starts, self.ends)
        self.n_words = np.diff(self.ptr)
        self._sums: list[np.ndarray] = []

    def spans(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of words [start, end)."""
        n = len(self.h)
        if not self._sums:
            for k, base in enumerate(_BASE):
                if k not in _pow or len(_pow[k][0]) <= n:
                    size = max(n + 1, 1 << 19)
                    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
                    up[0] = down[0] = 1
                    _pow[k] = np.multiply.accumulate(up), np.multiply.accumulate(down)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum((self.h if k == 0 else W.mix(self.h ^ np.uint64(base))) * _pow[k][0][:n], out=total[1:])
                self._sums.append(total)
        return tuple(W.mix((s[end] - s[start]) * _pow[k][1][start]) for k, s in enumerate(self._sums))

    def windows(self) -> np.ndarray:
        """Global word positions at which a window of a single text starts."""
        if len(self.h) < WINDOW:
            return np.zeros(0, np.int64)
        doc = W.per_doc(self.ptr)
        at = np.arange(len(self.h) - WINDOW + 1)
        return at[doc[at] == doc[at + WINDOW - 1]]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, and text of each edge."""
        at = self.windows()
        if not len(at):
            return at, at, at
        doc = W.per_doc(self.ptr)[at]
        junction = (W.grams(self.h, JUNCTION_GRAM)[at] >> np.uint64(40)) % np.uint64(PATH) == 0
        junction[0] = True
        junction[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(junction)
        return at[first], np.diff(np.append(first, len(at))), doc[first]

    def minimizers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest n-gram hash of each window that starts in ``at``, and its leftmost position."""
        g = W.grams(self.h, MINIMIZER)
        many = WINDOW - MINIMIZER + 1
        least = g[at].copy()
        where = at.copy()
        for k in range(1, many):
            x = g[at + k]
            less = x < least
            least[less] = x[less]
            where[less] = at[less] + k
        return least, where


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Text, np.ndarray, np.ndarray]]:
    for batch, data, offsets in W.slices(batches):
        yield batch, Text(data, offsets), *(np.asarray(batch.column(batch.schema.get_field_index(k))) for k in ("doc_id", "t"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge of each text: hashes a and b of its words, its nodes u and v, and where it lies."""
    for _, text, ids, t in _texts(batches):
        first, many, doc = text.paths()
        a, b = text.spans(first, first + many - 1 + WINDOW)
        u, v = (text.spans(at, at + WINDOW - 1)[0] for at in (first, first + many))
        yield pa.RecordBatch.from_arrays([*map(_signed, (a, b, u, v)), pa.array(ids[doc], pa.int64()), pa.array(t[doc], pa.int32()), pa.array((first - text.ptr[doc]).astype(np.int32)), pa.array(many.astype(np.int32))], ["a", "b", "u", "v", "id", "t", "start", "many"])


EDGES = "a long, b long, u long, v long, id long, t int, start int, many int"


def compact(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, ha, hb, off) of distinct edges (a, b, u, v, many): the head of the nonbranching path that
    each lies on, and the windows between.  An edge that nothing precedes is its own head, and so are
    those of a closed path, which has none."""
    through = edges.groupBy(F.col("v").alias("n")).agg(F.count("*").alias("enter")).join(edges.groupBy(F.col("u").alias("n")).agg(F.count("*").alias("leave")), "n").where("enter = 1 and leave = 1").select("n")
    left = edges.join(through, edges.v == through.n).select("n", F.struct("a", "b").alias("before"), F.col("many").alias("gap"))
    right = edges.join(through, edges.u == through.n).select("n", "a", "b")
    back = right.join(left, "n").where("before != struct(a, b)").select("a", "b", "before", "gap")
    # far: the edge 2^round steps back, null beyond the head; top: the last edge seen on the way; off: windows from top
    now = edges.select("a", "b").join(back, ["a", "b"], "left").select("a", "b", F.col("before").alias("far"), F.coalesce("before", F.struct("a", "b")).alias("top"), F.coalesce(F.col("gap").cast("long"), F.lit(0)).alias("off"))
    now, open_ = scratch.write(now), -1
    while (left_open := now.where("far is not null").count()) not in (0, open_):
        open_ = left_open
        seen = now.select(F.struct("a", "b").alias("far"), F.col("far").alias("_far"), F.col("top").alias("_top"), F.col("off").alias("_off"))
        done, rest = now.where("far is null"), now.where("far is not null").join(seen, "far")
        then = scratch.write(done.unionByName(rest.select("a", "b", F.col("_far").alias("far"), F.col("_top").alias("top"), (F.col("off") + F.col("_off")).alias("off"))))
        scratch.drop(now)
        now = then
    closed = F.col("far").isNotNull()
    return now.select("a", "b", F.when(closed, F.col("a")).otherwise(F.col("top.a")).alias("ha"), F.when(closed, F.col("b")).otherwise(F.col("top.b")).alias("hb"), F.when(closed, F.lit(0)).otherwise(F.col("off")).alias("off"))


def repeated_spans(places: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, t, p: spans (start, many)) of the windows in all but the first occurrences of edges."""
    where = F.struct("id", "start")
    graph = places.groupBy("a", "b").agg(F.min(where).alias("first"), F.max(where).alias("last"), F.min("u").alias("u"), F.min("v").alias("v"), F.min("many").alias("many")).where("first != last")
    graph = scratch.write(graph.select("a", "b", "u", "v", "many", "first"))
    scratch.sweep()
    paths = scratch.write(graph.select("a", "b", "first").join(compact(graph.select("a", "b", "u", "v", "many"), scratch), ["a", "b"]))
    again = places.select("a", "b", "id", "t", "start", "many").join(paths, ["a", "b"]).where(where != F.col("first"))
    end = F.col("start") + F.col("many")
    runs = again.groupBy(F.col("id").alias("doc_id"), "t", "ha", "hb", (F.col("start") - F.col("off")).alias("diagonal")).agg(
        F.min("start").alias("s"), F.max(end).alias("e"), F.collect_set(F.struct("start", "many")).alias("l"))
    runs = runs.withColumn("m", F.aggregate("l", F.lit(0), lambda n, x: n + x["many"]))  # equal rows give each edge once
    whole = F.array(F.struct(F.col("s").alias("start"), F.col("m").alias("many")))  # the coordinates leave no gap
    return runs.select("doc_id", "t", F.when(F.col("e") - F.col("s") == F.col("m"), whole).otherwise(F.col("l")).alias("l")).groupBy("doc_id", "t").agg(F.flatten(F.collect_list("l")).alias("p"))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column (null: empty) and n + 1 offsets."""
    c = batch.column(batch.schema.get_field_index(name))
    if c.null_count:
        c = pa.array([x or [] for x in c.to_pylist()], c.type)
    o = c.offsets.to_numpy()
    return c.values.to_numpy()[o[0] : o[-1]], o - o[0]


def _open(batch: pa.RecordBatch, text: Text) -> np.ndarray:
    """Windows of a slice outside the repeated spans in columns path_start and path_many."""
    at = text.windows()
    start, ptr = _lists(batch, "path_start")
    many, _ = _lists(batch, "path_many")
    begin = start + np.repeat(text.ptr[:-1], np.diff(ptr))
    edge = np.zeros(len(text.h) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + many, -1)
    return at[np.cumsum(edge)[at] == 0]


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each minimizer of the open windows of each text, with the number of its places in the text."""
    for batch, text, ids, t in _texts(batches):
        value, where = text.minimizers(_open(batch, text))
        doc = W.per_doc(text.ptr)[where] if len(where) else where
        order = np.lexsort((where, value, doc))
        value, where, doc = value[order], where[order], doc[order]
        place, group = np.ones(len(order), bool), np.ones(len(order), bool)
        group[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        place[1:] = group[1:] | (where[1:] != where[:-1])
        at = np.flatnonzero(group)
        count = np.add.reduceat(place.astype(np.int32), at) if len(at) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([_signed(value[at]), pa.array(ids[doc[at]], pa.int64()), pa.array(t[doc[at]], pa.int32()), pa.array(count.astype(np.int32))], ["g", "id", "t", "n"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open windows whose minimizer is in the column ``shared``."""
    for batch, text, ids, t in _texts(batches):
        at = _open(batch, text)
        value, _ = text.minimizers(at)
        doc = W.per_doc(text.ptr)[at] if len(at) else at
        listed, ptr = _lists(batch, "shared")
        key = np.unique(W.mix(listed.astype(np.int64).view(np.uint64) ^ np.repeat(np.arange(len(ids)), np.diff(ptr)).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        own = W.mix(value ^ doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        if len(key):
            i = np.minimum(np.searchsorted(key, own), len(key) - 1)
            at, doc = at[key[i] == own], doc[key[i] == own]
        else:
            at, doc = at[:0], doc[:0]
        a, b = text.spans(at, at + WINDOW)
        yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(ids[doc], pa.int64()), pa.array(t[doc], pa.int32()), pa.array((at - text.ptr[doc]).astype(np.int32))], ["a", "b", "id", "t", "start"])


def _removed(whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, removed words and kept text of each document; with ``whole``, a text that loses nothing stays as it is."""
    for batch, text, _, _ in _texts(batches):
        edge = np.zeros(len(text.h) + 1, np.int64)
        for starts, many in (("path_start", "path_many"), ("window_start", None)):
            start, ptr = _lists(batch, starts)
            begin = start + np.repeat(text.ptr[:-1], np.diff(ptr))
            length = (_lists(batch, many)[0] if many else np.ones(len(start), np.int64)) + WINDOW - 1
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        n_gone = W.sums(gone.astype(np.int64), text.ptr)
        raw = text.data.tobytes()
        starts, ends, ptr = text.starts.tolist(), text.ends.tolist(), text.ptr.tolist()
        kept = []
        original = batch.column(batch.schema.get_field_index("text")).to_pylist() if whole else None
        for i in range(len(ptr) - 1):
            if whole and not n_gone[i]:
                kept.append(original[i])
                continue
            at = (np.flatnonzero(~gone[ptr[i] : ptr[i + 1]]) + ptr[i]).tolist()
            kept.append(b" ".join([raw[starts[j] : ends[j]] for j in at]).decode("utf-8", "replace"))
        own = batch.column(batch.schema.get_field_index("_row"))
        yield pa.RecordBatch.from_arrays([own, pa.array(text.n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], ["_row", "n_words", "n_removed", "kept"])


def _repeats(places: DataFrame, scratch: Scratch, *more: str) -> DataFrame:
    """Places (a, b, id, start) of a hash that also has an earlier place.  Groups are aggregated before
    the shuffle; the join back is one that Spark splits where a hash has very many places."""
    first = scratch.write(places.groupBy("a", "b").agg(F.min(F.struct("id", "start")).alias("first"), F.max(F.struct("id", "start")).alias("last")).where("first != last").drop("last"))
    return places.join(first, ["a", "b"]).where(F.struct("id", "start") != F.col("first")).select("id", "t", "start", *more)


def _id(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row."""
    return _dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), False).select("_row.doc_id", "n_words", "n_removed", "kept")


def strip(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages, with the same columns.

    A text that loses nothing stays as it is; n_chars, if there, follows the text.  Documents of which
    no word is left go; those without words stay."""
    rows = _dedup(docs, True).where("n_words = 0 or n_removed < n_words")
    cols = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("_row.n_chars") if "n_chars" in docs.columns else None)}
    return rows.select(*(cols[c].alias(c) if c in cols else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def _dedup(docs: DataFrame, whole: bool) -> DataFrame:
    """_row (the other columns), n_words, n_removed, kept for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "substring")
    texts = docs.select(_id(docs).alias("doc_id"), (F.col("text") if whole else F.coalesce("text", F.lit(""))).alias("text"), F.struct(*(c for c in docs.columns if c != "text")).alias("_row"), (F.crc32(F.coalesce("text", F.lit(""))) - F.lit(2**31)).cast("int").alias("t"))

    key = ["doc_id", "t"]
    places = texts.select(*key, "text").mapInArrow(_edges, EDGES)
    gone = scratch.write(repeated_spans(places, scratch))
    scratch.sweep()

    # lists of places go to the texts, which are read again from their source and never written
    spans = [F.col("p.start").alias("path_start"), F.col("p.many").alias("path_many")]
    grams = scratch.write(texts.select(*key, "text").join(gone, key, "left").select(*key, "text", *spans).mapInArrow(_minimizers, "g long, id long, t int, n int"))
    scratch.sweep()
    shared = scratch.write(grams.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"))
    scratch.sweep()
    listed = scratch.write(grams.join(shared, "g").groupBy(F.col("id").alias("doc_id"), "t").agg(F.collect_set("g").alias("shared")).join(gone, key, "left"))
    scratch.drop(grams, shared)
    scratch.sweep()
    windows = scratch.write(texts.select(*key, "text").join(listed, key).select(*key, "text", *spans, "shared").mapInArrow(_candidates, "a long, b long, id long, t int, start int"))
    scratch.drop(listed)
    scratch.sweep()
    again = _repeats(windows, scratch).groupBy(F.col("id").alias("doc_id"), "t").agg(F.collect_set("start").alias("window_start"))
    both = scratch.write(gone.join(again, key, "full").select(*key, *spans, "window_start"))
    scratch.drop(windows, gone)
    scratch.sweep()
    return texts.join(both, key, "left").select(*key, "text", "_row", "path_start", "path_many", "window_start").mapInArrow(partial(_removed, whole), StructType([texts.schema["_row"], *map(StructField, ("n_words", "n_removed", "kept"), (LongType(), LongType(), StringType()))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t)),
f AS (SELECT r, i, (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY s) AS dup FROM v),
p AS (SELECT r, w[i] AS x, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
k AS (SELECT p.r, p.i, p.x, coalesce(max(CASE WHEN f.dup THEN p.i END) OVER (PARTITION BY p.r ORDER BY p.i) > p.i - {WINDOW}, false) AS gone
  FROM p LEFT JOIN f ON p.r = f.r AND p.i = f.i),
o AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY r)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(o.n, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM t LEFT JOIN o ON t.r = o.r
"""
