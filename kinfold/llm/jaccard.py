"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct word shingles (64-bit hashes); documents with equal sets are
one node.  Two nodes link when, by the rule of 90 %, 100 * |x & y| >= 90 * |x | y|.  Every link is found:

1. Bands.  The smaller set of a pair lies in a band of sizes [l, u]; the pair differs in at most
   k = u // 9 shingles.  Hash ranges cut each set of the band's tile into more than k parts, and a
   shingle that differs changes one part, so at most k parts differ.  A set that fills more than k
   parts posts those; at least one is equal in its partner.  Of sets that fill fewer (rare) all
   parts are posted, empty ones too.  A part's signature is a sum of hashes.  Parts are first made
   of the shingles that aren't frequent in a sample, and of all shingles where too few are left.
2. Equal signatures are stars: each task keeps one node per signature and links its others to it, so
   after the shuffle a signature has a row for each task at most.  Linked pairs share a star, so all
   links are inside connected components of the stars (``groups``).
3. Tiles.  Within a group, sorted by size, bitmaps of hashed shingles bound each overlap from above
   (a bit set in only one of two bitmaps is a shingle that the other lacks); pairs that may still
   reach the threshold and aren't connected yet are decided by intersecting the sorted arrays.
   A group beyond TILE nodes first verifies its stars; only nodes outside its largest component then
   meet all others, in tiles of bounded size.
4. Groups beyond WIDE tiles.  Parts that many unlike sets share by chance join their groups, and the
   more texts, the larger such a group, so its nodes don't all meet.  Two sets of a link differ in no more
   parts of a tile than in shingles, which a byte for each part shows (``alike``).  Nodes with an equal
   signature are compared by these bytes, those outside the largest component of a signature with the
   others of it; the groups of what passes then take the place of the group.

No pairs within a group are listed: a tile gives a spanning forest of its links.  Empty sets link
with nothing.  Null text counts as empty; repeated rows are copies; a null doc_id never names a
component that holds another id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinfold.llm import graph
from kinfold.llm import words as W
from kinfold.llm.store import Scratch

#: Nodes on either side of a tile.
TILE = 1024
#: Tiles of nodes that a group may have for its nodes to meet by texts; larger ones are taken apart first.
WIDE = 8
#: Postings that a task gathers before it reduces them to stars.
FLUSH = 1_500_000
#: Texts of the sample for frequent shingles; a shingle counts as frequent in so many of its sets.
SAMPLE, POPULAR, POPULAR_MOST = 10_000, 5, 200_000
#: Parts into which the nodes of a group are dealt when they meet its size.
SALTS = 64
#: Sizes of a band differ by this factor at most.
RATIO = 1.5

_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Sets of ``shingle`` words; a link: part * intersection >= whole * union."""

    shingle: int = 3
    part: int = 100
    whole: int = 90

    @property
    def least(self) -> int:
        """Smallest size of a set that can link to a different one that is no smaller."""
        return -(-self.whole // (self.part - self.whole)) if self.whole < self.part else 1 << 40

    @cached_property
    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        low = [self.least]
        while low[-1] < 1 << 34:
            low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
        return np.array(low[:-1]), np.array(low[1:]) - 1

    def differ(self, size: int) -> int:
        """Shingles in which two linked sets can differ if the smaller has at most ``size``."""
        return size * (self.part - self.whole) // self.whole

    @cached_property
    def _cuts(self) -> dict[int, np.ndarray]:
        return {}

    def cuts(self, band: int) -> np.ndarray:
        """Lower ends of the hash ranges of a band: so many that the smallest sets fill more than
        differ() of them, but for a rare few."""
        if band not in self._cuts:
            low, k = int(self.bands[0][band]), self.differ(int(self.bands[1][band]))
            m = k + 3
            while m < 2 * k + 8 and m * (1 - math.exp(-low / m)) - 3 * math.sqrt(m * math.exp(-low / m)) < k + 1:
                m += 1
            self._cuts[band] = np.array([(i << 64) // m for i in range(m)], dtype=np.uint64)
        return self._cuts[band]

    def may_link(self, n: int, m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether sets of n and m shingles can link by their bitmaps: a bit set in only one of them is
        a shingle that the other lacks, which bounds the overlap from above."""
        lacks = np.bitwise_count(x & ~y).sum(-1, dtype=np.int64)
        extra = np.bitwise_count(y & ~x).sum(-1, dtype=np.int64)
        most = np.minimum(n - lacks, m - extra)
        return self.part * most >= self.whole * (n + m - most)

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether two sorted sets reach the threshold."""
        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
        return self.part * both >= self.whole * (len(x) + len(y) - both)


class Sets:
    """Sorted distinct shingle hashes of each text of a slice, in values[ptr[i]:ptr[i+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: Rule):
        self.rule, n = rule, rule.shingle
        starts, ends, ptr = W.spans(data, offsets)
        h = W.hashes(data, starts, ends, lower=True)
        doc, many = W.per_doc(ptr), np.diff(ptr)
        values, docs = [], []
        for k in range(1, n + 1):  # a shorter text is one shingle
            g = W.grams(h, k)
            at = np.arange(len(g))
            d = doc[: len(g)]
            ok = (many[d] >= n) & (at + n <= ptr[1:][d]) if k == n else (many[d] == k) & (at == ptr[:-1][d])
            values.append(g[ok])
            docs.append(d[ok])
        v, d = np.concatenate(values), np.concatenate(docs)
        order = np.lexsort((v, d))
        v, d = v[order], d[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        self.values, self.ptr = v[new], np.searchsorted(d[new], np.arange(len(offsets)))
        self.size = np.diff(self.ptr)
        self.total = np.zeros(len(self.values) + 1, np.uint64)
        np.cumsum(W.mix(self.values), out=self.total[1:])

    def nodes(self) -> np.ndarray:
        """A hash of each set."""
        return W.mix((self.total[self.ptr[1:]] - self.total[self.ptr[:-1]]) ^ (self.size.astype(np.uint64) * _U(0xD1B54A32D192ED03))).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.ptr[i] : self.ptr[i + 1]]

    def mark(self, popular: np.ndarray) -> None:
        """Sets apart the shingles that are in the sorted hashes ``popular``."""
        rare = np.ones(len(self.values), bool)
        if len(popular) and len(rare):
            rare = popular[np.minimum(np.searchsorted(popular, self.values), len(popular) - 1)] != self.values
        self.rare_count = np.zeros(len(rare) + 1, np.int64)
        np.cumsum(rare, out=self.rare_count[1:])
        self.rare_total = np.zeros(len(rare) + 1, np.uint64)
        np.cumsum(np.where(rare, self.total[1:] - self.total[:-1], _U(0)), out=self.rare_total[1:])

    def _cut(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        """The band of set i and, near its lower end, the one below, with the bounds of its parts there."""
        size, s, rule = int(self.size[i]), self.of(i), self.rule
        low, high = rule.bands
        if size < low[0]:
            return
        own = int(np.searchsorted(low, size, side="right")) - 1
        for band in (own, own - 1):
            if band >= 0 and (band == own or rule.whole * size <= rule.part * int(high[band])):
                yield band, np.append(np.searchsorted(s, rule.cuts(band)), size) + self.ptr[i]

    def sketches(self, i: int) -> Iterator[tuple[int, bytes]]:
        """By band, a byte of the sum of each part."""
        for band, b in self._cut(i):
            yield band, W.mix(self.total[b[1:]] - self.total[b[:-1]]).astype(np.uint8).tobytes()

    def postings(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        """Part signatures of set i in the tiles of its bands."""
        for band, b in self._cut(i):
            differ = self.rule.differ(int(self.rule.bands[1][band]))
            part = np.arange(len(b) - 1, dtype=np.uint64) + _U((2 * band + 1) << 40)
            full = self.rare_count[b[1:]] > self.rare_count[b[:-1]]
            sums = self.rare_total[b[1:]] - self.rare_total[b[:-1]]
            yield band, W.mix(sums[full] ^ W.mix(part[full]))
            if np.count_nonzero(full) <= differ:  # too few rare shingles: meet the like of it by all shingles
                part += _U(1 << 40)
                full = b[1:] > b[:-1]
                sums = self.total[b[1:]] - self.total[b[:-1]]
                if np.count_nonzero(full) > differ:
                    sums, part = sums[full], part[full]
                yield band, W.mix(sums ^ W.mix(part))


def _nodes(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in W.slices(batches):
        s = Sets(data, offsets, rule)
        node = pa.array(s.nodes(), pa.int64(), mask=s.size == 0)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(s.size.astype(np.int64)), node], ["doc_id", "n_shingles", "node"])


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each signature its smallest node, and the distinct (node, smallest) links of the others."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    centre = node[first][np.cumsum(first) - 1] if len(sig) else node
    other = node != centre
    a, b = node[other], centre[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return sig[first], node[first], a[new], b[new]


def _posted(rule: Rule, popular: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, a, null): node a has the signature; (any, a, b): a link of this task's stars."""
    held_sig, held_node, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        sig, node, a, b = _stars(np.concatenate(held_sig), np.concatenate(held_node))
        keys = np.concatenate([sig.view(np.int64), W.mix(a.view(np.uint64)).view(np.int64)])
        centre = pa.array(np.concatenate([np.zeros(len(sig), np.int64), b]), pa.int64(), mask=np.arange(len(keys)) < len(sig))
        out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([node, a])), centre], ["sig", "a", "b"])
        for i in range(0, out.num_rows, 100_000):
            yield out.slice(i, 100_000)

    for _, data, offsets in W.slices(batches):
        s = Sets(data, offsets, rule)
        s.mark(popular)
        nodes = s.nodes()
        _, index = np.unique(nodes, return_index=True)
        for i in index.tolist():
            for _, sig in s.postings(i):
                held_sig.append(sig)
                held_node.append(np.full(len(sig), nodes[i]))
                held += len(sig)
        if held >= FLUSH:
            yield from flush()
            held_sig, held_node, held = [], [], 0
    yield from flush()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of stars over rows sorted by signature."""
    last_sig, last_node = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch.column(2)
        link = np.asarray(b.is_valid())
        sig, node = np.asarray(batch.column(0))[~link], np.asarray(batch.column(1))[~link]
        a, c = [np.asarray(batch.column(1))[link]], [b.drop_null().to_numpy(zero_copy_only=False)]
        if len(sig):
            s, n = sig, node
            if last_sig is not None and last_sig == sig[0]:
                s, n = np.append(last_sig, s), np.append(last_node, n)
            first_sig, first_node, x, y = _stars(s, n)
            a.append(x)
            c.append(y)
            at = int(np.flatnonzero(first_sig == sig[-1])[0])
            last_sig, last_node = sig[-1], first_node[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(c), pa.int64())], ["a", "b"])


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap for each set, of about four bits for each shingle of the largest, as rows of words."""
    bits = 64
    while bits < 4 * max(map(len, sets)):
        bits *= 2
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        b = W.mix(s) & _U(bits - 1)
        np.bitwise_or.at(out[i], (b >> _U(6)).astype(np.int64), _U(1) << (b & _U(63)))
    return out


def tile_links(rule: Rule, nodes: np.ndarray, fine: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between components ``fine`` of a tile.

    Pairs are those of a row with side & 1 and one with side & 2; rows of one component aren't compared.
    """
    size = np.array([len(s) for s in sets])
    maps = bitmaps(sets)
    may = lambda i, js: js[rule.may_link(size[i], size[js], maps[i], maps[js])]
    return _forest(rule, nodes, fine, side, size, may, lambda i, j: rule.linked(sets[i], sets[j]))


def alike_links(rule: Rule, nodes: np.ndarray, fine: np.ndarray, side: np.ndarray, size: np.ndarray, parts: np.ndarray) -> list[tuple[int, int]]:
    """The same of pairs that differ in no more parts than linked sets can; parts: a row of bytes for each node."""
    may = lambda i, js: js[(parts[js] != parts[i]).sum(1) <= rule.differ(int(size[i]))]
    return _forest(rule, nodes, fine, side, size, may, lambda i, j: True)


def _forest(rule: Rule, nodes: np.ndarray, fine: np.ndarray, side: np.ndarray, size: np.ndarray, may: Callable[[int, np.ndarray], np.ndarray], linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Of each row, by size, ``may`` picks among the larger ones that it may meet, ``linked`` decides."""
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    _, of = np.unique(fine[order], return_inverse=True)
    found, left = [], int(of.max()) + 1
    for i in range(len(order)):
        if left == 1:
            break
        far = int(np.searchsorted(size, rule.part * size[i] // rule.whole, side="right"))  # the band of sizes above row i
        if far <= i + 1:
            continue
        js = np.arange(i + 1, far)
        js = js[(((side[i] & 1) & (side[js] >> 1) | (side[i] >> 1) & (side[js] & 1)) > 0) & (of[js] != of[i])]
        if not len(js):
            continue
        at = np.zeros(len(order), np.int64)
        at[order[js]] = js
        for j in at[may(int(order[i]), order[js])].tolist():
            if of[i] != of[j] and linked(int(order[i]), int(order[j])):
                of[of == of[j]] = of[i]
                left -= 1
                found.append((int(nodes[order[i]]), int(nodes[order[j]])))
    return found


def _sets_of(rule: Rule, table: pa.Table, text: str = "text") -> list[np.ndarray]:
    out = []
    for _, data, offsets in W.slices(iter(table.combine_chunks().to_batches()), text):
        s = Sets(data, offsets, rule)
        out += [s.of(i).copy() for i in range(len(offsets) - 1)]
    return out


def _tiles(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each tile; rows come sorted by tile (g, x, m), with texts, or sizes and parts."""

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        node, fine, side = (np.asarray(rows.column(k).combine_chunks()) for k in ("node", "fine", "side"))
        if len(node) < 2:
            return []
        if "parts" not in rows.column_names:
            return tile_links(rule, node, fine, side, _sets_of(rule, rows))
        parts = np.frombuffer(b"".join(rows.column("parts").to_pylist()), np.uint8).reshape(len(node), -1)
        return alike_links(rule, node, fine, side, np.asarray(rows.column("size").combine_chunks()), parts)

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        key = np.column_stack([np.asarray(rows.column(k).combine_chunks()) for k in ("g", "x", "m")])
        cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        found, start = [], 0
        for stop in cut.tolist():
            found += links(rows.slice(start, stop - start))
            start = stop
        held = rows.slice(start)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    if held is not None:
        found = links(held)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _verified(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts link: sizes and bitmaps bound the overlap, arrays decide."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ok = []
        for i in range(0, table.num_rows, 500):
            part = table.slice(i, 500)
            for x, y in zip(_sets_of(rule, part, "text_a"), _sets_of(rule, part, "text_b"), strict=True):
                small, large = sorted((len(x), len(y)))
                ok.append(rule.part * small >= rule.whole * large and rule.may_link(len(x), len(y), *bitmaps([x, y])) and rule.linked(x, y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _placed(rule: Rule, popular: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node, band): the node has the signature."""
    for _, data, offsets in W.slices(batches):
        s = Sets(data, offsets, rule)
        s.mark(popular)
        found = [(sig, node, band) for i, node in enumerate(s.nodes().tolist()) for band, sig in s.postings(i)]
        if not found:
            continue
        sigs, nodes, bands = zip(*found, strict=True)
        many = [len(x) for x in sigs]
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), many)), pa.array(np.repeat(np.array(bands, np.int32), many))], ["sig", "node", "band"])
        for i in range(0, out.num_rows, 100_000):
            yield out.slice(i, 100_000)


def _sketched(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, band, size, parts) of each node in the tiles of its bands."""
    for _, data, offsets in W.slices(batches):
        s = Sets(data, offsets, rule)
        rows = [(node, band, int(s.size[i]), parts) for i, node in enumerate(s.nodes().tolist()) for band, parts in s.sketches(i)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["node", "band", "size", "parts"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature those whose signature another row has."""
    held, before = None, False  # the last row, and whether the one before it has its signature
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        sig = np.asarray(rows.column(0))
        same = np.concatenate([[before and held is not None], sig[1:] == sig[:-1], [False]])
        held, before = rows.slice(rows.num_rows - 1), bool(same[-2])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array((same[:-1] | same[1:])[:-1]))
    if held is not None and before:
        yield held


def _own(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the nodes that are asked for."""
    for batch, data, offsets in W.slices(batches):
        same = Sets(data, offsets, rule).nodes() == np.asarray(batch.column(batch.schema.get_field_index("node")))
        yield batch.select(["node", "g", "many", "text"]).filter(pa.array(same))


def _sampled(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the sample's distinct sets, by hash part."""
    for _, data, offsets in W.slices(batches):
        s = Sets(data, offsets, rule)
        _, index = np.unique(s.nodes(), return_index=True)
        v = np.concatenate([s.of(i) for i in index.tolist()])
        part = (v >> _U(59)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(33))
        rows = [(p, v[order[cut[p] : cut[p + 1]]].tobytes()) for p in range(32) if cut[p] < cut[p + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "v"])


def _counted(table: pa.Table) -> pa.Table:
    v, n = np.unique(np.frombuffer(b"".join(table.column("v").to_pylist()), np.uint64), return_counts=True)
    top = np.lexsort((v, -n))[: POPULAR_MOST // 32]
    top = top[n[top] >= POPULAR]
    return pa.table({"v": pa.array(v[top].view(np.int64), pa.int64())})


def popular_shingles(texts: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted hashes of at most POPULAR_MOST shingles that are frequent in a bounded sample of texts.

    Only a hint: a passage that many documents share makes unlike documents fill parts alike.  Parts
    are therefore made of the other shingles where these fill enough parts; the guarantee holds for
    any list."""
    drawn = texts.select(F.xxhash64("doc_id").alias("_k")).orderBy("_k").limit(SAMPLE).agg(F.max("_k")).first()[0]
    if drawn is None:
        return np.zeros(0, np.uint64)
    rows = texts.where((F.xxhash64("doc_id") <= drawn) & F.col("doc_id").isNotNull()).select("text").mapInArrow(partial(_sampled, rule), "part int, v binary")
    got = rows.groupBy("part").applyInArrow(_counted, "v long").toArrow()
    return np.sort(np.array(got.column("v"), dtype=np.int64).view(np.uint64))


def _dealt(rows: DataFrame) -> DataFrame:
    """Tiles (g, x, m) in which the nodes outside the largest component ``fine`` of their g meet all others of
    it, from (g, node, fine, more columns); a node of side 1 meets those of side 2, 3 is both."""
    more = [c for c in rows.columns if c not in ("g", "node", "fine")]
    sizes = rows.groupBy("g", "fine").agg(F.count("*").alias("n"))
    main = sizes.groupBy("g").agg(F.max(F.struct("n", "fine")).alias("top"), F.sum("n").alias("many"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(main, "g").withColumn("odd", F.col("fine") != F.col("top.fine"))
    cuts = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
    rows = rows.withColumn("gm", cuts(F.col("many"))).withColumn("gx", cuts(F.col("many") - F.col("top.n")))
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = rows.select("g", F.explode(F.sequence(F.lit(0), F.col("gx") - 1)).alias("x"), block(F.col("gm"), 1).alias("m"), "node", "fine", F.lit(2).alias("side"), *more)
    odd = rows.where("odd").select("g", block(F.col("gx"), 2).alias("x"), F.explode(F.sequence(F.lit(0), F.col("gm") - 1)).alias("m"), "node", "fine", F.lit(1).alias("side"), *more)
    return every.unionByName(odd).groupBy("g", "x", "m", "node", "fine", *more).agg(F.sum("side").cast("int").alias("side"))


def alike(texts: DataFrame, fine: DataFrame, popular: np.ndarray, rule: Rule, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes (node, text) that differ in no more parts than linked sets can; with the components
    ``fine`` (node, fine) they connect all nodes that links connect."""
    sketches = texts.select("text").mapInArrow(partial(_sketched, rule), "node long, band int, size long, parts binary")
    placed = texts.select("text").mapInArrow(partial(_placed, rule, popular), "sig long, node long, band int")
    shared = scratch.write(placed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_shared, "sig long, node long, band int"))
    scratch.sweep()
    rows = shared.join(fine, "node").select(F.col("sig").alias("g"), "node", "fine", "band").distinct()
    tiles = _dealt(rows).join(sketches, ["node", "band"]).select("g", "x", "m", "node", "fine", "side", "size", "parts")
    pairs = scratch.write(_in_tiles(tiles, rule).distinct())
    scratch.sweep()
    return pairs


def _apart(texts: DataFrame, fine: DataFrame, popular: np.ndarray, rule: Rule, scratch: Scratch) -> DataFrame:
    """(g, node, fine): groups of components that pairs of ``alike`` connect."""
    a, b = (fine.select(F.col("node").alias(k), F.col("fine").alias(f"f{k}")) for k in ("a", "b"))
    pairs = alike(texts, fine, popular, rule, scratch).join(a, "a").join(b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return fine.join(graph.components(pairs, scratch).select(F.col("node").alias("fine"), F.col("root").alias("g")), "fine").select("g", "node", "fine")


def _in_tiles(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows.repartition("g", "x", "m").sortWithinPartitions("g", "x", "m").mapInArrow(partial(_tiles, rule), "a long, b long")


def node_links(texts: DataFrame, nodes: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links (a, b) of nodes that connect all nodes that links connect.  texts: doc_id, text; nodes: doc_id, node."""
    popular = popular_shingles(texts, rule)
    posted = texts.select("text").mapInArrow(partial(_posted, rule, popular), "sig long, a long, b long")
    stars = scratch.write(posted.repartition("sig").sortWithinPartitions("sig", "a").mapInArrow(_linked, "a long, b long").distinct())
    scratch.sweep()
    groups = scratch.write(graph.components(stars, scratch).select("node", F.col("root").alias("g")))
    scratch.sweep()
    wide = groups.groupBy("g").agg(F.count("*").alias("many")).where(F.col("many") > TILE)
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")  # one group may hold a third of all nodes
    wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = groups.withColumn("salt", salt).join(wide, ["g", "salt"], "left").select("node", "g", F.coalesce("many", F.lit(1)).alias("many"))
    asked = sized.join(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node")
    held = scratch.write(texts.join(asked, "doc_id").select("node", "g", "many", "text").mapInArrow(partial(_own, rule), "node long, g long, many long, text string").dropDuplicates(["node"]))
    scratch.sweep()

    one = F.lit(0)
    small = held.where(F.col("many") <= TILE).select("g", one.alias("x"), one.alias("m"), "node", F.col("node").alias("fine"), F.lit(3).alias("side"), "text")
    links = scratch.write(_in_tiles(small, rule))
    scratch.sweep()
    large = scratch.write(held.where(F.col("many") > TILE))
    if large.isEmpty():
        return links

    pairs = stars.join(large.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(large.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    star_links = scratch.write(pairs.select("a", "b", "text_a", "text_b").mapInArrow(partial(_verified, rule), "a long, b long"))
    scratch.sweep()
    fine = graph.components(star_links, scratch)
    rows = scratch.write(large.select("g", "many", "node").join(fine, "node", "left").select("g", "many", "node", F.coalesce("root", "node").alias("fine")))
    beyond = F.col("many") > WIDE * TILE
    near = rows.where(~beyond).select("g", "node", "fine")
    if not rows.where(beyond).isEmpty():
        near = near.unionByName(_apart(large.where(beyond).select("node", "text"), rows.where(beyond).select("node", "fine"), popular, rule, scratch))
    rest = scratch.write(_in_tiles(_dealt(near).join(large.select("node", "text"), "node").select("g", "x", "m", "node", "fine", "side", "text"), rule))
    return links.unionByName(star_links).unionByName(rest)


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach; null id: null) of each row."""
    return _joined(docs, rule).select("doc_id", "n_shingles", "component_id")


def _joined(docs: DataFrame, rule: Rule) -> DataFrame:
    """What ``join`` gives, and the node of each row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = scratch.write(texts.mapInArrow(partial(_nodes, rule), "doc_id long, n_shingles long, node long"))
    nodes = every.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    links = node_links(texts.where(F.col("doc_id").isNotNull()), nodes, rule, scratch)
    roots = scratch.write(graph.components(links, scratch))
    known = scratch.write(nodes.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = known.select("node", "root").join(named, "root").select("node", "component_id")
    return every.join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def _with_node(rule: Rule, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in W.slices(batches):
        s = Sets(data, offsets, rule)
        yield batch.append_column(name, pa.array(s.nodes(), pa.int64(), mask=s.size == 0))


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 100, 80)) -> DataFrame:
    """The documents without those that are near copies of one with a smaller id; all columns stay.

    Rows that share an id are decided one by one.  Of rows with one id and one text one stays.  Rows
    without shingles or id stay."""
    gone = _joined(docs.select("doc_id", "text"), rule).where("doc_id <> component_id")
    if not _repeated(docs):
        return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    name = "node"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    noded = docs.mapInArrow(partial(_with_node, rule, name), StructType([*docs.schema.fields, StructField(name, LongType())]))
    gone = gone.select("doc_id", F.col("node").alias(name)).distinct()
    kept = noded.join(gone, ["doc_id", name], "left_anti").select(*docs.columns)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))


def _repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM t),
z AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS node FROM s),
u AS (SELECT z.node, any_value(z.n) AS n, any_value(s.g) AS g FROM z JOIN s USING (doc_id) WHERE z.node IS NOT NULL GROUP BY z.node),
e AS (SELECT node, n, unnest(g) AS x FROM u),
pr AS (SELECT a.node AS p, b.node AS q, any_value(a.n) AS np, any_value(b.n) AS nq, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.node, b.node),
l AS (SELECT p, q FROM pr WHERE 100 * k >= 90 * (np + nq - k)),
r AS (SELECT node AS a, node AS b FROM u UNION SELECT r.a, CASE WHEN l.p = r.b THEN l.q ELSE l.p END FROM r JOIN l ON r.b = l.p OR r.b = l.q),
c AS (SELECT r.a AS node, min(z.doc_id) AS component_id FROM r JOIN z ON z.node = r.b GROUP BY r.a)
SELECT z.doc_id, z.n::BIGINT AS n_shingles, coalesce(c.component_id, z.doc_id) AS component_id FROM z LEFT JOIN c USING (node)
"""
