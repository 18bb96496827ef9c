"""Genetic relationship matrices by blocks of samples; entries (i, j, value) with j <= i.

Features come in long form (iid, snp, x).  A sample's features are packed by chunks; samples are cut
into blocks, and a task adds up the products of two blocks chunk by chunk.  Memory of a task is bounded
by block and chunk, whatever the numbers of samples and features, and finished entries aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import qc
from kinfold.operators.rank import numbered
from kinfold.shared import Tables

#: Samples of a block and features of a chunk.
BLOCK, CHUNK = 512, 512
#: Blocks beyond whose number they grow, samples of the largest, and entries that a task forms at once.
BLOCKS, LARGEST, ENTRIES = 24, 4096, 1 << 18
#: Columns side by side in the entries of a block: j then repeats at short distances, which a table takes in little room.
STRIP = 256
#: Where entries come by value: how many are sorted at once, those of a block from which on that makes a
#: table smaller, and tasks at most.
SORTED, WORTH, TASKS = 1 << 20, 1 << 20, 2048
#: Samples of a group beyond which its features stand for its matrix, where they are fewer than half of that.
DENSE = 1024
KINDS = ("additive", "dominance_biological", "dominance_statistical")


def coded(geno: DataFrame, kind: str = "additive", code_type: int = 2, maf: float = qc.MAF, missing: float = qc.MISSING) -> tuple[DataFrame, float]:
    """(iid, snp, x) of the features that pass, and the scale by which the product is divided.

    code_type 1 divides by the summed variance, 2 scales each feature and divides by their number."""
    if kind not in KINDS or code_type not in (1, 2):
        raise ValueError(f"kind must be one of {KINDS}, code_type 1 or 2")
    frequent = qc.frequencies(geno).where(qc.grm_pass(maf, missing))
    g = geno.join(frequent, "snp")
    p, d = F.col("af"), F.col("d")
    h = 2e0 * p * (1e0 - p)
    if kind == "additive":
        x, var, unit = d - 2e0 * p, h, F.sqrt(h)
    elif kind == "dominance_biological":
        x, var, unit = F.when(d == 2, 0).otherwise(d) - h, h * (1e0 - h), F.sqrt(h * (1e0 - h))
    else:
        x, var, unit = F.when(d == 0, -2e0 * p * p).when(d == 1, h).otherwise(-2e0 * (1e0 - p) * (1e0 - p)), h * h, h
    x = F.when(d.isNull(), 0.0).otherwise(x)
    r = frequent.agg(F.sum(var).alias("s"), F.count("*").alias("n")).first()
    return g.select("iid", "snp", (x / unit if code_type == 2 else x).alias("x")), float((r.s if code_type == 1 else r.n) or 1.0)


def feature_coded(features: DataFrame, code_type: int = 2) -> tuple[DataFrame, float]:
    """The same for real-valued features (iid, snp, v): centred by the mean, variance by mean square."""
    m = features.groupBy("snp").agg(F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v") / F.count("*")).alias("var")).where("var > 0")
    r = m.agg(F.sum("var").alias("s"), F.count("*").alias("n")).first()
    x = F.coalesce(F.col("v") - F.col("mean"), F.lit(0.0))
    return features.join(m, "snp").select("iid", "snp", (x / F.sqrt("var") if code_type == 2 else x).alias("x")), float((r.s if code_type == 1 else r.n) or 1.0)


def product(coded_rows: DataFrame, scale: float = 1.0, block: int | None = None, chunk: int = CHUNK, *, above: float | None = None, within: DataFrame | None = None, only: tuple[int | None, int | None] = (None, None), by_value: bool = False) -> DataFrame:
    """Sum over features of x_i x_j / scale for all pairs j <= i; with ``above`` only the entries beyond it,
    with ``within`` (iid, group_id) only those of samples of one group, as (group_id, i, j, value), with
    ``only`` (first, stop) only the rows i in that range.  ``by_value`` gives the entries of large blocks in
    the order of their values: equal ones then stand together, and a table of them takes fewer bytes.  Such
    pairs of blocks are dealt to as many tasks, up to TASKS.

    A pair of blocks is one run of rows in a task, which emits finished entries.  Where there are fewer
    pairs of blocks than cores, chunks are dealt to several tasks and their sums meet in an aggregate.
    A block meets all others, so its features are shuffled once for each of them: blocks grow with the
    samples up to LARGEST, and without pairs that share no group, nothing is shuffled for them."""
    spark = coded_rows.sparkSession
    c = F.floor(F.col("snp") / chunk).cast("long")
    if within is None:
        placed = coded_rows.select("iid", F.lit(0).cast("long").alias("g"), F.col("iid").alias("pos"), "snp", "x")
    else:
        order = Tables(spark, "order").write(numbered(within.select("iid", F.col("group_id").cast("long").alias("g")), "g", "iid"))
        placed = coded_rows.join(_small(order), "iid").select("iid", "g", "pos", "snp", "x")
    least = block or BLOCK
    r = placed.groupBy(F.floor(F.col("pos") / least).cast("long").alias("b")).agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy("b").collect()
    columns = "i long, j long, value double" if within is None else "group_id long, i long, j long, value double"
    if not r:
        return spark.createDataFrame([], columns)
    wide = 1 if block else min(LARGEST // BLOCK, -(-len(r) // BLOCKS))
    block = least * wide
    span: dict[int, tuple[int, int]] = {}  # least and greatest group of a block of samples
    for x in r:
        lo, hi = span.get(x.b // wide, (x.lo, x.hi))
        span[x.b // wide] = min(lo, x.lo), max(hi, x.hi)
    first, stop = only
    left = {b for b in span if (first is None or (b + 1) * block > first) and (stop is None or b * block < stop)}
    pairs = sum(1 for bi in left for bj in span if bj <= bi and span[bj][1] >= span[bi][0])
    chunks = max(x.high for x in r) - min(x.low for x in r) + 1
    slices = min(chunks, -(-spark.sparkContext.defaultParallelism // max(pairs, 1)))
    cells = F.array_sort(F.collect_list(F.struct((F.col("snp") - F.col("c") * chunk).cast("int").alias("s"), F.col("x").cast("double").alias("x"))))
    packed = placed.withColumn("c", c).groupBy("iid", "g", "pos", "c").agg(cells.alias("cells")).withColumn("b", F.floor(F.col("pos") / block).cast("long"))
    blocks = F.array(*(F.struct(F.lit(b).cast("long").alias("b"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(b in left).alias("in")) for b, (lo, hi) in sorted(span.items())))
    own, mine = F.col("b"), F.lit(True) if left == set(span) else F.col("b").isin(sorted(left))
    below = F.filter(blocks, lambda o: mine & ((o["b"] == own) | ((o["b"] < own) & (o["hi"] == F.col("g")))))
    beyond = F.filter(blocks, lambda o: o["in"] & (o["b"] > own) & (o["lo"] == F.col("g")))
    places = F.concat(F.transform(below, lambda o: F.struct(own.alias("bi"), o["b"].alias("bj"), F.lit(0).alias("side"))), F.transform(beyond, lambda o: F.struct(o["b"].alias("bi"), own.alias("bj"), F.lit(1).alias("side"))))
    rows = packed.withColumn("p", F.explode(places)).select("p.bi", "p.bj", "p.side", (F.col("c") % slices).alias("slice"), "c", F.col("iid").cast("long").alias("iid"), "g", F.col("pos").cast("long").alias("pos"), F.col("cells.s").alias("s"), F.col("cells.x").alias("x"))
    whole = above if slices == 1 else None
    together = SORTED if by_value and slices == 1 and block * block >= WORTH else 0
    rows = rows.repartition(min(max(pairs, 1), TASKS), "bi", "bj") if together else rows.repartition("bi", "bj", "slice")
    rows = rows.sortWithinPartitions("bi", "bj", "slice", "c", "side")
    names, strip = [x.split()[0] for x in columns.split(", ")], STRIP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _multiplied(batches, scale, block, chunk, whole, names, together, strip)

    out = rows.mapInArrow(run, columns)
    if slices > 1:
        out = out.groupBy(*names[:-1]).agg(F.sum("value").alias("value"))
        out = out if above is None else out.where(F.col("value") > above)
    if first is not None:
        out = out.where(F.col("i") >= first)
    return out if stop is None else out.where(F.col("i") < stop)


def _small(samples: DataFrame) -> DataFrame:
    """A table of a few numbers for each sample, sent to all tasks: entries of pairs aren't shuffled for it."""
    return F.broadcast(samples)


def _multiplied(batches: Iterator[pa.RecordBatch], scale: float, block: int, chunk: int, above: float | None, columns: list[str], together: int = 0, strip: int = STRIP) -> Iterator[pa.RecordBatch]:
    """Entries of each pair of blocks from rows in the order of (bi, bj, slice, c, side), some rows at a time;
    with ``together`` by value, about so many sorted at once, else in strips of columns."""
    key = at = None
    total = np.zeros((block, block))
    ids, group = np.zeros((2, block), np.int64), np.zeros((2, block), np.int64)
    seen = np.zeros((2, block), bool)
    sides: list[np.ndarray | None] = [None, None]
    step = max(1, ENTRIES // block)
    wide = block if together else min(block, strip)

    def add() -> None:
        a, b = sides
        if key[0] == key[1]:
            b = a
        if a is not None and b is not None:
            for lo in range(0, block, step):
                total[lo : lo + step] += a[lo : lo + step] @ b.T
        sides[:] = [None, None]

    def finished() -> Iterator[pa.RecordBatch]:
        other = 0 if key[0] == key[1] else 1
        rows = block if together else max(1, ENTRIES // wide)
        for lo, left in ((lo, left) for lo in range(0, block, rows) for left in range(0, block, wide)):
            hi, right = min(lo + rows, block), min(left + wide, block)
            keep = seen[0][lo:hi, None] & seen[other][None, left:right]
            keep &= group[0][lo:hi, None] == group[other][None, left:right]
            if not other:
                keep &= np.arange(lo, hi)[:, None] >= np.arange(left, right)[None, :]
            value = total[lo:hi, left:right]
            value /= scale  # in place: the sums are done
            if above is not None:
                keep &= value > above
            value = value.ravel()
            for places in _by_value(value, keep.ravel(), together) if together else [np.flatnonzero(keep)]:
                for k in range(0, len(places), ENTRIES):
                    i, j = np.divmod(some := places[k : k + ENTRIES], right - left)
                    i, j = lo + i, left + j
                    parts = {"group_id": group[0][i], "i": ids[0][i], "j": ids[other][j], "value": value[some]}
                    yield pa.RecordBatch.from_arrays([pa.array(parts[c]) for c in columns], columns)

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("x")
        off, col, x = np.asarray(cells.offsets), np.asarray(batch.column("s").values), np.asarray(cells.values)
        names = np.column_stack([np.asarray(batch.column(k)) for k in ("bi", "bj", "slice", "c", "side")])
        iid, g, pos = (np.asarray(batch.column(k)) for k in ("iid", "g", "pos"))
        first = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
        for lo, hi in zip(first, np.append(first[1:], len(iid)), strict=True):
            bi, bj, part, c, side = (int(v) for v in names[lo])
            if at is not None and (at != c or key != (bi, bj, part)):
                add()
            if key is not None and key != (bi, bj, part):
                yield from finished()
                total[:], seen[:] = 0, False
            key, at = (bi, bj, part), c
            if sides[side] is None:
                sides[side] = np.zeros((block, chunk))
            place = pos[lo:hi] - block * (bj if side else bi)
            seen[side][place], ids[side][place], group[side][place] = True, iid[lo:hi], g[lo:hi]
            sides[side][np.repeat(place, np.diff(off[lo : hi + 1])), col[off[lo] : off[hi]]] = x[off[lo] : off[hi]]
    if key is not None:
        add()
        yield from finished()


def _by_value(value: np.ndarray, keep: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the values to keep, from the least value on (NaN last).  Cuts of a few values give ranges of
    about ``most``; of a range that holds more than twice that, each part is in order for itself."""
    few = value[:: max(1, len(value) // 4096)]
    few = np.sort(few[~np.isnan(few)])
    n = max(1, min(len(value) // most, len(few)))
    cuts = [-np.inf, *few[np.arange(1, n) * len(few) // n]]
    for at, low in enumerate(cuts):
        found: list[np.ndarray] = []
        for lo in range(0, len(value), most):
            v = value[lo : lo + most]
            inside = (v >= low) & (v < cuts[at + 1]) if at + 1 < len(cuts) else ~(v < low)
            found.append(np.flatnonzero(inside & keep[lo : lo + most]) + lo)
            if lo + most >= len(value) or sum(map(len, found)) > 2 * most:
                places = np.concatenate(found)
                found = []
                yield places[np.argsort(value[places])]


def relationship(geno: DataFrame, kind: str = "additive", code_type: int = 2, *, by_value: bool = False, **limits) -> DataFrame:
    return product(*coded(geno, kind, code_type, **limits), by_value=by_value)


def relationship_sql_form(coded_rows: DataFrame, scale: float) -> DataFrame:
    """The same as a self-join on the feature: for few samples, and to check the block form."""
    a, b = coded_rows.alias("a"), coded_rows.alias("b")
    pairs = a.join(b, (F.col("a.snp") == F.col("b.snp")) & (F.col("b.iid") <= F.col("a.iid")))
    return pairs.groupBy(F.col("a.iid").alias("i"), F.col("b.iid").alias("j")).agg((F.sum(F.col("a.x") * F.col("b.x")) / F.lit(scale)).alias("value"))


def epistatic(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elementwise product of two matrices over the same ids; of one with itself without a join."""
    if a is b:
        return a.select("i", "j", (F.col("value") * F.col("value")).alias("value"))
    return a.join(b.select("i", "j", F.col("value").alias("_v")), ["i", "j"]).select("i", "j", (F.col("value") * F.col("_v")).alias("value"))


@dataclass(frozen=True)
class Factors:
    """A kernel by its features (iid, snp, x): x x' / scale, plus ``ridge`` on the diagonal."""

    rows: DataFrame
    scale: float
    ridge: float = 0.0

    def within(self, groups: DataFrame) -> DataFrame:
        """(group_id, i, j, value) of entries whose samples share a group."""
        out = product(self.rows, self.scale, within=groups)
        return out.withColumn("value", F.when(F.col("i") == F.col("j"), F.col("value") + self.ridge).otherwise(F.col("value"))) if self.ridge else out

    def features(self) -> list[int]:
        return [r.snp for r in self.rows.select("snp").distinct().orderBy("snp").collect()]

    def vectors(self, features: list[int]) -> DataFrame:
        """(iid, u): x / sqrt(scale) of a sample over the features, 0 where it has none."""
        at, unit = np.array(features, np.int64), np.sqrt(self.scale)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                off, snp, x = np.asarray(batch.column("s").offsets), np.asarray(batch.column("s").values), np.asarray(batch.column("x").values)
                u = np.zeros((batch.num_rows, len(at)))
                u[np.repeat(np.arange(len(u)), np.diff(off)), np.searchsorted(at, snp)] = x / unit
                yield pa.RecordBatch.from_arrays([batch.column("iid"), pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * len(at)), pa.array(u.ravel()))], ["iid", "u"])

        cells = self.rows.groupBy(F.col("iid").cast("long").alias("iid")).agg(F.collect_list(F.struct(F.col("snp").cast("long").alias("s"), F.col("x").cast("double").alias("x"))).alias("z"))
        return cells.select("iid", F.col("z.s").alias("s"), F.col("z.x").alias("x")).mapInArrow(run, "iid long, u array<double>")


def large_groups(groups: DataFrame, features: int) -> list[int]:
    """Groups (iid, group_id) of more than DENSE samples, whose features are fewer, so that they are
    treated by their features and not as a matrix."""
    if features > DENSE // 2:
        return []
    return sorted(r.group_id for r in groups.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).collect())


def grams(rows: DataFrame, width: int, made: Callable[[pd.DataFrame], list[np.ndarray]], end: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """By group_id, ``end`` of the sums over its rows (group_id, ...) of the ``width`` by ``width`` matrices that
    ``made`` forms of some of them, flattened; tasks add up what they hold, and these few sums meet by group."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, some in pdf.groupby("group_id"):
                for lo in range(0, len(some), DENSE):
                    m = np.stack(made(some.iloc[lo : lo + DENSE]))
                    sums[g] = sums[g] + m if g in sums else m
        for g, m in sums.items():
            yield pd.DataFrame({"group_id": [g], "m": [m.tobytes()]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.frombuffer(x) for x in pdf.m).reshape(-1, width, width)
        return pd.DataFrame({"group_id": pdf.group_id[:1], "m": [np.ascontiguousarray(end(m), float).tobytes()]})

    kind = "group_id long, m binary"
    got = rows.mapInPandas(part, kind).groupBy("group_id").applyInPandas(whole, kind).collect()
    return {r.group_id: np.frombuffer(r.m) for r in sorted(got, key=lambda r: r.group_id)}


def dense(grm: DataFrame, limit: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the full matrix on the driver, for at most ``limit`` samples (checked)."""
    ids = np.array([r.i for r in grm.select("i").distinct().orderBy("i").limit(limit + 1).collect()])
    if len(ids) > limit:
        raise ValueError(f"more than {limit} samples; use blocks")
    rows = grm.toArrow()
    i, j = (np.searchsorted(ids, np.asarray(rows.column(k).combine_chunks())) for k in ("i", "j"))
    out = np.zeros((len(ids), len(ids)))
    out[i, j] = out[j, i] = np.asarray(rows.column("value").combine_chunks())
    return ids, out


def pca(grm: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, eigenvalues in descending order, eigenvectors in columns."""
    ids, k = dense(grm)
    values, vectors = np.linalg.eigh(k)
    return ids, values[::-1], vectors[:, ::-1]


def eigenvalues(kernel: Factors) -> DataFrame:
    """(k, eigenvalue) in descending order, one for each sample.  They are those of the product over
    the samples of the features, and 0 for the rest, so that of samples and features only the fewer
    make a matrix on the driver."""
    rows, spark = kernel.rows, kernel.rows.sparkSession
    n, m = rows.select("iid").distinct().count(), rows.select("snp").distinct().count()
    if n > m:
        rows = rows.select(F.col("snp").alias("iid"), F.col("iid").alias("snp"), "x")
    _, values, _ = pca(product(rows, kernel.scale))
    some = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values[:n])], "k long, eigenvalue double")
    every = spark.range(n).select(F.col("id").alias("k")).join(F.broadcast(some), "k", "left")
    return every.select(F.col("k").cast("int").alias("k"), (F.coalesce("eigenvalue", F.lit(0.0)) + kernel.ridge).alias("eigenvalue"))


def inverse_by_features(kernel: Factors, groups: DataFrame) -> DataFrame:
    """Inverse entries within groups (iid, group_id) of a kernel with a ridge.  A large group's inverse is
    (I - U (ridge I + U'U)^-1 U') / ridge, again a product of features; the others are inverted one by one."""
    spark, ridge, names = groups.sparkSession, kernel.ridge, kernel.features()
    groups = Tables(spark, "groups").write(groups.select("iid", "group_id"))
    large, m = large_groups(groups, len(names)), len(names)
    one = F.col("group_id").isin(large)
    out = _inverted(kernel.within(groups.where(~one)))
    if not large:
        return out
    rows = Tables(spark, "vectors").write(kernel.vectors(names).join(_small(groups.where(one)), "iid"))
    sums = grams(rows, m, lambda pdf: [(u := np.stack(pdf.u.to_numpy())).T @ u], lambda s: np.linalg.cholesky(np.linalg.inv(ridge * np.eye(m) + s[0])))
    shared = spark.sparkContext.broadcast({g: s.reshape(m, m) for g, s in sums.items()})

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, some in pdf.groupby("group_id"):
                yield pd.DataFrame({"iid": some.iid, "u": list(np.stack(some.u.to_numpy()) @ shared.value[g])})

    long = rows.mapInPandas(turned, "iid long, u array<double>").select("iid", F.posexplode("u").alias("snp", "x"))
    big = product(long, -ridge, within=groups.where(one)).select("i", "j", (F.col("value") + F.when(F.col("i") == F.col("j"), 1 / ridge).otherwise(0.0)).alias("value"))
    return out.unionByName(big)


def inverse(grm: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Inverse entries; with groups (iid, group_id) block by block on the executors."""
    if groups is None:
        ids, k = dense(grm)
        a, b = np.tril_indices(len(ids))
        return grm.sparkSession.createDataFrame(pd.DataFrame({"i": ids[a], "j": ids[b], "value": np.linalg.inv(k)[a, b]}))
    return _inverted(within_groups(grm, groups))


def _inverted(within: DataFrame) -> DataFrame:
    """Inverses of groups, each as a matrix in a task, from their entries (group_id, i, j, value)."""

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf.i)
        k = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, pdf.i), np.searchsorted(ids, pdf.j)
        k[i, j] = k[j, i] = pdf.value
        a, b = np.tril_indices(len(ids))
        return pd.DataFrame({"i": ids[a], "j": ids[b], "value": np.linalg.inv(k)[a, b]})

    return within.groupBy("group_id").applyInPandas(invert, "i long, j long, value double")


def within_groups(grm: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, i, j, value) of entries whose samples share a group."""
    a, b = (_small(groups.select(F.col("iid").alias(k), F.col("group_id").alias(f"g{k}"))) for k in ("i", "j"))
    return grm.join(a, "i").join(b, "j").where("gi = gj").select(F.col("gi").alias("group_id"), "i", "j", "value")


def environment_kernel(within: DataFrame, env: DataFrame, columns: list[str]) -> DataFrame:
    """K o (E E' / q) over the entries of K; env: iid and its columns."""
    e = F.array(*columns)
    a = within.join(_small(env.select(F.col("iid").alias("i"), e.alias("ei"))), "i").join(_small(env.select(F.col("iid").alias("j"), e.alias("ej"))), "j")
    dot: Column = F.aggregate(F.zip_with("ei", "ej", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.select("i", "j", (F.col("value") * dot / len(columns)).alias("value"))
