import math
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold import sinks
from kinfold.functions import ranges, special, text
from kinfold.operators import graph, grm, ld, qc, table
from kinfold.operators.rank import numbered
from kinfold.plans import association, lmm, mom, scan, simulate, susie
from kinfold.plans.queries import ORACLE, QUERIES, entry
from kinfold.sources import bed
from kinfold.sources import grm as grm_io
from kinfold.streaming import passing_features


def test_tails():
    assert special.chi2_1_tail(np.array([3.84, 0.0, np.nan]))[0] == pytest.approx(0.0500435, rel=1e-4)
    for x in (0.5, 3.0, 12.0):
        assert special.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert special.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
    for q, tol in ((2, 0.02), (4, 0.01), (40, 0.001)):
        for ratio in (0.5, 1.2, 2, 4):
            assert special.mixture_tail(3 * q * ratio, [3.0] * q) == pytest.approx(special.chi2_tail(q * ratio, q), rel=tol)
    assert special.mixture_tail(-1, [1, 2]) == 1 and special.mixture_tail(1, []) == 0 and special.mixture_tail(0, []) == 1 and math.isnan(special.mixture_tail(float("nan"), [1]))
    x = np.array([0.1, 1.0, 5.0, 50.0, 0.0, np.nan])
    assert special.mixture_tails(x, [0.0]).tolist()[:5] == [0, 0, 0, 0, 1]
    assert np.allclose(special.mixture_tails(x, [1, 0.5, 0.2]), [special.mixture_tail(v, [1, 0.5, 0.2]) for v in x], rtol=1e-9, equal_nan=True)


def test_acat(spark):
    assert special.acat(np.array([0.03, 0.03, 0.03])) == pytest.approx(0.03)
    assert special.acat(np.array([1e-300, 0.5])) == pytest.approx(2e-300, rel=1e-6)
    assert np.isnan(special.acat(np.array([np.nan, np.nan])))
    got = spark.createDataFrame([([0.2, 0.7, 1e-20],)], "p array<double>").select(special.acat_column(F.col("p"))).first()[0]
    assert got == pytest.approx(float(special.acat(np.array([0.2, 0.7, 1e-20]))), rel=1e-9)


@given(st.integers(1, 400), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_triangle(n, parts):
    if parts > n:
        with pytest.raises(ValueError):
            ranges.triangle_bounds(n, parts)
        return
    b = ranges.triangle_bounds(n, parts)
    assert b[0] == 0 and b[-1] == n and all(x < y for x, y in zip(b, b[1:], strict=False))


def test_ranges():
    assert ranges.expand(["a", "c:e"], list("abcdef")) == ["a", "c", "d", "e"]
    for bad in (["c:a"], ["x"], ["a", "a:b"]):
        with pytest.raises((ValueError, KeyError)):
            ranges.expand(bad, list("abc"))
    with pytest.raises(ValueError):
        ranges.Roles("y", ["e1"], [], ["e1"]).resolve(["y", "e1"])
    parts = [ranges.split_task(23, 5, k) for k in range(1, 6)]
    assert parts[0][0] == 0 and parts[-1][1] == 23 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert ranges.chunks(0, 3, 20) == [(0, 3)] and ranges.feature_range(["x", "y", "z"], "x", "y") == (0, 2)


def test_text(spark):
    rows = spark.createDataFrame([(" a,b;\tc # rest",), ("",), (None,)], "v string").select(text.fields(text.normalise(F.col("v"))).alias("f")).collect()
    assert rows[0].f == ["a", "b", "c"] and rows[1].f == [] and rows[2].f is None
    df = spark.createDataFrame([("1.5",), ("1e3",)], "v string")
    assert [r[0] for r in df.select(text.strict_double(F.col("v"))).collect()] == [1.5, 1000.0]
    for bad in ("1x", "nan", "inf"):
        with pytest.raises(Exception, match="not a finite"):
            spark.createDataFrame([(bad,)], "v string").select(text.strict_double(F.col("v"))).collect()


@pytest.mark.parametrize("n", range(1, 10))
def test_packed_genotypes(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    d = rng.integers(-1, 3, (7, n)).astype(np.int8)
    prefix = str(tmp_path / "g")
    bed.write(f"{prefix}.bed", d)
    (tmp_path / "g.fam").write_text("".join(f"f s{i} 0 0 1 -9\n" for i in range(n)))
    (tmp_path / "g.bim").write_text("".join(f"1 rs{i} 0 {i} A C\n" for i in range(7)))
    got = bed.genotypes(spark, prefix, parts=3).orderBy("snp_idx").collect()
    assert [[-1 if x is None else x for x in r.dosage] for r in got] == d.tolist()
    part = bed.genotypes(spark, prefix, start=2, end=5, parts=2)
    assert sorted(r.snp_idx for r in part.collect()) == [2, 3, 4]
    assert [r.snp_idx for r in bed.at_index(bed.bim(spark, f"{prefix}.bim"), [4, 1, 4]).collect()] == [4, 1, 4]
    with open(f"{prefix}.bed", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="bytes"):
        bed.genotypes(spark, prefix).collect()


def test_text_sources(spark, tmp_path):
    (tmp_path / "m").write_text("1 NA 3\n2 2 2\n")
    rows = bed.feature_imputed(bed.feature_matrix(spark, str(tmp_path / "m"))).orderBy("feat_idx").collect()
    assert rows[0]["values"] == [1, 2, 3] and rows[0].nobs == 2
    (tmp_path / "p").write_text("iid,y\tcls\n\na 1 x # comment\nb,NA;y\n")
    df = bed.phenotypes(spark, str(tmp_path / "p"))
    assert df.columns == ["iid", "y", "cls", "row_id"] and df.count() == 2
    assert table.drop_missing(df, ["y"]).count() == 1
    with pytest.raises(table.EmptyTable):
        table.read_and_filter(df, [df.select("iid").where("iid = 'zz'")], ["y"])
    (tmp_path / "bad").write_text("iid y\na 1 2\n")
    with pytest.raises(Exception, match="fields"):
        bed.phenotypes(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("n", [1, 2, 5])
def test_matrix_files(spark, tmp_path, n):
    cells = [(i, j, float(i * 10 + j)) for i in range(n) for j in range(i + 1)]
    g = spark.createDataFrame(cells, "i long, j long, value double")
    grm_io.write_dense(g, str(tmp_path / "d"), n, 0.5)
    back = {(r.i, r.j): r.value for r in grm_io.read_dense(spark, str(tmp_path / "d")).collect()}
    assert back == {(i, j): v + 0.5 * (i == j) for i, j, v in cells}
    grm_io.write_sparse(g, str(tmp_path / "s"))
    assert sorted(map(tuple, grm_io.read_sparse(spark, str(tmp_path / "s")).collect())) == sorted(cells)
    names = spark.createDataFrame([(i, f"s{i}") for i in range(n)], "grm_index long, iid string")
    assert grm_io.reformat(g, 0).count() == n and grm_io.reformat(g, 1).count() == len(cells) and grm_io.reformat(g, 2, names).first().iid1 is not None
    place = spark.createDataFrame([(i, n - 1 - i) for i in range(n)], "old long, new long")
    assert {(r.i, r.j) for r in grm_io.subset(g, place).collect()} == {(i, j) for i, j, _ in cells}


def _geno(spark, n=12, m=9, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, j, None if rng.random() < 0.03 else int(rng.integers(0, 3))) for i in range(n) for j in range(m)]
    return spark.createDataFrame(rows, "iid long, snp long, d int")


@pytest.mark.parametrize("kind", grm.KINDS)
@pytest.mark.parametrize("code", [1, 2])
def test_relationship_forms_agree(spark, kind, code):
    x, scale = grm.coded(_geno(spark), kind, code, missing=0.5)
    a = {(r.i, r.j): r.value for r in grm.product(x, scale, block=5, chunk=4).collect()}
    b = {(r.i, r.j): r.value for r in grm.relationship_sql_form(x, scale).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-10) for k in a)


def test_product_of_uneven_rows(spark):
    """Blocks and chunks with holes, several slices, one feature a chunk, and entries beyond a bound."""
    rng = np.random.default_rng(3)
    cells = [(int(i), int(j), float(rng.normal())) for i in (0, 1, 4, 5, 11, 23, 24) for j in range(40) if (i + j) % 3]
    x = spark.createDataFrame(cells, "iid long, snp long, x double")
    want = {(r.i, r.j): r.value for r in grm.relationship_sql_form(x, 2.0).collect()}
    for block, chunk in ((5, 7), (64, 1), (64, 64), (1, 64)):
        got = {(r.i, r.j): r.value for r in grm.product(x, 2.0, block, chunk).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)
        some = {(r.i, r.j) for r in grm.product(x, 2.0, block, chunk, above=0.5).collect()}
        assert some == {k for k, v in want.items() if v > 0.5} and some
    assert grm.product(x.where("false")).count() == 0


def test_lead_features_equal_one_by_one(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 6))
    z = base[:, rng.integers(0, 6, 25)] + 0.7 * rng.normal(size=(30, 25))
    z[:, 7] = 0
    z -= z.mean(0)
    p = [None if j == 9 else float(rng.integers(1, 9)) / 100 for j in range(25)]
    x = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(30) for j in range(25)], "iid long, snp long, x double")
    links = ld.correlated(x, 0.3, block=4, chunk=11)
    with np.errstate(invalid="ignore"):
        near = np.nan_to_num(np.corrcoef(z.T) ** 2) >= 0.3
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a in range(25) for b in range(a) if near[a, b]}
    want = []
    for j in sorted((j for j in range(25) if p[j] is not None and p[j] < 0.07), key=lambda j: (p[j], j)):
        if not near[j, want].any():
            want.append(j)
    features = spark.createDataFrame(list(enumerate(p)), "snp long, p double")
    assert sorted(r.snp for r in ld.leads(features, links, cutoff=0.07).collect()) == sorted(want) and len(want) < 17
    assert ld.leads(features.where("false"), links).count() == 0


def test_graph(spark):
    links = spark.createDataFrame([(3, 1), (7, 3), (5, 4)], "a long, b long")
    nodes = spark.range(9).select(F.col("id").alias("iid"))
    got = {r.iid: (r.group_id, r.group_size) for r in graph.groups(nodes, links).collect()}
    assert got[1] == got[3] == got[7] == (2, 3) and got[4] == got[5] == (4, 2) and got[0] == (1, 1)
    assert graph.prune(links) == [3, 4]
    placed = graph.layout(graph.groups(nodes, links))
    assert placed.where("block = 0").count() == 4 and placed.select("block").distinct().count() == 3


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    """Long chains in random order, a star, loose nodes, repeated links and loops."""
    rng = np.random.default_rng(seed)
    n = 200
    order = rng.permutation(n)
    links = [*zip(order[:80], order[1:81], strict=True), *((order[100], x) for x in order[101:150]), *(tuple(rng.choice(order[150:190], 2)) for _ in range(25)), (order[3], order[3]), (order[0], order[1])]
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(int(a)), top(int(b))))
        root[y] = x
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long")
    got = {r.iid: r.root for r in graph.components(spark.range(n).select(F.col("id").alias("iid")), edges).collect()}
    assert got == {x: top(x) for x in range(n)}


def _dense_reml(y, x, ks, var):
    v = sum(s * k for s, k in zip(var, ks, strict=True))
    vi = np.linalg.inv(v)
    p = vi - vi @ x @ np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
    score = np.array([-0.5 * (np.trace(p @ k) - y @ p @ k @ p @ y) for k in ks])
    info = np.array([[0.5 * y @ p @ a @ p @ b @ p @ y for b in ks] for a in ks])
    logl = -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ vi @ x)[1] + y @ p @ y)
    return score, info, logl


def test_reml_statistics_match_dense_formulas():
    rng = np.random.default_rng(4)
    sizes = [1] * 6 + [4, 4, 7]
    n = sum(sizes)
    y, x, e = rng.standard_normal(n), np.column_stack([np.ones(n), rng.standard_normal(n)]), rng.standard_normal((n, 3))
    var, at, total = np.array([0.5, 0.3, 0.2, 0.9]), 0, 0
    full = [np.zeros((n, n)) for _ in range(4)]
    for s in sizes:
        a = rng.standard_normal((s, s + 2))
        k = a @ a.T / (s + 2)
        rows = slice(at, at + s)
        ks = lmm.kernels(k, e[rows], True)
        for f, b in zip(full, ks, strict=True):
            f[rows, rows] = b
        total = total + lmm.block_statistics(np.column_stack([y[rows], x[rows]]), ks, var)
        at += s
    score, info, logl, diag = lmm.solve(total, 3, 4)
    s2, i2, l2 = _dense_reml(y, x, full, var)
    assert np.allclose(score, s2) and np.allclose(info, i2) and logl == pytest.approx(l2)
    assert np.allclose(diag, [np.trace(k) / n for k in full])


def test_reml_fit_and_rotation(spark):
    rng = np.random.default_rng(1)
    rows = []
    for b in range(60):
        a = rng.standard_normal((4, 8))
        k = a @ a.T / 8
        y = np.linalg.cholesky(0.6 * k + 0.4 * np.eye(4)) @ rng.standard_normal(4)
        rows.append(([4 * b + i for i in range(4)], np.column_stack([y, np.ones(4)]).ravel().tolist(), k.ravel().tolist(), []))
    blocks = spark.createDataFrame(rows, "ids array<long>, w array<double>, k array<double>, e array<double>")
    fit = lmm.fit(blocks, ["G", "residual"])
    assert fit.converged and (fit.var > 0).all() and np.abs(fit.var.sum() - 1) < 0.35
    slow = lmm.fit(blocks, ["G", "residual"], bound=False)
    assert np.allclose(fit.var, slow.var, rtol=1e-3)
    h = fit.heritability()
    assert h[-1][0] == "total" and h[0][1] == pytest.approx(h[-1][1]) and sum(x[1] for x in h[:2]) == pytest.approx(1)
    r = lmm.rotate(blocks).first()
    assert len(r.lam) == 4 and np.isclose(np.sum(np.square(r.w)), np.sum(np.square(rows[0][1])))


def _dense_fit(y, x, ks, start, bound=1e-9):
    """Maximises the restricted likelihood on all samples by coordinate-wise golden sections."""
    var = np.array(start, float)
    ll = lambda v: _dense_reml(y, x, ks, v)[2]
    for _ in range(60):
        before = var.copy()
        for i in range(len(var)):
            lo, hi, g = math.log(bound), math.log(20.0), (math.sqrt(5) - 1) / 2
            f = lambda t: ll(np.where(np.arange(len(var)) == i, math.exp(t), var))  # noqa: B023, E731
            grid = np.linspace(lo, hi, 25)
            k = int(np.argmax([f(t) for t in grid]))
            lo, hi = grid[max(0, k - 1)], grid[min(24, k + 1)]
            for _ in range(30):
                a, c = hi - g * (hi - lo), lo + g * (hi - lo)
                lo, hi = (lo, c) if f(a) > f(c) else (a, hi)
            var[i] = math.exp((lo + hi) / 2)
        if np.abs(var - before).max() < 1e-7:
            break
    return var, ll(var)


def _family(seed=5, n_single=40, groups=(2, 3, 5, 4, 4)):
    """Kernel blocks, environments and a trait of related and unrelated samples."""
    rng = np.random.default_rng(seed)
    sizes = [1] * n_single + list(groups) * 4
    n = sum(sizes)
    k, at, group = np.zeros((n, n)), 0, np.zeros(n, int)
    for g, s in enumerate(sizes):
        a = rng.standard_normal((s, s + 3))
        k[at : at + s, at : at + s] = a @ a.T / (s + 3) + 0.2 * np.eye(s)
        group[at : at + s] = g
        at += s
    e = rng.standard_normal((n, 2))
    y = np.linalg.cholesky(0.7 * k + 0.3 * np.eye(n)) @ rng.standard_normal(n) + 0.5 * e[:, 0]
    return k, group, np.bincount(group)[group], e, y - y.mean()


def _frames(spark, k, group, size, e, y):
    n = len(y)
    s = spark.createDataFrame([(i, float(y[i]), *map(float, e[i])) for i in range(n)], "iid long, y double, e1 double, e2 double")
    kernel = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(n) for j in range(i + 1) if group[i] == group[j]], "i long, j long, value double")
    groups = spark.createDataFrame([(i, int(group[i]), int(size[i])) for i in range(n)], "iid long, group_id long, group_size long")
    return s, kernel, groups


def test_models_equal_dense_fits(spark):
    """Components, null model and scans of related and unrelated samples against whole matrices."""
    k, group, size, e, y = family = _family()
    n, one = len(y), np.ones((len(y), 1))
    s, kernel, groups = _frames(spark, *family)
    rng = np.random.default_rng(2)
    g = rng.binomial(2, 0.3, (12, n)).astype(float)
    features = spark.createDataFrame([(j, d.tolist()) for j, d in enumerate(g)], "snp_idx long, dosage array<double>")
    x = g - g.mean(1, keepdims=True)

    m = association.fitted(s, kernel, groups, "y", [F.lit(1.0)], ["e1", "e2"], gxe=False, jitter=0.0)
    dense, logl = _dense_fit(y, one, [k, np.eye(n)], [1, 1])
    assert m.fit.converged and m.fit.logl == pytest.approx(logl, abs=1e-5) and np.allclose(m.fit.var, dense, atol=2e-3)
    vi = np.linalg.inv(m.fit.var[0] * k + m.fit.var[1] * np.eye(n))
    p = vi - vi @ one @ np.linalg.inv(one.T @ vi @ one) @ one.T @ vi
    out, gamma, panel = association.main_scan(features, m)
    ratio = np.array([a @ p @ a / (a @ a) for a in x])
    assert gamma == pytest.approx(ratio.mean()) and np.allclose([r.gamma for r in panel.orderBy("snp_idx").collect()], ratio)
    assert np.allclose([r.beta for r in out.orderBy("snp_idx").collect()], [a @ p @ y / (ratio.mean() * (a @ a)) for a in x])

    prepared, fixed = association.gxe_prepare(s, "y", [F.lit(1.0)], ["e1", "e2"])
    m = association.fitted(prepared, kernel, groups, "y", fixed, ["e1", "e2"], gxe=True, jitter=0.0)
    z = (e - e.mean(0)) / e.std(0)
    w = np.column_stack([one, z])
    res = y - w @ np.linalg.lstsq(w, y, rcond=None)[0]
    assert np.allclose(m.y, res) and np.allclose(m.e, z)
    ks = lmm.kernels(k, z, True)
    dense, logl = _dense_fit(res, one, ks, [0.5, 0.1, 0.1, 0.5])
    assert m.fit.converged and m.fit.logl >= logl - 1e-4
    score, _, _ = _dense_reml(res, one, ks, m.fit.var)
    for name, v, d in zip(m.fit.names, m.fit.var, score, strict=True):
        assert (name in m.fit.held and d <= 0 and v < 1e-6) or abs(d) < 1e-2, name
    vi = np.linalg.inv(sum(v * q for v, q in zip(m.fit.var, ks, strict=True)))
    forms = {r.snp_idx: r for r in scan.quadratic(features, m.null, m.e).collect()}
    for j, a in enumerate(x):
        both = np.column_stack([a, a[:, None] * z])
        assert np.allclose(np.reshape(forms[j].m, (3, 3)), both.T @ vi @ both) and np.allclose(forms[j].vy, both.T @ vi @ res)
    out, cal = association.gxe_scan(features, m, p_approx=1.1, exact=1.1)  # every feature with its exact covariance
    for r in out.collect():
        both = np.column_stack([x[r.snp_idx], x[r.snp_idx] * z[:, 1]])
        c = np.linalg.inv(both.T @ vi @ both)
        assert r.beta_2 == pytest.approx((c @ both.T @ vi @ res)[1]) and r.se_2 == pytest.approx(math.sqrt(c[1, 1]))
    assert dict(cal.rows())["main"] == pytest.approx(np.mean([a @ vi @ a / (a @ a) for a in x]))


def test_dependent_environments_are_an_error(spark):
    s = spark.createDataFrame([(i, float(i % 7), float(i % 3), 2.0 * (i % 3), float(i)) for i in range(30)], "iid long, y double, e1 double, e2 double, e3 double")
    with pytest.raises(table.RankDeficient):
        association.gxe_prepare(s, "y", [F.lit(1.0)], ["e1", "e2"])
    for correct, left in ((0, 3), (1, 3), (2, 1)):
        assert len(association.gxe_prepare(s, "y", [F.lit(1.0)], ["e1", "e3"], correct=correct)[1]) == left
    normal, _ = association.gxe_prepare(s, "y", [F.lit(1.0)], ["e1", "e3"], normal=True)
    z = sorted(r.y for r in normal.collect())
    assert z[0] == pytest.approx(-z[-1]) and 1.5 < z[-1] < 2.5
    rows = mom.adjusted(s, "y", [], [], ["e1"])
    assert abs(rows.agg(F.sum(F.col("y") * F.col("e1"))).first()[0]) < 1e-9


def _simulated(spark, **more):
    s = simulate.trait(**more)
    features = spark.createDataFrame([(j, d.tolist()) for j, d in enumerate(s["dosage"])], "snp_idx long, dosage array<double>")
    return s, features, scan.Null(s["y"] - s["y"].mean(), np.ones((len(s["y"]), 1)), np.ones(len(s["y"])))


def test_scan_finds_the_focused_feature_whatever_the_partitions(spark):
    s, features, null = _simulated(spark)
    panel = scan.panel_sample(features, 150)
    cal = scan.gxe_calibration(panel, null, s["env"])
    one = scan.scan_gxe(features.coalesce(1), null, s["env"], cal).orderBy("snp_idx").toPandas()
    many = scan.scan_gxe(features.repartition(5), null, s["env"], cal).orderBy("snp_idx").toPandas()
    pd.testing.assert_frame_equal(one, many)
    assert one.p_gxe.idxmin() == 0 and one.p_gxe[0] < 1e-6
    parts = [scan.scan_main(features.where((F.col("snp_idx") >= a) & (F.col("snp_idx") < z)), null, 1.0).count() for a, z in (ranges.split_task(200, 3, k) for k in (1, 2, 3))]
    assert sum(parts) == 200
    joint = scan.score_joint(features, null, s["env"], panel).toPandas()
    assert joint.p.idxmin() == 0


def test_exact_refit_matches_dense(spark):
    s, features, null = _simulated(spark, n=120, m=20)
    cal = scan.gxe_calibration(features, null, s["env"])
    r = scan.scan_gxe(features.where("snp_idx = 0"), null, s["env"], cal, p_approx=1.1, exact=1.1).first()
    x = s["dosage"][0] - s["dosage"][0].mean()
    w = np.column_stack([x, x * s["env"][:, 0]])
    c = np.linalg.inv(w.T @ w)
    assert r.beta_1 == pytest.approx((c @ w.T @ null.y)[1]) and r.se_1 == pytest.approx(np.sqrt(c[1, 1]))


def test_panel_too_small(spark):
    rows = spark.createDataFrame([(0, [0.0] * 5), (1, [0.0] * 5)], "snp_idx long, dosage array<double>")
    with pytest.raises(scan.PanelTooSmall):
        scan.main_gamma(rows, scan.Null(np.ones(5), np.ones((5, 1)), np.ones(5)))


def test_result_files(spark, tmp_path):
    """Every sink, read back as text."""
    p = str(tmp_path / "out")
    read = lambda suffix: (tmp_path / f"out{suffix}").read_text().splitlines()
    cells = [(i, j, float(i * 10 + j)) for i in range(12) for j in range(i + 1)]
    g = spark.createDataFrame(cells, "i long, j long, value double").repartition(3)
    ids = spark.createDataFrame([(i, f"s{i}") for i in range(12)], "grm_index long, iid string").repartition(3)
    sinks.grm_ids(ids, p)
    assert read(".id") == [f"s{i}" for i in range(12)]
    sinks.grm_meta(64, 2.5, spark, p)
    assert read(".N") == ["64", "2.5"]
    sinks.grm_dense(g, p, 0.5)
    assert np.fromfile(f"{p}.bin").tolist() == [v + 0.5 * (i == j) for i, j, v in cells]
    for fmt, lines in ((0, 12), (1, 78), (2, 78)):
        assert len((tmp_path / f"f{fmt}").read_text().splitlines()) == lines if sinks.grm_as(g, str(tmp_path / f"f{fmt}"), fmt, ids) else False
    assert (tmp_path / "f1").read_text().splitlines()[2] == "2 2 11.000000" and (tmp_path / "f0").read_text().split()[1] == "10.000000"
    sinks.grm_as(g, str(tmp_path / "f3"), 3, sparse=True)
    assert grm_io.read_sparse(spark, str(tmp_path / "f3")).count() == 78
    grouped = ids.withColumn("group_id", F.lit(1)).withColumn("group_size", F.lit(12))
    sinks.groups(grouped, p)
    assert read(".group")[0] == "1 s0 1 12" and read(".group_size") == ["12 1"]
    with pytest.raises(KeyError):
        grm_io.retained(grm_io.read_groups(spark, f"{p}.group", ids).where("grm_index > 0"), ids)
    with pytest.raises(Exception, match="exists"):
        sinks.grm_ids(ids, p)
    fit = lmm.Fit(["G", "residual"], np.array([1.0, 2.0]), np.array([0.1, 0.2]), np.eye(2), np.ones(2), 3, 0.0, True)
    sinks.variances(fit, spark, p)
    assert read(".var") == ["component variance se", "G 1.0000000 0.10000000", "residual 2.0000000 0.20000000"]
    sinks.variances(fit, spark, f"{p}2", se=False)
    sinks.heritability(fit, spark, p)
    assert len(read(".h2")) == 4 and len(read("2.var")[0].split()) == 2
    sinks.gamma([("main", 0.5)], spark, p)
    assert read(".gamma")[1] == "main 0.50000000"
    vectors = np.eye(3)
    sinks.eigen(np.array([3.0, 2.0, 1.0]), vectors, np.array(["a", "b", "c"]), spark, p)
    assert read(".eigenvals") == ["3", "2", "1"] and len(read(".eigenvecs")) == 3
    sinks.pruned(["s3", "s1"], spark, p)
    assert read(".pruned_iid") == ["s3", "s1"]
    scanned = spark.createDataFrame([(1, "1", "rs1", 7, "A", "C", 0.25, 10, 0.5, 0.1, 0.2, float("nan"), 0.3, 0.4)], "order long, chrom string, SNP string, base long, allele1 string, allele2 string, af double, N long, beta_main double, se_main double, p_gxe double, beta_1 double, se_1 double, p_1 double")
    sinks.assoc(scanned, p)
    sinks.per_environment(scanned, p)
    assert read(".assoc")[0] == "order chrom SNP base allele1 allele2 af N beta_main se_main p_gxe"
    assert read(".perE.assoc")[1] == "1 1 rs1 7 A C 0.25000000 10 nan 0.30000000 0.40000000"
    sinks.moment_variances({"G": 0.5}, spark, f"{p}m")
    assert read("m.var") == ["0.5"]
    out = susie.Result(np.eye(2), np.eye(2), np.array([1.0, 0.0]), [[0]], [1.0], 2)
    assert len(sinks.fine_mapping(out, spark, p)) == 5 and read(".CS") == ["1"]
    assert sinks.part_suffix("a", 1, 5) == "a.1_5" and sinks.prefix_suffix("a.grm", ".grm") == sinks.prefix_suffix("a", ".grm") == "a.grm"


def test_global_positions(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(1000)], "a long, b long").repartition(7)
    got = sorted((r.pos, r.a, r.b, r.before) for r in numbered(rows, "a", "b", sums={"before": "b"}).collect())
    want = sorted((k % 5, k) for k in range(1000))
    assert [(a, b) for _, a, b, _ in got] == want and [x[0] for x in got] == list(range(1000))
    assert [x[3] for x in got] == [0, *np.cumsum([b for _, b in want])[:-1].tolist()]


def test_mom(spark):
    s, features, _ = _simulated(spark, n=300, m=400, additive=0.6, background=0.0, focused=0.0)
    a, b = (mom.fit(features.repartition(k), s["y"], s["env"], seed=3) for k in (1, 4))
    assert all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-9) for k in a) and 0.2 < a["G"] < 1.1
    assert set(mom.fit_per_environment(features, s["y"], s["env"][:, :2])) == {"G", "GxE1", "GxE2", "residual"}


def test_fine_mapping():
    s = simulate.trait(n=600, m=5, additive=0.0, background=0.0)
    x = susie.design(s["dosage"][0], s["env"])
    y = s["y"] - s["y"].mean()
    out = susie.fit(x.T @ x, x.T @ y, float(y @ y), float(y.var()), np.corrcoef(x.T))
    assert set(np.flatnonzero(out.pip > 0.95)) == {1, 2} and [1] in out.sets and [2] in out.sets
    again = susie.fit(x.T @ x, x.T @ y, float(y @ y), float(y.var()), np.corrcoef(x.T), samples=len(y))
    fit = np.linalg.lstsq(x[:, [1, 2]], y, rcond=None)
    assert set(np.flatnonzero(again.pip > 0.95)) == {1, 2} and again.sigma2 == pytest.approx(fit[1][0] / len(y), rel=0.1)


def test_design_drops_dependent_columns(spark):
    df = spark.createDataFrame([(float(i), float(i % 4), "abc"[i % 3]) for i in range(30)], "y double, x double, c string")
    cols, labels = table.design(df, ["x"], ["c"])
    assert labels == ["intercept", "covariate x", "class c a", "class c b"]
    with pytest.raises(Exception, match="positive"):
        spark.createDataFrame([(-1.0,)], "y double").select(table.log_positive(F.col("y"))).collect()


def test_inverse_normal_is_symmetric(spark):
    z = sorted(r.z for r in table.blom(spark.createDataFrame([(float(i),) for i in (3, 1, 1, 9, 7)], "y double"), "y").select(special.norm_ppf("quantile").alias("z")).collect())
    assert z[0] == z[1] and z[-1] > 0 > z[0]


def test_stream_of_features(spark, tmp_path):
    rng = np.random.default_rng(0)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(j, [int(x) for x in rng.integers(0, 3, 50)]) for j in range(20)] + [(99, [0] * 50)]
    spark.createDataFrame(rows, bed.SCHEMA).write.parquet(src)
    q = passing_features(spark, src).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.snp_idx for r in spark.read.parquet(out).collect()} == set(range(20))


def test_predicates_are_strict():
    assert qc.MAF == 0.01 and len(text.MISSING) == 13


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_match_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    for name in ("geno_af_missing", "geno_qc_mom", "feature_mean_impute", "ols_residual_full", "blom_quantile", "related_components", "scan_refit_2x2", "acat_weighted", "mom_product", "credible_set", "text_normalise_split", "triangle_partition", "group_file", "grm_files", "bed_index_read", "bed_summary", "matrix_block", "inverse_normal", "prune_close", "ld_leads", "phenotype_file", "null_weighted_forms", "assoc_table", "reml_eigen_sums", "gxe_prepared", "mom_adjusted", "reorder_by_group", "block_offsets"):
        want = c.execute(ORACLE[name])
        names, want = [d[0] for d in want.description], want.fetchall()
        cols = sorted(names)
        key = lambda rows: sorted(map(repr, rows))
        got = QUERIES[name](spark, SF).select(*cols).toArrow().to_pylist()
        plain = lambda rows: [tuple(x + 0.0 if isinstance(x, (int, float)) else x for x in r) for r in rows]
        assert key(plain([r[c] for c in cols] for r in got)) == key(plain([r[names.index(c)] for c in cols] for r in want)), name


def test_blocks_grow_and_parts_and_groups_are_whole(spark, monkeypatch):
    """Blocks that grew, rows of a range only, and entries within groups only, against the self-join."""
    monkeypatch.setattr(grm, "BLOCK", 2)
    monkeypatch.setattr(grm, "BLOCKS", 3)
    monkeypatch.setattr(grm, "LARGEST", 8)
    monkeypatch.setattr(grm, "ENTRIES", 16)
    rng = np.random.default_rng(4)
    n = 31
    cells = [(int(i), int(j), float(rng.normal())) for i in rng.permutation(n) for j in range(9)]
    x = spark.createDataFrame(cells, "iid long, snp long, x double")
    want = {(r.i, r.j): r.value for r in grm.relationship_sql_form(x, 2.0).collect()}
    got = {(r.i, r.j): r.value for r in grm.product(x, 2.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)
    for first, stop in ((None, 7), (7, 19), (19, None)):
        some = {(r.i, r.j) for r in grm.product(x, 2.0, only=(first, stop)).collect()}
        assert some == {k for k in want if (first or 0) <= k[0] < (n if stop is None else stop)}
    group = [0 if i % 3 else 1 + i % 4 for i in range(n)]
    groups = spark.createDataFrame(list(enumerate(group)), "iid long, group_id long")
    for chunk in (grm.CHUNK, 2):
        some = {(r.group_id, r.i, r.j): r.value for r in grm.product(x, 2.0, chunk=chunk, within=groups).collect()}
        assert some.keys() == {(group[i], i, j) for i, j in want if group[i] == group[j]}
        assert all(some[g, i, j] == pytest.approx(want[i, j], abs=1e-10) for g, i, j in some)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_matrix_times_itself_needs_no_join(spark):
    assert "Join" not in _plan(QUERIES["grm_epistatic"](spark, SF)).split("MapInArrow")[0]


@pytest.mark.parametrize("name", ["grm_id_triplets", "gxe_relationship"])
def test_entries_are_not_shuffled_for_columns_of_samples(spark, name):
    """Names and environments go to the tasks, even where Spark wouldn't broadcast them by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        above = _plan(QUERIES[name](spark, SF)).split("MapInArrow")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert above.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in above


def _features(spark, n=60, m=5, seed=8):
    z = np.random.default_rng(seed).standard_normal((n, m))
    rows = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(n) for j in range(m)], "iid long, snp long, x double")
    return z, rows


def test_eigenvalues_by_features_equal_the_matrix(spark):
    for n, m in ((60, 5), (4, 9)):
        z, rows = _features(spark, n, m)
        got = [r.eigenvalue for r in grm.eigenvalues(grm.Factors(rows, float(m))).orderBy("k").collect()]
        assert np.allclose(got, np.linalg.eigvalsh(z @ z.T / m)[::-1], atol=1e-10)


def test_inverse_of_a_large_group_by_features(spark, monkeypatch):
    """A group beyond the bound, smaller ones and loose samples against inverses of matrices."""
    monkeypatch.setattr(grm, "DENSE", 12)
    z, rows = _features(spark)
    group = np.array([1 if i % 2 else 2 + i // 8 if i < 56 else 100 + i for i in range(60)])
    groups = spark.createDataFrame([(i, int(g), int((group == g).sum())) for i, g in enumerate(group)], "iid long, group_id long, group_size long")
    got = {(r.i, r.j): r.value for r in grm.inverse_by_features(grm.Factors(rows, 5.0, 0.001), groups).collect()}
    want = {}
    for g in set(group):
        at = np.flatnonzero(group == g)
        vi = np.linalg.inv(z[at] @ z[at].T / 5 + 0.001 * np.eye(len(at)))
        want |= {(int(at[a]), int(at[b])): vi[a, b] for a in range(len(at)) for b in range(a + 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-6) for k in want)


def test_models_of_large_groups_equal_dense_fits(spark, monkeypatch):
    """The models by features, with large groups, small ones and loose samples, against those by entries."""
    monkeypatch.setattr(grm, "DENSE", 12)
    z, rows = _features(spark, 90, 5)
    n = len(z)
    group = np.array([1 if i % 2 else 2 if i % 3 == 0 else 3 + i // 8 if i < 70 else 100 + i for i in range(n)])
    size = np.array([(group == g).sum() for g in group])
    assert (size > 12).sum() > 50 and (size == 1).any() and ((size > 1) & (size <= 12)).any()
    rng = np.random.default_rng(6)
    e = rng.standard_normal((n, 2))
    k = z @ z.T / 5 * (group[:, None] == group[None, :])
    y = 0.8 * z @ rng.standard_normal(5) * (1 + 0.5 * e[:, 0]) + rng.standard_normal(n) * (1 + 0.3 * abs(e[:, 1]))
    s, kernel, groups = _frames(spark, k, group, size, e, y - y.mean())
    g = rng.binomial(2, 0.3, (6, n)).astype(float)
    features = spark.createDataFrame([(j, d.tolist()) for j, d in enumerate(g)], "snp_idx long, dosage array<double>")
    x = g - g.mean(1, keepdims=True)
    for gxe in (False, True):
        t, fixed = association.gxe_prepare(s, "y", [F.lit(1.0)], ["e1", "e2"]) if gxe else (s, [F.lit(1.0)])
        a = association.fitted(t, grm.Factors(rows, 5.0), groups, "y", fixed, ["e1", "e2"], gxe=gxe, jitter=0.01)
        b = association.fitted(t, kernel, groups, "y", fixed, ["e1", "e2"], gxe=gxe, jitter=0.01)
        assert a.null.large is not None and b.null.large is None
        assert a.fit.converged and b.fit.converged and np.allclose(a.fit.var, b.fit.var, rtol=1e-4, atol=1e-7) and a.fit.logl == pytest.approx(b.fit.logl, abs=1e-7)
        assert np.allclose(a.fit.diag, b.fit.diag) and np.allclose(a.null.viy, b.null.viy, rtol=1e-3, atol=1e-6)
        ks = lmm.kernels(k + 0.01 * np.eye(n), a.e if gxe else None, True)
        vi = np.linalg.inv(sum(v * q for v, q in zip(a.fit.var, ks, strict=True)))
        score, info, logl = _dense_reml(a.y, np.ones((n, 1)), ks, a.fit.var)
        assert a.fit.logl == pytest.approx(logl) and np.allclose(a.fit.information, info)
        env = a.e if gxe else np.zeros((n, 0))
        forms = {r.snp_idx: r for r in scan.quadratic(features, a.null, env).collect()}
        for j, one in enumerate(x):
            w = np.column_stack([one, one[:, None] * env])
            assert np.allclose(np.reshape(forms[j].m, (w.shape[1],) * 2), w.T @ vi @ w) and np.allclose(forms[j].vy, w.T @ vi @ a.y)


def test_parts_go_as_they_are_joined(spark, tmp_path):
    parts = tmp_path / "parts"
    parts.mkdir()
    for i in range(3):
        (parts / f"part-{i:05d}").write_bytes(bytes([65 + i]) * 4)
    sinks._joined(spark, str(parts), str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == b"AAAABBBBCCCC" and not list(parts.glob("part-*"))


def test_entries_are_rounded_half_away_from_zero(spark):
    given = [0.0078125, -0.0078125, 1.0000005, -1.0000015, -1e-9, 0.4999999, 123456.7890125, 3e13, float("inf"), None]
    rows = spark.createDataFrame([(x,) for x in given], "value double")
    got = [(r.value, r.want) for r in rows.select(entry(), F.round("value", 6).alias("want")).collect()]
    assert [a for a, _ in got] == [b for _, b in got] and math.copysign(1, got[4][0]) == 1
    assert math.isnan(spark.createDataFrame([(math.nan,)], "value double").select(entry()).first()[0])
    for name in ("grm_additive_t1", "grm_dom_bio", "grm_diag_jitter", "grm_epistatic"):
        assert "round(" not in _plan(QUERIES[name](spark, SF)), name


def test_entries_of_large_blocks_come_by_value(spark, monkeypatch):
    """The same entries, equal ones side by side, also where samples are missing and ids leave holes."""
    rng = np.random.default_rng(3)
    ids = np.sort(rng.choice(70, 50, replace=False))
    d = rng.integers(0, 3, (50, 7)) - 1.0
    rows = spark.createDataFrame([(int(i), k, float(x)) for i, v in zip(ids, d, strict=True) for k, x in enumerate(v)], "iid long, snp long, x double")
    monkeypatch.setattr(grm, "WORTH", 1 << 8)
    want = {(int(ids[a]), int(ids[b])): d[a] @ d[b] / 4 for a in range(50) for b in range(a + 1)}
    got = [(r.i // 32, r.j // 32, r.i, r.j, r.value) for r in grm.product(rows, 4.0, 32, by_value=True).collect()]
    assert len(got) == len(want) and {(i, j): x for _, _, i, j, x in got} == want
    for pair in {x[:2] for x in got}:
        values = [x[4] for x in got if x[:2] == pair]
        assert values == sorted(values)
    assert [(r.i, r.j) for r in grm.product(rows, 4.0, 32, above=0.5, by_value=True).collect() if r.value <= 0.5] == []


def test_places_by_value():
    """Each place that is kept comes once, in order by ranges; equal values in bulk come in parts."""
    rng = np.random.default_rng(4)
    odd = np.array([np.nan, np.inf, -np.inf, 0.0, -0.0, 1.0])
    for value in (rng.standard_normal(5000), rng.choice(odd, 5000), np.full(5000, np.nan), np.ones(5000), rng.integers(0, 3, 5000) * 1.0, np.zeros(0), np.ones(3)):
        keep = rng.random(len(value)) < 0.7
        got = list(grm._by_value(value, keep, 300))
        assert sorted(np.concatenate([*got, np.zeros(0, int)])) == list(np.flatnonzero(keep)) and all(len(x) <= 900 for x in got)
        assert all(np.array_equal(value[x], np.sort(value[x]), equal_nan=True) for x in got)
    value = rng.standard_normal(5000)
    assert np.array_equal(value[np.concatenate(list(grm._by_value(value, value < 9, 300)))], np.sort(value))


def test_results_of_whole_matrices_come_by_value(spark, monkeypatch):
    monkeypatch.setattr(grm, "WORTH", 1)
    values = [r.value for r in QUERIES["grm_additive_t1"](spark, SF).collect()]
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(values) == n * (n + 1) // 2 and values == sorted(values)


def test_entries_in_narrow_strips(spark, monkeypatch):
    """Entries that don't come by value: columns come some at a time, so that they repeat at short distances."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((50, 7))
    rows = spark.createDataFrame([(i, k, float(v)) for i, u in enumerate(x) for k, v in enumerate(u)], "iid long, snp long, x double")
    monkeypatch.setattr(grm, "STRIP", 6)
    got = [(r.i, r.j, r.value) for r in grm.product(rows, 4.0, 32).collect()]
    assert sorted(z[:2] for z in got) == [(i, j) for i in range(50) for j in range(i + 1)]
    assert all(v == pytest.approx(x[i] @ x[j] / 4, abs=1e-12) for i, j, v in got)
    for pair in {(i // 32, j // 32) for i, j, _ in got}:
        strips = [(j % 32) // 6 for i, j, _ in got if (i // 32, j // 32) == pair]
        assert strips == sorted(strips)


@pytest.mark.parametrize("name", ["grm_feature", "grm_merge", "within_group_grm", "grm_diag_jitter", "grm_epistatic", "grm_id_triplets", "grm_reformat_triplet"])
def test_results_of_feature_matrices_come_by_value(spark, monkeypatch, name):
    """Runs of rising values are a few (parts of a merge, squares that fall and rise, a shifted diagonal), not one for each row."""
    monkeypatch.setattr(grm, "WORTH", 1)
    values = np.array([r.value for r in QUERIES[name](spark, SF).collect()])
    few = len(values) // 20 if name == "within_group_grm" else 8
    falls = (np.diff(values) < 0).sum() if name != "grm_epistatic" else (np.diff(np.sign(np.diff(values[np.append(True, np.diff(values) != 0)]))) != 0).sum()
    diagonal = len(set(spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().vec_id)) if name == "grm_diag_jitter" else 0
    assert len(values) > 100 and falls <= few + diagonal
