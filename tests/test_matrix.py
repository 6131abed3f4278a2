import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hapforge.operators import association as assoc
from hapforge.operators import graph, structure
from hapforge.operators import variants as var
from hapforge.operators.matrix import GenotypeMatrix, binarize


def dense(seed, n=24, m=9, flips=True):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, m)) < rng.uniform(0.1, 0.7, m)).astype(int)
    x[:, 0] = 0  # a column without cells
    x[:2] = 0  # an individual without cells
    flip = rng.random(m) < 0.4 if flips else np.zeros(m, bool)
    return x, flip


def matrix(spark, x, flip):
    n, m = x.shape
    h, v = np.nonzero(x)
    calls = spark.createDataFrame(pd.DataFrame({"variant_idx": v, "hap_idx": h}))
    variants = spark.createDataFrame([(j, "1", 10 * j, f"v{j}", "A", "T", bool(flip[j]), "1") for j in range(m)], "variant_idx long, chrom string, pos int, id string, ref string, alt string, flip boolean, block string")
    haps = spark.createDataFrame([(i, f"p{i // 2:02d}", i % 2, (i // 2) % 2) for i in range(n)], "hap_idx long, iid string, hap int, sex int")
    return GenotypeMatrix(calls, variants, haps)


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark):
    x, flip = dense(request.param)
    m = matrix(spark, x, flip)
    return m, np.where(flip, 1 - x, x), x


def as_array(df, key, cols):
    return df.orderBy(key).select(*cols).toPandas().to_numpy(float)


def test_products_equal_dense(spark, both):
    m, full, _ = both
    rng = np.random.default_rng(0)
    b, y = rng.normal(size=(full.shape[1], 2)), rng.normal(size=(full.shape[0], 2))
    bd = spark.createDataFrame(pd.DataFrame(b, columns=["a", "b"]).assign(variant_idx=range(len(b))))
    yd = spark.createDataFrame(pd.DataFrame(y, columns=["a", "b"]).assign(hap_idx=range(len(y))))
    f = full.mean(0)
    centered = full - f
    scale = np.where(f * (1 - f) > 0, 1 / np.sqrt(np.maximum(f * (1 - f), 1e-12)), 1)
    z = centered * scale
    names = ["a", "b"]
    assert np.allclose(as_array(m.matmat(bd, names), "hap_idx", names), full @ b)
    assert np.allclose(as_array(m.rmatmat(yd, names), "variant_idx", names), full.T @ y)
    assert np.allclose(as_array(m.centered_matmat(bd, names), "hap_idx", names), centered @ b)
    assert np.allclose(as_array(m.normalized_rmatmat(yd, names), "variant_idx", names), z.T @ y)
    assert np.allclose(as_array(m.normalized_matmat(bd, names), "hap_idx", names), z @ b)
    assert np.allclose(as_array(m.grm_matmat(yd, names), "hap_idx", names), z @ (z.T @ y))


def test_counts_equal_dense(both):
    m, full, _ = both
    dose = full.reshape(-1, 2, full.shape[1]).sum(1)
    got = m.carrier_counts().orderBy("variant_idx").toPandas()
    assert got.carriers.tolist() == (dose > 0).sum(0).tolist()
    assert got.heterozygotes.tolist() == (dose == 1).sum(0).tolist()
    assert got.homozygotes.tolist() == (dose == 2).sum(0).tolist()
    assert m.allele_counts().orderBy("variant_idx").toPandas().ac.tolist() == full.sum(0).tolist()


def test_flip_minor_keeps_the_matrix(both):
    m, full, x = both
    turned = m.flip_minor()
    assert turned.allele_counts().orderBy("variant_idx").toPandas().ac.tolist() == full.sum(0).tolist()
    assert (turned.stored_counts().toPandas().stored <= x.shape[0] / 2).all()


def test_males_lose_their_second_haplotype(both):
    m, _, x = both
    kept = m.drop_second_of_males()
    rows = [i for i in range(x.shape[0]) if not ((i // 2) % 2 == 1 and i % 2 == 1)]
    assert kept.n == len(rows) and kept.nnz == x[rows].sum()


@pytest.mark.parametrize("hwe", [True, False])
def test_gwas_equals_least_squares(spark, hwe):
    x, flip = dense(5, 60, 6)
    m, full = matrix(spark, x, flip), np.where(flip, 1 - x, x)
    rng = np.random.default_rng(3)
    n = len(full) // 2
    y, c = rng.normal(size=n), rng.normal(size=n)
    table = assoc.with_intercept(spark.createDataFrame(pd.DataFrame({"iid": [f"p{i:02d}" for i in range(n)], "y": y, "c": c})))
    got = assoc.gwas(m, table, ["y"], ["i0", "c"], assume_hwe=hwe).orderBy("variant_idx").toPandas()
    g = full if hwe else full.reshape(n, 2, -1).sum(1)
    cov = np.column_stack([np.ones(n), c])
    cov, yy = (np.repeat(cov, 2, 0), np.repeat(y, 2)) if hwe else (cov, y)
    p = np.eye(len(cov)) - cov @ np.linalg.pinv(cov)
    for j in range(full.shape[1]):
        den = g[:, j] @ p @ g[:, j]
        if den < 1e-4:
            assert np.isnan(got.y_beta[j])
            continue
        beta = (g[:, j] @ p @ yy) / den
        assert np.isclose(got.y_beta[j], beta)
        rss = yy @ p @ yy
        free = 2 * n - 4
        assert np.isclose(got.y_se[j], np.sqrt((rss if hwe else 2 * rss) / free / den))


def test_gwas_needs_an_intercept_and_people(spark, both):
    m = both[0]
    t = spark.createDataFrame([("p00", 1.0, 2.0)], "iid string, y double, c double")
    with pytest.raises(ValueError, match="intercept"):
        assoc.gwas(m, t, ["y"], ["c"])
    none = assoc.with_intercept(spark.createDataFrame([("nobody", 1.0)], "iid string, y double"))
    with pytest.raises(ValueError, match="no haplotype"):
        assoc.gwas(m, none, ["y"], ["i0"])


def kinship(full, covar=True):
    f = full.mean(0)
    z = ((full - f) / np.sqrt(np.where(f * (1 - f) > 0, f * (1 - f), np.inf))).reshape(-1, 2, full.shape[1]).sum(1)
    z = z - z.mean(0) if covar else z
    return z @ z.T / 2


@pytest.mark.parametrize("flips", [False, True])
def test_exact_traces_equal_dense(spark, flips):
    x, flip = dense(8, 20, 7, flips)
    k = kinship(np.where(flip, 1 - x, x), covar=False)
    t1, t2 = assoc.exact_traces(matrix(spark, x, flip))
    assert np.isclose(t1, np.trace(k)) and np.isclose(t2, np.trace(k @ k))


@pytest.mark.parametrize("estimator,k", [("hutchinson", 40), ("hutch++", 30), ("xnystrace", 12), ("xnystrace", 30)])
def test_estimators_are_near_the_traces(spark, estimator, k):
    x, flip = dense(5, 120, 25)
    m = matrix(spark, x, flip)
    table = assoc.with_intercept(m.iids())
    t1, t2 = assoc.traces(assoc.Kinship(m, table, ["i0"]), k, estimator, seed=3)
    dense_k = kinship(np.where(flip, 1 - x, x))
    assert abs(t1 / np.trace(dense_k) - 1) < 0.3 and abs(t2 / np.sum(dense_k**2) - 1) < 0.5
    if k == 30 and estimator == "xnystrace":  # more probes than directions: exact
        assert np.isclose(t1, np.trace(dense_k)) and np.isclose(t2, np.sum(dense_k**2))


def test_nystrom_traces_are_unbiased():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(200, 60)) * np.geomspace(1, 0.1, 60)
    k = z @ z.T
    got = []
    for _ in range(200):
        o = rng.normal(size=(200, 10))
        got.append(assoc.nystrom_traces(o.T @ k @ o, o.T @ k @ k @ o))
    assert np.allclose(np.mean(got, 0), [np.trace(k), np.sum(k * k)], rtol=0.04)
    assert assoc.nystrom_traces(np.zeros((3, 3)), np.zeros((3, 3))) == (0.0, 0.0)


def test_heritability_and_prediction_equal_dense(spark):
    x, flip = dense(6, 60, 15)
    m, k = matrix(spark, x, flip), kinship(np.where(flip, 1 - x, x))
    y = np.random.default_rng(1).normal(size=30)
    table = spark.createDataFrame([(f"p{i:02d}", float(v)) for i, v in enumerate(y)], "iid string, y double")
    t1, t2, c = np.trace(k), np.sum(k * k), y - y.mean()
    c *= np.sqrt(30 / (c @ c))
    a, b = np.linalg.solve([[t2, t1], [t1, 30]], [c @ k @ c, c @ c])
    got = assoc.haseman_elston(m, assoc.with_intercept(table), ["y"], ["i0"], exact=(t1, t2)).first()
    assert np.allclose([got.s2g, got.s2e, got.h2g], [a * t1, b * 30, a * t1 / (a * t1 + b * 30)])
    whole = np.trace(kinship(np.where(flip, 1 - x, x), covar=False))
    scaled = k * 30 / whole
    want = scaled @ np.linalg.solve(scaled + np.eye(30) * (0.7 / 0.3), y - y.mean())
    assert np.allclose(as_array(assoc.blup(m, table, "y", 0.3), "iid", ["prediction"])[:, 0], want, atol=1e-3)
    with pytest.raises(RuntimeError, match="after 1 steps"):
        assoc.blup(m, table, "y", 0.3, steps=1)


def test_simple_gwas_with_flips_and_empty_columns(spark, both):
    m, full, _ = both
    y = np.random.default_rng(2).normal(size=len(full) // 2)
    table = spark.createDataFrame([(f"p{i:02d}", float(v)) for i, v in enumerate(y)], "iid string, y double")
    got = {r.variant_idx: r for r in assoc.simple_gwas(m, table, "y").collect()}
    assert len(got) == full.shape[1]
    for j, g in enumerate(full.T):
        if g.min() == g.max():
            assert got[j].beta is None and got[j].se is None
        else:
            yy = np.repeat(y, 2)
            beta = np.cov(g, yy)[0, 1] / np.var(g, ddof=1)
            rss = np.sum((yy - yy.mean() - beta * (g - g.mean())) ** 2)
            assert np.isclose(got[j].beta, beta) and np.isclose(got[j].se, np.sqrt(rss / (len(g) - 2) / np.sum((g - g.mean()) ** 2)))


def test_heterozygotes_need_individuals(spark, both):
    m = both[0]
    three = GenotypeMatrix(m.calls, m.variants, m.haps.withColumn("iid", F.lit("one")))
    table = assoc.with_intercept(spark.createDataFrame([("one", 1.0)], "iid string, y double"))
    with pytest.raises(ValueError, match="two haplotypes"):
        assoc.gwas(three, table, ["y"], ["i0"], assume_hwe=False)


def test_containment_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    carriers = {(b, f"v{i}"): frozenset(np.flatnonzero(rng.random(9) < p)) for b in "ab" for i, p in enumerate(rng.uniform(0.1, 0.9, 14))}
    cells = spark.createDataFrame([(b, v, int(h)) for (b, v), hs in carriers.items() for h in hs], "block string, v string, hap_idx long")
    got = {tuple(r) for r in graph.containment(cells).collect()}
    want = {(b, v, w, len(s), len(t)) for (b, v), s in carriers.items() for (c, w), t in carriers.items() if b == c and v != w and s and s <= t}
    assert got == want


def test_leading_values_equal_dense(spark):
    x, _ = dense(4, 20, 8, flips=False)
    m = matrix(spark, x, np.zeros(8, bool))
    f = x.mean(0)
    z = (x - f) / np.sqrt(np.where(f * (1 - f) > 0, f * (1 - f), np.inf))
    values, vectors = structure.pca(m, 2)
    want = np.sort(np.linalg.eigvalsh(z @ z.T))[::-1][:2]
    assert np.allclose(values, want, rtol=1e-5)
    u = as_array(vectors, "hap_idx", ["u_0"])[:, 0]
    assert np.linalg.norm(z @ (z.T @ u) - values[0] * u) < 1e-2 * values[0]
    for k in (0, 20, 1.5):
        with pytest.raises(ValueError):
            structure.pca(m, k)


def test_scores_ignore_unknown_ids(spark, both):
    m, full, _ = both
    effects = spark.createDataFrame([("v1", 1.0), ("v3", -2.0), ("EXTRA", 9.0)], "id string, s double")
    got = as_array(assoc.polygenic_scores(m, effects, ["s"]), "iid", ["s"])[:, 0]
    assert np.allclose(got, (full[:, 1] - 2 * full[:, 3]).reshape(-1, 2).sum(1))


def test_probe_counts_are_checked():
    for k, e in ((0, "hutchinson"), (2, "hutch++"), (1, "xnystrace"), (True, "hutchinson"), (99, "hutchinson")):
        with pytest.raises(ValueError):
            assoc.check_matvecs(k, 50, e)


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_gives_back_the_matrix(spark, seed):
    rng = np.random.default_rng(seed)
    x = (rng.random((14, 8)) < 0.5).astype(int)
    x[:, 1] = x[:, 0] & x[:, 1]
    x[:, 2] = x[:, 1]
    x[:, 4] = x[:, 3] & x[:, 0]
    h, v = np.nonzero(x)
    cells = spark.createDataFrame(pd.DataFrame({"block": "1", "v": [f"v{j}" for j in v], "hap_idx": h}))
    contained = graph.containment(cells)
    reps = graph.representatives(cells, contained)
    closed = graph.closure(contained, reps)
    linear = graph.linearize(closed)
    samples = graph.sample_edges(cells, reps, linear)
    b = spark.createDataFrame([("1", f"v{j}", j + 1) for j in range(8)], "block string, v string, x long")
    got = {r.hap_idx: r.y for r in graph.graph_matvec(linear, samples, reps, b).collect()}
    want = x @ np.arange(1, 9)
    assert all(got.get(i, 0) == want[i] for i in range(14))
    sums = {(r.child, r.parent): r.total for r in graph.path_sums(linear).collect()}
    assert set(sums) == {(r.child, r.parent) for r in closed.collect()} and set(sums.values()) <= {1}
    with pytest.raises(ValueError, match="cycle"):
        ring = spark.createDataFrame([("1", "a", "b"), ("1", "b", "a")], "block string, child string, parent string")
        graph.levels(spark.createDataFrame([("1", "a"), ("1", "b")], "block string, v string"), ring).count()


def test_bed_is_half_open(spark):
    v = spark.createDataFrame([(i, "1", p, 0.1) for i, p in enumerate((99, 100, 199, 200))] + [(9, "2", 150, 0.1)], "variant_idx long, chrom string, pos int, af double")
    bed = spark.createDataFrame([("1", 100, 200)], "chrom string, chromStart long, chromEnd long")
    assert {r.pos for r in var.in_bed(v, bed).collect()} == {100, 199}
    assert var.dual_threshold(v, bed, 0.5, 0.05).count() == 2
    assert var.dual_threshold(v, None, 0.05).count() == 5


def test_bed_regions_over_several_bins(spark):
    v = spark.createDataFrame([(i, c, p, 0.3) for i, (c, p) in enumerate([("1", 5), ("1", 40_000), ("1", 99_999), ("1", 100_000), ("2", 40_000)])], "variant_idx long, chrom string, pos int, af double")
    bed = spark.createDataFrame([("1", 10, 100_000), ("1", 30_000, 50_000), ("1", 7, 7)], "chrom string, chromStart bigint, chromEnd bigint")
    assert {r.variant_idx for r in var.in_bed(v, bed).collect()} == {1, 2}
    assert sorted(r.variant_idx for r in var.dual_threshold(v, bed, 0.4, 0.1).collect()) == [1, 2]
    assert sorted(r.variant_idx for r in var.dual_threshold(v, bed, 0.1, 0.4).collect()) == [0, 3, 4]


def test_frequency_filters_differ_at_the_threshold(spark):
    v = spark.createDataFrame([(1, 0.25), (2, 0.4), (3, 0.75)], "variant_idx long, af double")
    assert {r.variant_idx for r in var.maf_above(v, 0.25).collect()} == {2}
    assert {r.variant_idx for r in var.maf_at_least(v, 0.25).collect()} == {1, 2, 3}


def test_blocks_sort_numbers_before_names(spark):
    b = spark.createDataFrame([("chrX:1-2", "chrX", 1, 3), ("chr10:1-2", "chr10", 1, 3), ("chr2:5-6", "chr2", 5, 3), ("chr2:1-2", "chr2", 1, 3)], "block string, chrom string, start int, n_entries long")
    assert [r.block for r in var.ordered_blocks(b).orderBy("block_idx").collect()] == ["chr2:1-2", "chr2:5-6", "chr10:1-2", "chrX:1-2"]
    assert var.pick_blocks(b, chroms=["CHRx"]).count() == 1
    with pytest.raises(ValueError, match="Did you mean"):
        var.pick_blocks(b, names=["chr2:5-7"])
    with pytest.raises(ValueError):
        var.pick_blocks(b, ["1"], ["x"])


def test_merge_types_and_counts(spark):
    a = spark.createDataFrame([("x", 0), ("x", 1)], "k string, row long")
    b = spark.createDataFrame([("x", 7), ("y", 8)], "k string, row long")
    assert var.merge_rows(a, b, "k").count() == 2
    with pytest.raises(TypeError):
        var.merge_rows(a, b.withColumn("k", F.lit(1)), "k")
    with pytest.raises(ValueError):
        var.attach_info(a.withColumnRenamed("row", "variant_idx"), b.withColumnRenamed("row", "variant_idx").where("variant_idx = 7"))


def test_binarize_rounds_half_to_even(spark):
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.0, 0.5, 1.5, 2.0))], "variant_idx long, hap_idx long, dosage double")
    assert [r.call for r in binarize(d, 0.5).orderBy("hap_idx").collect()] == [0, 0, 2, 2]
    assert binarize(d, 0.99).count() == 0
