"""Statistical methods against direct numpy versions on small fixtures."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortile.functions.special import digamma, norm_cdf, t_two_sided, trigamma, trigamma_inverse
from cohortile.operators import diffexp, enrich, explore, matrix, signature, stats, subspace


def long_form(spark, m, features=None, samples=None):
    features = features or [f"g{i:03d}" for i in range(m.shape[0])]
    samples = samples or [f"s{j:02d}" for j in range(m.shape[1])]
    rows = [(features[i], samples[j], float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "feature string, sample string, value double")


def sample_table(spark, m, groups=None):
    groups = groups or ["x"] * m.shape[1]
    return spark.createDataFrame([(f"s{j:02d}", groups[j]) for j in range(m.shape[1])], "sample string, grp string")


def moderated_numpy(logc, groups, a, b):
    names = sorted(set(groups))
    g = np.array(groups)
    n, k = len(g), len(names)
    means = {c: logc[:, g == c].mean(axis=1) for c in names}
    ss = sum(((logc[:, g == c] - means[c][:, None]) ** 2).sum(axis=1) for c in names)
    d = n - k
    s2 = ss / d
    med = np.median(s2)
    x = np.maximum(s2, 1e-5 * (med if med > 0 else 1))
    e = np.log(x) - digamma(d / 2) + math.log(d / 2)
    v = e.var(ddof=1) - trigamma(d / 2)
    if v > 0:
        d0 = 2 * trigamma_inverse(v)
        s02 = math.exp(e.mean() + digamma(d0 / 2) - math.log(d0 / 2))
        post = (d0 * s02 + d * x) / (d0 + d)
    else:
        d0, s02 = math.inf, x.mean()
        post = np.full_like(x, s02)
    u = math.sqrt(1 / (g == a).sum() + 1 / (g == b).sum())
    t = (means[a] - means[b]) / (u * np.sqrt(post))
    return d0, s02, post, t, t_two_sided(t, np.full_like(t, min(d0 + d, d * len(t))))


@pytest.mark.parametrize("spread", [0.9, 0.0])
def test_moderated_t(spark, spread):
    rng = np.random.default_rng(11)
    groups = ["a"] * 3 + ["b"] * 4 + ["c"] * 3
    scale = np.exp(spread * rng.normal(size=60))[:, None]
    counts = np.round(2 ** (8 + scale * rng.normal(0, 0.3, (60, 10))))
    counts[0] = 7.0  # nearly constant feature: its variance meets the floor or the prior
    logc = np.log2((counts + 0.5) / (counts.sum(axis=0) + 1) * 1e6)
    expr = long_form(spark, counts).join(sample_table(spark, counts, groups), "sample")
    fit = diffexp.group_means_fit(matrix.log_cpm(expr))
    prior = diffexp.variance_prior(fit).first()
    d0, s02, post, t, p = moderated_numpy(logc, groups, "a", "c")
    assert prior.d0 == pytest.approx(d0, rel=1e-9) and prior.s0_2 == pytest.approx(s02, rel=1e-9)
    out = diffexp.de_table(expr, [("a_c", "a", "c"), ("b_c", "b", "c")]).filter("contrast = 'a_c'").toPandas().sort_values("feature")
    assert np.allclose(out["t"], t, rtol=1e-8) and np.allclose(out["p_value"], p, rtol=1e-7, atol=1e-14)
    split = diffexp.split_hits(spark.createDataFrame(out), F.col("adj_p") < 0.5).first()
    assert split.n_up + split.n_down == split.n_sig


def test_strata_are_independent(spark):
    rng = np.random.default_rng(4)
    counts = np.round(rng.gamma(3, 40, (40, 12)) + 1)
    groups = ["Y", "N"] * 6
    expr = long_form(spark, counts).join(sample_table(spark, counts, groups), "sample").withColumn(
        "stratum", F.when(F.col("sample") < "s06", "p").otherwise("q"))
    both = diffexp.de_table(expr, [("d", "Y", "N")], by=["stratum"]).toPandas()
    for name, part in (("p", counts[:, :6]), ("q", counts[:, 6:])):
        logc = np.log2((part + 0.5) / (part.sum(axis=0) + 1) * 1e6)
        want = moderated_numpy(logc, ["Y", "N"] * 3, "Y", "N")[3]
        got = both[both.stratum == name].sort_values("feature")["t"]
        assert np.allclose(got, want, rtol=1e-8)


def ssgsea_walk(x, names, members, alpha=0.25):
    order = sorted(range(len(x)), key=lambda i: (-x[i], names[i]))
    r = np.floor(pd.Series(x).rank().to_numpy())
    hit = np.array([names[i] in members for i in order])
    w = np.where(hit, r[order] ** alpha, 0.0)
    return (np.cumsum(w) / w.sum() - np.cumsum(~hit) / (~hit).sum()).sum()


def gsva_walk(f, names, members):
    n = len(f)
    order = sorted(range(n), key=lambda i: (-f[i], names[i]))
    hit = np.array([names[i] in members for i in order])
    w = np.where(hit, np.abs(n - np.arange(1, n + 1) + 1 - n / 2), 0.0)
    walk = np.cumsum(w) / w.sum() - np.cumsum(~hit) / (~hit).sum()
    up, down = max(0, walk.max()), min(0, walk.min())
    return up if up > -down else down


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    m = np.round(rng.normal(size=(40, 6)), 1)  # many ties
    names = [f"g{i:03d}" for i in range(40)]
    sets = {"one": [names[3]], "mid": names[5:17], "odd": names[::2], "all": names}
    table = spark.createDataFrame([(s, g) for s, gs in sets.items() for g in gs] + [("mid", "absent")], "gs_name string, feature string")
    return m, names, sets, long_form(spark, m, names), table


@pytest.mark.parametrize("size", [{}, {"rows_per_task": 50}])
def test_ssgsea_equals_the_walk(scored, size):
    m, names, sets, expr, table = scored
    mapped = enrich.map_sets(table, expr)
    assert {r.gs_name: r.set_size for r in mapped.collect()} == {k: len(v) for k, v in sets.items()}
    got = {(r.gs_name, r.sample): r for r in enrich.ssgsea(expr, mapped, **size).collect()}
    for s, members in sets.items():
        for j in range(6):
            row = got[(s, f"s{j:02d}")]
            if s == "all":
                assert row.es is None  # no feature outside the set
            else:
                assert row.es == pytest.approx(ssgsea_walk(m[:, j], names, set(members)), abs=1e-9)
    one = [got[("mid", f"s{j:02d}")].score for j in range(6)]
    assert max(one) - min(one) == pytest.approx(1)


def test_set_size_limits(scored):
    _, _, _, expr, table = scored
    kept = {r.gs_name for r in enrich.map_sets(table, expr, min_size=2, max_size=20).select("gs_name").distinct().collect()}
    assert kept == {"mid", "odd"}


@pytest.mark.parametrize("size", [{}, {"rows_per_task": 50}])
def test_max_deviation_equals_the_walk(scored, size):
    m, names, sets, expr, table = scored
    density = expr.withColumnRenamed("value", "f")
    mapped = enrich.map_sets(table.filter("gs_name <> 'all'"), expr)
    for r in enrich.max_deviation(density, mapped, **size).collect():
        want = gsva_walk(m[:, int(r.sample[1:])], names, set(sets[r.gs_name]))
        assert r.es == pytest.approx(want, abs=1e-12)


def test_max_deviation_without_weight_is_null(spark):
    # four features: position 3 weighs |4 - 3 + 1 - 2| = 0
    density = spark.createDataFrame([(g, "s", f) for g, f in zip("abcd", (4.0, 3.0, 2.0, 1.0))], "feature string, sample string, f double")
    sets = spark.createDataFrame([("zero", "c"), ("some", "c"), ("some", "a"), ("full", "a"), ("full", "b"), ("full", "c"), ("full", "d")],
                                 "gs_name string, feature string")
    out = {r.gs_name: r.es for r in enrich.max_deviation(density, sets).collect()}
    assert out["zero"] is None and out["full"] is None and out["some"] == pytest.approx(1.0)


def test_kernel_cdf(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(7, 9))
    m[3] = 1.5
    got = enrich.kernel_cdf(long_form(spark, m)).toPandas().pivot(index="feature", columns="sample", values="f")
    assert "g003" not in got.index
    for i in (0, 6):
        h = m[i].std(ddof=1) / 4
        want = [np.mean([NormalDist().cdf((x - y) / h) for y in m[i]]) for x in m[i]]
        assert np.allclose(got.loc[f"g{i:03d}"], want, atol=1e-12)
    assert norm_cdf(np.array([0.0]))[0] == pytest.approx(0.5)


def test_rank_sum_methods(spark):
    a, b = [1.1, 2.2, 3.3, 9.9], [0.5, 0.7, 2.0]
    rows = [("a", x) for x in a] + [("b", x) for x in b] + [("t", x) for x in (1.0, 1.0, 2.0)] + [("z", None)]
    df = spark.createDataFrame(rows, "grp string, value double")
    out = {(r.grp_a, r.grp_b): r for r in stats.rank_sum_pairs(df, [("a", "b"), ("a", "t"), ("a", "missing")]).collect()}
    w = sum(x > y for x in a for y in b)
    assert out[("a", "b")].w == w and out[("a", "b")].exact
    assert out[("a", "b")].p_value == pytest.approx(4 / 35)
    assert not out[("a", "t")].exact and len(out) == 2


def test_shapiro_reference_weights(spark):
    values = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # published worked example, W = 0.79
    df = spark.createDataFrame([("k", float(x)) for x in values] + [("short", 1.0), ("short", 2.0)] + [("flat", 1.0)] * 5, "grp string, value double")
    out = {r.grp: r for r in stats.shapiro(df, ["grp"]).collect()}
    assert out["k"].w == pytest.approx(0.79, abs=0.005) and out["k"].p_value == pytest.approx(0.0067, abs=0.0005)
    assert out["short"].w is None and out["short"].n == 2 and out["flat"].w is None


def test_box_stats_bucketed(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=300), [9, -9, 12]])
    df = spark.createDataFrame([("a", float(v)) for v in x], "grp string, value double")
    q1, q3 = np.quantile(x, [0.25, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    for size in ({}, {"rows_per_task": 40}):
        r = stats.box_stats(df, ["grp"], **size).first()
        assert (r.low_whisker, r.high_whisker, r.n_outliers) == (inside.min(), inside.max(), len(x) - len(inside))
        assert r.q1 == pytest.approx(q1) and r.median == pytest.approx(np.median(x))


def test_kruskal_all_ties_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "grp string, value double")
    r = stats.kruskal(df).first()
    assert r.h is None and r.p_value is None


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(6)
    d, n, m = 12, 7, 9
    x = rng.normal(size=(d, n + m))
    x[:4, :n] += 1.5
    rows = [(i, j, float(x[i, j]), j < n) for i in range(d) for j in range(n + m)]
    return x - x.mean(axis=1, keepdims=True), n, spark.createDataFrame(rows, "feature int, sample int, value double, positive boolean")


def optimum(x, lam=1.0):
    """One-class optimum of rows x by plain Newton in weight space."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = lam * w - ((1 - p)[:, None] * x).mean(axis=0)
        hess = lam * np.eye(len(w)) + (x * (p * (1 - p))[:, None]).T @ x / len(x)
        w -= np.linalg.solve(hess, grad)
    return w


def test_signature_training(training):
    x, n, train = training
    got = signature.train_signature(train).toPandas().sort_values("feature")["weight"].to_numpy()
    assert np.allclose(got, optimum(x[:, :n].T), atol=1e-9)


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_training_of_wide_and_of_steep_data(spark, scale):
    """More features than samples, and features far from unit length: the same solver, the same optimum."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(40, 12)) * scale
    rows = [(i, j, float(x[i, j]), j < 8) for i in range(40) for j in range(12)]
    train = spark.createDataFrame(rows, "feature int, sample int, value double, positive boolean")
    got = signature.train_signature(train).toPandas().sort_values("feature")["weight"].to_numpy()
    assert np.allclose(got, optimum((x - x.mean(axis=1, keepdims=True))[:, :8].T), atol=1e-8)


def test_conjugate_gradients_and_ranks():
    rng = np.random.default_rng(17)
    a = rng.normal(size=(30, 30))
    a, b = a @ a.T + np.eye(30), rng.normal(size=30)
    assert np.allclose(signature.conjugate(lambda v: a @ v, b, 1e-12, 400), np.linalg.solve(a, b), atol=1e-8)
    x = rng.integers(0, 4, (5, 9)).astype(float)
    assert np.array_equal(signature.double_ranks(x), 2 * pd.DataFrame(x).rank(axis=1).to_numpy())


def spearman(a, b):
    return np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_leave_one_out(training, block_bytes):
    """One block for all vectors, and blocks of three."""
    x, n, train = training
    got = signature.leave_one_out(train, block_bytes=block_bytes).toPandas().sort_values("fold")
    auc = []
    for i in range(n):
        w = optimum(np.delete(x[:, :n], i, axis=1).T)
        bk = [spearman(w, x[:, j]) for j in range(n, x.shape[1])]
        auc.append(np.mean([spearman(w, x[:, i]) > s + 1e-12 for s in bk]))
    assert np.allclose(got["auc"], auc)
    assert np.allclose(got["running_auc"], np.cumsum(auc) / np.arange(1, n + 1))


def test_spearman_skips_null_pairs(spark):
    rows = [("a", "s", 1.0), ("b", "s", None), ("c", "s", 0.5), ("d", "s", 7.0), ("x", "flat", 1.0), ("a", "flat", 1.0)]
    expr = spark.createDataFrame(rows, "feature string, sample string, value double")
    w = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.3), ("d", 0.2)], "feature string, weight double")
    out = {r.sample: r.score for r in signature.spearman_scores(expr, w).collect()}
    assert out["s"] == pytest.approx(spearman([1.0, 0.5, 7.0], [0.1, 0.3, 0.2])) and out["flat"] is None
    again = {r.sample: r.score for r in signature.spearman_scores(expr, w, rows_per_task=2).collect()}
    assert again == pytest.approx(out) if None not in out.values() else again["s"] == pytest.approx(out["s"])


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(30, 6))
    m[4] = 2.0
    got = explore.pca_samples(long_form(spark, m), sample_table(spark, m)).toPandas().sort_values("sample")
    keep = np.delete(m, 4, axis=0)
    z = (keep - keep.mean(axis=1, keepdims=True)) / keep.std(axis=1, ddof=1, keepdims=True)
    u, d, _ = np.linalg.svd(z.T, full_matrices=False)
    for c in range(2):
        want = u[:, c] * d[c]
        want *= np.sign(want[np.argmax(np.abs(want))])
        assert np.allclose(got[f"pc{c + 1}"], want, atol=1e-9)
    assert [r.feature for r in explore.constant_features(long_form(spark, m)).collect()] == ["g004"]


@pytest.mark.parametrize("shape, width", [((30, 6), 4), ((4, 9), 32), ((60, 40), 5)])
def test_components_from_a_growing_subspace(spark, shape, width):
    """Subspaces narrower than the samples need several rounds; few features leave a matrix of low rank."""
    rng = np.random.default_rng(19)
    m = rng.normal(size=shape) + 3 * np.outer(rng.normal(size=shape[0]), np.linspace(-1, 1, shape[1]))
    got = explore.pca_samples(long_form(spark, m), sample_table(spark, m), k=2, width=width).toPandas().sort_values("sample")
    z = (m - m.mean(axis=1, keepdims=True)) / m.std(axis=1, ddof=1, keepdims=True)
    u, d, _ = np.linalg.svd(z.T, full_matrices=False)
    for c in range(2):
        want = u[:, c] * d[c]
        want *= np.sign(want[np.argmax(np.abs(want))])
        assert np.allclose(got[f"pc{c + 1}"], want, atol=1e-6)


def test_components_that_do_not_settle_raise(spark):
    m = np.random.default_rng(20).normal(size=(50, 30))
    with pytest.raises(ArithmeticError):
        subspace.leading_components(long_form(spark, m), 2, width=4, max_rounds=1).collect()


@pytest.mark.parametrize("block", [2, 3, 100])
def test_products_in_blocks(spark, block):
    rng = np.random.default_rng(12)
    m = rng.normal(size=(20, 7))
    got = explore.sample_distance(long_form(spark, m), sample_table(spark, m), block=block).collect()
    want = {(f"s{i:02d}", f"s{j:02d}"): np.sqrt(((m[:, i] - m[:, j]) ** 2).sum()) for i in range(7) for j in range(i + 1, 7)}
    assert {(r.sample_a, r.sample_b): r.distance for r in got} == pytest.approx(want)
    pairs = spark.createDataFrame([(list(map(float, r)), list(map(float, r[:5] ** 2))) for r in m], "l array<double>, r array<double>")
    cross = explore.block_products(pairs, "l", "r", width=7, block=block).collect()
    full = m.T @ (m[:, :5] ** 2)
    assert len(cross) == 35 and all(r.total == pytest.approx(full[r.i, r.j]) for r in cross)


def test_marker_svd(spark):
    rng = np.random.default_rng(10)
    m = rng.normal(size=(12, 5))
    names = [f"g{i:03d}" for i in range(12)]
    markers = spark.createDataFrame([("ast", names[i], i) for i in range(6)] + [("neu", names[i], i) for i in range(6, 12)] + [("ast", "none", -1)],
                                    "cell_type string, feature string, ord int")
    got = enrich.marker_svd(long_form(spark, m), sample_table(spark, m), markers, k=4).toPandas()
    for kind, lo in (("ast", 0), ("neu", 6)):
        part = m[lo:lo + 4]
        z = (part - part.mean(axis=1, keepdims=True)) / part.std(axis=1, ddof=1, keepdims=True)
        u, _, vt = np.linalg.svd(z, full_matrices=False)
        want = vt[0] * (-1 if u[:, 0].sum() < 0 else 1)
        assert np.allclose(got[got.cell_type == kind].sort_values("sample")["score"], want, atol=1e-9)


def test_distances_of_equal_and_of_shifted_profiles(spark):
    rng = np.random.default_rng(21)
    m = rng.normal(size=(50, 5)) * 1e3 + 1e6
    m[:, 3] = m[:, 1]
    got = {(r.sample_a, r.sample_b): r.distance for r in explore.sample_distance(long_form(spark, m), sample_table(spark, m)).collect()}
    want = {(f"s{i:02d}", f"s{j:02d}"): np.sqrt(((m[:, i] - m[:, j]) ** 2).sum()) for i in range(5) for j in range(i + 1, 5)}
    assert got == pytest.approx(want, rel=1e-6, abs=1e-3) and got["s01", "s03"] == 0


@pytest.mark.parametrize("partitions", ["4", "200"])
def test_blocks_are_added_in_one_step_or_two(spark, partitions):
    rng = np.random.default_rng(22)
    m = rng.normal(size=(40, 6))
    rows = spark.createDataFrame([("a" if i % 3 else "b", list(map(float, r))) for i, r in enumerate(m)], "k string, v array<double>").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.k, r.i, r.j): r.total for r in explore.block_products(rows, "v", by=["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, part in (("a", m[[i for i in range(40) if i % 3]]), ("b", m[::3])):
        full = part.T @ part
        assert all(got[k, i, j] == pytest.approx(full[i, j]) for i in range(6) for j in range(i, 6)) and len(got) == 42


def test_training_table(spark):
    cells = spark.createDataFrame([(t, u, v) for t, v in (("E1.2", 1.0), ("E2.1", 2.0), ("E3.9", 3.0), ("E4.1", 4.0)) for u in ("U.1", "U.2", "U.3", "U.4")],
                                  "tracking_id string, uid string, value double")
    labels = spark.createDataFrame([("U.1", "SC"), ("U.2", None), ("U.3", "EB")], "uid string, label string")
    fixed = spark.createDataFrame([("U.2", "SC"), ("U.4", "EB")], "uid string, label string")
    mapping = spark.createDataFrame([("E1", "A"), ("E1", "B"), ("E2", "A"), ("E3", ""), ("E4", "C")], "id string, symbol string")
    whole = signature.training_table(cells, labels, fixed, mapping, positive="SC").collect()
    assert {r.feature for r in whole} == {"A|E1.2", "B|E1.2", "A|E2.1", "C|E4.1"} and len(whole) == 16
    assert {r.sample for r in whole if r.positive} == {"U.1", "U.2"}
    chosen = spark.createDataFrame([("A",), ("C",), ("Z",)], "symbol string")
    some = signature.training_table(cells, labels, fixed, mapping, positive="SC", subset=chosen).collect()
    assert {(r.feature, r.value) for r in some} == {("A|E1.2", 1.0), ("C|E4.1", 4.0)}


def plain_kernel(x, h):
    return np.array([norm_cdf((v - x) / h).mean() for v in x])


@pytest.mark.parametrize("shape", ["normal", "outliers", "ties", "two"])
def test_kernel_means_of_many_samples(shape):
    rng = np.random.default_rng(23)
    x = rng.normal(size=3000)
    if shape == "outliers":
        x[:5] *= 1e4
    if shape == "ties":
        x = np.round(x, 1)
    if shape == "two":
        x = np.where(x > 0, 5.0, -5.0)
    h = x.std(ddof=1) / 4
    assert np.abs(enrich.kernel_means(x, h) - plain_kernel(x, h)).max() < 2e-11


def test_kernel_of_twenty_thousand_samples_is_quick():
    import time

    x = np.random.default_rng(24).normal(size=20_000)
    start, h = time.time(), x.std(ddof=1) / 4
    got = enrich.kernel_means(x, h)
    assert time.time() - start < 20
    some = np.arange(0, 20_000, 997)
    assert np.abs(got[some] - [norm_cdf((x[i] - x) / h).mean() for i in some]).max() < 1e-9
