"""What only shows on large or uneven tables: very many ties, samples that do not match, repeated writes, unfinished solvers."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortile.operators import enrich, explore, matrix, ranks, signature, stats
from cohortile.plans.catalog import QUERIES
from cohortile.session import release, run_dir, shared_dir
from cohortile.sources import tables


@pytest.fixture(scope="module")
def tied(spark):
    many = spark.range(3_000_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("grp"), F.lit(0.0).alias("value"))
    few = spark.range(200).select(F.when(F.col("id") < 120, "a").otherwise("b").alias("grp"), (F.col("id") + 1.0).alias("value"))
    return many.unionByName(few)


def test_rank_sum_with_millions_of_ties(tied):
    row = stats.rank_sum_pairs(tied, [("a", "b")], exact=False).first()
    assert row.n_a == 1_500_120 and row.tie_sum == pytest.approx(3e6 ** 3 - 3e6, rel=1e-12) and 0 < row.p_value < 1


def test_kruskal_with_millions_of_ties(tied):
    row = stats.kruskal(tied).first()
    assert row.n == 3_000_200 and row.h > 0 and 0 < row.p_value < 1


def test_large_path_lays_the_input_out_once(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") % 17).cast("double").alias("v"), F.col("id").alias("i"))
    small = {r.i: r.rank for r in ranks.with_average_rank(df, ["k"], "v", max_rows=400).collect()}
    assert {r.i: r.rank for r in ranks.with_average_rank(df, ["k"], "v", rows_per_task=20).collect()} == small
    placed = ranks.with_position(df, ["k"], [F.col("v").desc(), F.col("i")], rows_per_task=20).collect()
    assert sorted(r.pos for r in placed if r.k == 0) == list(range(1, 135))


CELLS = [("g1", "A", 1.0), ("g1", "B", 2.0), ("g1", "C", 4.0), ("g2", "A", 3.0), ("g2", "B", 9.0), ("g2", "C", 5.0)]


@pytest.mark.parametrize("cells, names", [(CELLS, "ABCD"), ([c for c in CELLS if c[:2] not in (("g1", "A"), ("g2", "B"))], "ABC"), (CELLS, "AB")])
def test_products_refuse_samples_that_do_not_match(spark, cells, names):
    expr = spark.createDataFrame(cells, "feature string, sample string, value double")
    samples = spark.createDataFrame([(n,) for n in names], "sample string")
    for build in (explore.sample_distance, explore.sample_gram, explore.pca_samples):
        with pytest.raises(Exception, match="sample values"):
            build(expr, samples).collect()


def test_training_refuses_a_feature_without_a_sample(spark):
    rows = [(f, s, float(f * s + 1), s < 3) for f in range(4) for s in range(6) if (f, s) != (2, 1)]
    with pytest.raises(Exception, match="unequal samples"):
        signature.train_signature(spark.createDataFrame(rows, "feature int, sample int, value double, positive boolean")).collect()


def test_leave_one_out_sends_no_blocks_and_no_samples_over_the_driver(spark, monkeypatch):
    """What meets in pairs goes by shuffle and a feature's samples by groups, however small their files are."""
    rng, plans = np.random.default_rng(8), {}
    rows = [(f, s, float(rng.normal() + (s < 5) * f), s < 5) for f in range(3) for s in range(12)]
    train = spark.createDataFrame(rows, "feature int, sample int, value double, positive boolean")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(signature, "stored", lambda df, name="table", f=signature.stored: plans.setdefault(name, []).append(plan(df)) or f(df, name))
    out = signature.leave_one_out(train, block_bytes=60)
    seen = [*plans["vectors"], *plans["folds"], plan(out)]
    assert sum("_right" in p for p in seen) > 2 and not any("Broadcast" in p for p in seen)
    assert not any("Window" in p for p in plans["vectors"])
    assert sorted(r.fold for r in out.collect()) == [0, 1, 2, 3, 4]


def test_blocks_follow_the_vectors_and_not_the_partitions(spark):
    rows = spark.range(0, 200, 1, 50).select("id", F.array(*[F.col("id") * 1.0] * 4).alias("v"))
    blocks = signature._blocks(rows, 200, 4, "blocks", 32 * 40).collect()
    assert 5 <= len(blocks) <= 10 and sorted(b.p for b in blocks) == list(range(len(blocks)))
    assert sorted(i for b in blocks for i in b.ids) == list(range(200))
    assert all((np.frombuffer(b.x).reshape(-1, 4)[:, 0] == b.ids).all() and len(b.ids) <= 45 for b in blocks)


@pytest.mark.parametrize("same", [True, False])
def test_products_of_blocks_are_made_tile_by_tile(same):
    rng = np.random.default_rng(9)
    w, q, x = rng.normal(size=(3, 1300, 4))
    p = 1 / (1 + np.exp(-(w @ x.T)))
    keep = 1 - np.eye(len(x)) * same
    assert np.allclose(signature._gradients(same, w, x), ((1 - p) * keep) @ x)
    assert np.allclose(signature._curvatures(same, w, q, x), (p * (1 - p) * (q @ x.T) * keep) @ x)
    a, b, own = (signature.double_ranks(m) for m in (w, x[:1100], q))
    a[:3] = 5.0  # rows without any order correlate with nothing
    with np.errstate(invalid="ignore"):
        rho = np.array([[np.corrcoef(r, s)[0, 1] for s in b[:40]] for r in a[:40]])
    mine = signature._own(a, own)
    assert np.isnan(mine[:3]).all() and np.allclose(mine[3:40], [np.corrcoef(r, s)[0, 1] for r, s in zip(a[3:40], own[3:40])])
    assert np.array_equal(signature._below(mine[:40], a[:40], b[:40]), (mine[:40, None] > np.round(rho, 12)).sum(axis=1))
    assert np.array_equal(signature._below(mine, a, b), sum((mine[:, None] > signature._spearman(a, b[k:k + 1])).sum(axis=1) for k in range(len(b))))
    tracemalloc.start()
    signature._curvatures(same, w, q, x)
    signature._below(mine, a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1300 * 1300 * 8 * 1.5  # a table of all pairs and its copies take several times that


def test_training_refuses_a_sample_twice_and_a_sample_without_a_name(spark):
    rows = [(f, s, float(f * s + 1), s < 3) for f in range(4) for s in range(6)]
    for odd in ([*rows, rows[0]], [(f, None if s == 5 else s, v, p) for f, s, v, p in rows]):
        with pytest.raises(Exception, match="unequal samples"):
            signature.train_signature(spark.createDataFrame(odd, "feature int, sample int, value double, positive boolean")).collect()


def test_unfinished_training_raises(spark):
    rows = [(f, s, float((f + 1) * (s % 3) + s), s < 5) for f in range(3) for s in range(8)]
    train = spark.createDataFrame(rows, "feature int, sample int, value double, positive boolean")
    with pytest.raises(ArithmeticError, match="no optimum"):
        signature.train_signature(train, max_steps=1)
    with pytest.raises(ValueError):
        signature.train_signature(train.withColumn("positive", F.lit(False)))



def test_sets_have_no_upper_limit_by_default(spark):
    sets = spark.range(1600).select(F.lit("s").alias("gs_name"), F.col("id").cast("string").alias("feature"))
    assert enrich.map_sets(sets, sets).count() == 1600 and enrich.map_sets(sets, sets, max_size=1500).count() == 0


def test_highest_mean_counts_absent_cells(spark):
    raw = spark.createDataFrame([("A_X", "b1", 5.0), ("B_X", "b1", 4.0), ("B_X", "b2", 4.0)], "gene_id string, biospecimen string, value double")
    meta = spark.createDataFrame([("b1", "m", "S"), ("b2", "n", "S")], "biospecimen string, sample_id string, type string")
    assert {r.value for r in matrix.build_matrix(raw, meta).collect()} == {4.0}


def test_a_version_written_twice_is_there_once(spark):
    path, rows = run_dir(spark, "versions"), spark.createDataFrame([("g", 1.0)], "feature string, value double")
    for version in ("v1", "v2", "v1"):
        tables.append_version(rows, path, version)
    assert tables.read_version(spark, path, "v1").count() == 1 and tables.read_version(spark, path, "v2").count() == 1


def test_release_deletes_what_was_stored(spark):
    import os

    path = run_dir(spark, "to-release")
    tables.store(spark.range(3).withColumnRenamed("id", "feature"), path)
    assert os.path.isdir(path.removeprefix("file:")) and release(spark) >= 1
    assert not os.path.exists(path.removeprefix("file:")) and release(spark) == 0 and shared_dir(spark)


@pytest.mark.parametrize("name, parts", [("sf0.001", 200), ("sf0.01", 2_000), ("sf0.1", 20_000)])
def test_set_limits_keep_half_of_the_sets_at_every_scale(spark, name, parts):
    kept = QUERIES["gene_set_block_limits"](spark, f"/root/testdata/{name}")
    assert kept.select("gs_name").distinct().count() == parts // 50


@pytest.mark.parametrize("name, parts", [("sf0.001", 200), ("sf0.1", 20_000)])
def test_shapiro_groups_multiply_at_bounded_size(spark, name, parts):
    out = QUERIES["shapiro_by"](spark, f"/root/testdata/{name}")
    row = out.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"), F.count("p_value").alias("tested")).first()
    assert parts * 0.95 < row.groups <= parts and row.tested == row.groups and row.largest == 25


def test_newton_is_halved_where_full_steps_run_away():
    found = signature.newton(lambda w: np.arctan(w - 3), lambda w, v: v / (1 + (w - 3) ** 2), 1)
    assert abs(found[0] - 3) < 1e-9


def test_stored_tables_are_shared_by_queries_and_released(spark, folder, tmp_path):
    import shutil

    from cohortile.plans.views import Views

    here = str(tmp_path / "data")
    shutil.copytree(folder, here, copy_function=shutil.copyfile)
    built = []
    build = lambda v: v.keep("shared", lambda: built.append(1) or v.matrix())
    first, second = Views(spark, here), Views(spark, here)
    plan = build(first).groupBy("feature").count()._jdf.queryExecution().executedPlan().toString()
    assert build(second).count() == build(first).count() > 0 and built == [1] and "Exchange" not in plan
    shutil.copyfile(f"{here}/region.parquet", f"{here}/again.parquet")  # other files, another table
    assert build(Views(spark, here)).count() > 0 and built == [1, 1]
    mine = [p.removeprefix("file:") for p in spark.sparkContext._cohortile_made]
    assert any(map(os.path.isdir, mine)) and release(spark) == len(mine) and not any(map(os.path.exists, mine))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("cohortile_")]


def test_small_ranks_store_nothing_and_large_ones_one_copy(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") % 170).cast("double").alias("v"), (F.col("id") % 31).cast("double").alias("w"), F.col("id").alias("i"))
    made = lambda: [x for x in spark.sparkContext.__dict__.get("_cohortile_made", []) if "/ranked-" in x or "/layout-" in x]
    before = len(made())
    small = ranks.with_average_ranks(df, ["k"], {"v": "x", "w": "y"})
    want = {r.i: (r.x, r.y) for r in small.collect()}
    both = {r.i: (r.p, r.r) for r in ranks.with_position_and_rank(df, ["k"], "v", "i", "p", "r").collect()}
    assert len(made()) == before
    assert {r.i: (r.x, r.y) for r in ranks.with_average_ranks(df, ["k"], {"v": "x", "w": "y"}, rows_per_task=100).collect()} == want
    assert len(made()) == before + 1
    assert {r.i: (r.p, r.r) for r in ranks.with_position_and_rank(df, ["k"], "v", "i", "p", "r", rows_per_task=100).collect()} == both
    assert len(made()) == before + 2
    run = ranks.with_running_mean(df.select("i", "w"), "i", "w", "m", rows_per_task=250).collect()
    w = [r.w for r in sorted(run, key=lambda r: r.i)]
    assert [r.m for r in sorted(run, key=lambda r: r.i)] == pytest.approx(list(np.cumsum(w) / np.arange(1, 3001)))


@pytest.mark.parametrize("name", ["rank_avg", "ssgsea", "gsva", "bh_adjust", "kruskal", "box_stats", "signature_score", "wilcoxon_pairs", "de_table"])
def test_large_paths_give_the_same_rows(spark, folder, name, monkeypatch):
    """The queries with ranges of a few hundred rows, against their SQL."""
    import __spark_entry__ as entry_module
    from compare import connect, differences

    monkeypatch.setattr(ranks, "ROWS_PER_TASK", 300)
    got = entry_module.queries()[name](spark, folder).toPandas()
    assert differences(got, connect(folder).execute(entry_module.oracle_sql()[name]).df()) is None
