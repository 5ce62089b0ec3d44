"""Relational operators, sources, exports and edge cases."""

import glob

import pytest
from pyspark.sql import functions as F

from cohortile.functions import text
from cohortile.functions.sizing import small_side
from cohortile.operators import cohort, diffexp, matrix, results, signature, variants
from cohortile.session import run_dir
from cohortile.sources import exports, tables


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_label_text(spark):
    df = spark.createDataFrame([("7316-1_solid_tissue",), ("plain",), (None,)], "x string")
    got = cohort.parse_labels(df, "x").collect()
    assert tuple(got[0])[1:] == ("7316-1", "solid_tissue", "tissue")
    assert tuple(got[1])[1:] == ("plain", "", "plain")
    assert tuple(got[2])[1:] == (None, None, None)
    pair = spark.createDataFrame([("a", "B"), ("a", None)], "s string, t string").select(text.make_label("s", F.lower("t")).alias("l"))
    assert [r.l for r in pair.collect()] == ["a_b", None]


def test_recode_keeps_null(spark):
    df = spark.createDataFrame([("S",), ("A",), ("other",), (None,)], "c string")
    got = [r.t for r in df.select(text.recode("c", [("S", "Suspension"), ("A", "Adhesion")], "Solid").alias("t")).collect()]
    assert got == ["Suspension", "Adhesion", "Solid", None]


def test_membership_matches_null(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert values(cohort.keep_members(df, listed, "k"), "v") == [(1,), (2,)]
    assert values(cohort.flag_members(df, listed, "k", "m"), "v", "m") == [(1, True), (2, True), (3, False)]
    assert cohort.keep_members(df, listed.limit(0), "k").count() == 0


def test_small_side_is_measured_and_stored(spark):
    big = spark.range(50).withColumn("x", F.repeat(F.lit("y"), 100))
    plan = lambda d: spark.range(50).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    for side, hinted in ((small_side(big), True), (small_side(big, 50 * 140), True), (small_side(big, 50 * 100), False)):
        assert ("strategy=broadcast" in plan(side)) == hinted and "Relation" in plan(side) and side.count() == 50
    assert small_side(big.limit(0)).count() == 0


def test_alignment(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",), ("z",)], "k string")
    assert tuple(cohort.align_counts(a, b, "k").first()) == (1, 1, 1)
    twice = a.unionByName(a.limit(1))
    for left, right, told in ((a, b, "1 missing, 1 extra, 0 duplicate"), (twice, a, "0 missing, 0 extra, 1 duplicate"), (a.limit(0), a, "0 matched")):
        with pytest.raises(Exception, match=told):
            cohort.require_aligned(spark.range(3), left, right, "k").count()
    assert cohort.require_aligned(spark.range(3), a, a, "k").count() == 3
    assert cohort.require_aligned(spark.range(3), a, b, "k", missing=False, extra=False).count() == 3


def test_keys_that_do_not_match_raise_in_the_operators(spark):
    ids = spark.createDataFrame([("E1.3",)], "tracking string")
    with pytest.raises(Exception, match="no id could be mapped"):
        cohort.map_ids(ids, spark.createDataFrame([("E7", "A")], "id string, symbol string"), "tracking").collect()
    raw = spark.createDataFrame([(f"G{i}_S{i}", s, float(i + 1)) for i in range(3) for s in ("b1", "b2", "b3")], "gene_id string, biospecimen string, value double")
    meta = lambda rows: spark.createDataFrame(rows, "biospecimen string, sample_id string, type string")
    for rows, told in (([("b1", "p", "S"), ("gone", "q", "S")], "1 missing"), ([("b1", "p", "S"), ("b1", "q", "S")], "1 duplicate"),
                       ([("b1", "p", "S"), ("b2", "p", "S")], "labels stand for several samples")):
        with pytest.raises(Exception, match=told):
            matrix.build_matrix(raw, meta(rows), missing_ok=False).collect()
    assert matrix.build_matrix(raw, meta([("b1", "p", "S"), ("gone", "q", "S")])).count() == 3
    weights = lambda rows: spark.createDataFrame(rows, "feature string, weight double")
    expr = spark.createDataFrame([(f, s, float(i * j)) for i, f in enumerate("abc") for j, s in enumerate("xyz")], "feature string, sample string, value double")
    for rows, told in (([("a", 1.0), ("a", 2.0), ("b", 1.0)], "1 duplicate"), ([("q", 1.0)], "0 matched")):
        with pytest.raises(Exception, match=told):
            signature.spearman_scores(expr, weights(rows)).collect()
    counts = expr.withColumn("grp", F.when(F.col("sample") == "x", "A").otherwise("B"))
    broken = counts.filter("NOT (feature = 'b' AND sample = 'y')")
    swapped = broken.unionByName(counts.filter("feature = 'b' AND sample = 'z'"))
    for table in (broken, swapped, counts.unionByName(counts.filter("feature = 'c'"))):
        with pytest.raises(Exception, match="samples are expected, once each"):
            diffexp.de_table(table, [("A_vs_B", "A", "B")]).collect()


def test_id_mapping_expands_and_drops(spark):
    ids = spark.createDataFrame([("E1.3",), ("E2.1",), ("E9.9",)], "tracking string")
    mapping = spark.createDataFrame([("E1", "A"), ("E1", "B"), ("E2", "")], "id string, symbol string")
    assert values(cohort.map_ids(ids, mapping, "tracking"), "id", "symbol") == [("E1", "A"), ("E1", "B")]


def test_unlisted_mutated_sample_is_reported(spark):
    samples = spark.createDataFrame([("p_s", "s"), ("q_a", "a")], "k string, type string")
    out = cohort.group_by_mutation(samples, spark.createDataFrame([("p_s",), ("gone",), ("gone",)], "k string"), "k", "type")
    assert values(out, "k", "status", "in_samples") == [("gone", "mutated", False), ("p_s", "mutated", True), ("q_a", "wt", True)]
    assert {r.k: r.mut_group for r in out.collect()} == {"p_s": "s_mutated", "q_a": "a_wt", "gone": None}


def test_metadata_extension(spark):
    meta = spark.createDataFrame([("P1", "B1", "S", None)], "p string, b string, type string, note string")
    more = spark.createDataFrame([("P1", "B2", "Tumor", 1), ("P1", "B2", "Tumor", 1), ("P9", "B3", "Tumor", 1), ("P1", "B4", "Normal", 1)],
                                 "p string, b string, kind string, n int")
    out = cohort.extend_metadata(meta, more.withColumn("note", F.lit(None).cast("string")), "p", F.col("kind") == "Tumor", {"type": "solid_tissue"})
    assert values(out, "p", "b", "type", "note") == [("P1", "B1", "S", ""), ("P1", "B2", "solid_tissue", "")]


def test_build_matrix(spark):
    raw = spark.createDataFrame([
        ("E1_TP_53", "b1", 4.0), ("E1_TP_53", "b2", 0.0), ("E2_TP_53", "b1", 2.0), ("E2_TP_53", "b2", 2.0),
        ("E3_ZERO", "b1", 0.0), ("E3_ZERO", "b2", 0.0), ("E3_ZERO", "b9", 5.0), ("E4_PAR_Y_X", "b1", 9.0)], "gene_id string, biospecimen string, value double")
    meta = spark.createDataFrame([("b1", "m", "S"), ("b2", "n", "Solid_Tissue"), ("b3", "o", "A")], "biospecimen string, sample_id string, type string")
    # equal means: the smaller id wins; a feature that is zero in the selected samples drops out
    assert values(matrix.build_matrix(raw, meta), "symbol", "label", "value") == [("TP_53", "m_s", 4.0), ("TP_53", "n_solid_tissue", 0.0)]


def test_densify(spark):
    cells = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 2.0), ("h", "c", 5.0), ("h", "off", 5.0)], "feature string, sample string, value double")
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    want = [("g", "a", 3.0), ("g", "b", 0.0), ("g", "c", 0.0), ("h", "a", 0.0), ("h", "b", 0.0), ("h", "c", 5.0)]
    assert values(matrix.densify(cells, samples), "feature", "sample", "value") == want


def test_scaling_edges(spark):
    flat = spark.createDataFrame([("g", "a", 2.0), ("g", "b", 2.0), ("h", "a", 0.0), ("h", "b", 2.0)], "feature string, sample string, value double")
    z = {(r.feature, r.sample): r.value for r in matrix.per_feature(flat, "feature", scale=True).collect()}
    assert z[("g", "a")] is None and z[("h", "a")] == pytest.approx(-(2**-0.5))
    same = spark.createDataFrame([(1.0,), (1.0,)], "value double")
    assert {r.scaled for r in matrix.min_max_scale(same).collect()} == {None}
    twins = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("f", "a", 1.0), ("f", "b", 2.0), ("e", "a", 2.0), ("e", "b", 1.0)],
                                  "feature string, sample string, value double")
    assert values(matrix.distinct_profiles(twins), "feature", "n_copies") == [("e", 1), ("f", 2)]


def de(spark):
    rows = [("s", "A", 2.0, 0.01), ("a", "A", 3.0, 0.02), ("s", "B", -2.0, 0.0), ("a", "B", 2.0, 0.01), ("s", "C", 0.5, 0.01), ("a", "D", 4.0, 0.9)]
    return spark.createDataFrame(rows, "contrast string, feature string, logfc double, adj_p double")


def test_result_algebra(spark):
    table = de(spark)
    listed = spark.createDataFrame([(g,) for g in "ABC"], "feature string")
    tagged = results.labelled_members(table, listed, "feature", [("s", "S"), ("a", "A")])
    assert values(results.overlap_table(tagged, "up"), "feature", "labels", "n") == [("A", "S, A", 2), ("B", "A", 1), ("C", "S", 1)]
    assert values(results.overlap_table(tagged.union(tagged), "down"), "feature", "labels", "n") == [("B", "S, S", 2)]
    assert values(results.overlap_sizes(tagged, "S", "A"), "direction", "n_a", "n_b", "n_ab") == [("all", 3, 2, 2), ("down", 1, 0, 0), ("up", 2, 2, 1)]
    s, a = table.filter("contrast = 's'"), table.filter("contrast = 'a'")
    assert values(results.concordant(s, a), "feature") == [("A",)]
    v = {(r.contrast, r.feature): r for r in results.volcano(table, listed).collect()}
    assert v[("s", "B")].neg_log10_p == float("inf") and v[("s", "C")].de_class == "Unchanged"
    assert v[("a", "A")].class_label == "Up (n = 2)" and ("a", "D") not in v
    both = {(r.contrast, r.feature): r for r in results.volcano_combined(table, listed, only_members=False).collect()}
    assert both[("s", "A")].genes == "Common" and both[("s", "B")].genes == "Unique" and not both[("a", "D")].in_list


def test_vaf_comparison(spark):
    maf = spark.createDataFrame([
        ("G", "p.1", 0.4, "t"), ("G", "p.1", 0.2, "s"), ("G", "p.2", 0.3, "s"), ("H", "p.3", 0.5, "t"), ("H", "p.3", 0.6, "t"),
        ("Unknown", "p.4", 0.5, "t"), ("G", ".", 0.5, "t"), ("G", "p.9", 0.5, "lone")], "symbol string, hgvsp string, vaf double, biospecimen string")
    meta = spark.createDataFrame([("t", "m", "Solid_Tissue"), ("s", "m", "Suspension"), ("lone", "n", "Suspension")],
                                 "biospecimen string, sample_id string, comp string")
    out = variants.compare_vaf(maf, meta, spark.createDataFrame([("G",)], "symbol string"), types=["Suspension", "Adhesion"])
    assert values(out, "sample_id", "type", "label", "vaf_ref", "vaf_type", "n_rows", "origin") == [
        ("m", "Suspension", "", 0.6, 0.0, 2, "Solid_Tissue"), ("m", "Suspension", "G_p.1", 0.4, 0.2, 2, "Common"),
        ("m", "Suspension", "G_p.2", 0.0, 0.3, 1, "Suspension")]


def test_stage_reuse_and_versions(spark):
    path, calls = run_dir(spark, "stage"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([("g", 1.0)], "feature string, value double")

    tables.stage(spark, path, build)
    assert tables.stage(spark, path, build).count() == 1 and len(calls) == 1
    sheets = run_dir(spark, "sheets")
    tables.append_version(build(), sheets, "v11")
    tables.append_version(build(), sheets, "v12")
    assert values(tables.read_version(spark, sheets, "v12"), "feature", "value") == [("g", 1.0)]


def test_gct_and_cls_files(spark):
    cells = spark.createDataFrame([(g, s, float(i)) for i, (g, s) in enumerate([("B", "y"), ("B", "x"), ("A", "y"), ("A", "x"), ("A", "w")])],
                                  "feature string, sample string, value double")
    samples = spark.createDataFrame([("y", "s"), ("x", "a"), ("w", "other")], "sample string, grp string")
    path = run_dir(spark, "gct")
    exports.write_lines(exports.gct_lines(cells, samples, ["s", "a"]), path)
    text_lines = "".join(open(f).read() for f in sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))).splitlines()
    assert text_lines == ["#1.2", "2\t2", "NAME\tDescription\tx\ty", "A\tna\t3\t2", "B\tna\t1\t0"]
    cls = [r.line for r in exports.cls_lines(samples, ["s", "a"], "Adhesion", "Suspension").orderBy("section").collect()]
    assert cls == ["2 2 1", "# Adhesion Suspension", "a s"]
