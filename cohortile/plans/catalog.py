"""Named queries: each takes (spark, folder) and returns a DataFrame over the whole tables there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.functions import text
from cohortile.functions.sizing import require_at_most
from cohortile.operators import cohort, diffexp, enrich, explore, matrix, ranks, results, signature, stats, variants
from cohortile.plans.views import CONTRASTS, DECONV, SEGMENTS, Views
from cohortile.session import run_dir
from cohortile.sources import exports, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

COMPOSITION = [("F", "Suspension"), ("O", "Adhesion")]
TISSUE = "Solid_Tissue"
PAIR = [("asia_vs_europe", "ASIA_vs_EUROPE"), ("asia_vs_africa", "ASIA_vs_AFRICA")]
TYPE_CASES = [("ASIA", "Suspension"), ("EUROPE", "Adherent")]
TYPE_LEVELS = [("Adherent", "Adherent cells"), ("Solid_Tissue", "Tumour"), ("Suspension", "Suspension cells")]


def query(fn: Callable[[Views], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# sources and sinks ----------------------------------------------------------

@query
def src_tsv_roundtrip(v):
    path = run_dir(v.spark, "tsv")
    tables.write_tsv(v.maf(), path)
    return tables.read_tsv(v.spark, path, "symbol string, hgvsp string, vaf double, vclass string, biospecimen long")


@query
def src_gz_tsv(v):
    path = run_dir(v.spark, "gz")
    tables.write_tsv(v.sv(), path, gzip=True)
    return tables.read_gzip_tsv(v.spark, path, "biospecimen long, sv_type string")


@query
def src_list_roundtrip(v):
    path = run_dir(v.spark, "list")
    tables.write_list(v.surface(), path, "feature")
    return tables.read_list(v.spark, path, "feature")


@query
def src_signature_roundtrip(v):
    path = run_dir(v.spark, "signature")
    tables.write_tsv(v.signature(), path, header=False)
    return tables.read_tsv(v.spark, path, "feature string, weight double", header=False)


@query
def matrix_load(v):
    path = run_dir(v.spark, "matrix")
    tables.stage(v.spark, path, v.expr)
    return tables.stage(v.spark, path, v.expr)


@query
def sheet_version(v):
    path = run_dir(v.spark, "sheets")
    tables.append_version(cohort.select_cohort(v.meta(), ["biospecimen", "sample_id", "comp"]), path, "v11")
    tables.append_version(cohort.select_cohort(v.meta(), ["biospecimen", "sample_id"], comp="P"), path, "v12")
    return tables.read_version(v.spark, path, "v12").select("biospecimen", "sample_id")


@query
def export_mixture(v):
    return exports.mixture_lines(v.matrix(), v.samples())


@query
def export_gct(v):
    return exports.gct_lines(v.kept_matrix(), v.samples(), ["ASIA", "EUROPE"])


@query
def export_cls(v):
    return exports.cls_lines(v.samples(), ["ASIA", "EUROPE"], "Asia", "Europe")


@query
def export_gct_mutation(v):
    """One stratum's samples, those with the mutation before those without."""
    return exports.gct_lines(v.kept_matrix(), v.mutated_groups(), ["S0_mutated", "S0_wt"], group="mut_group")


@query
def export_cls_mutation(v):
    return exports.cls_lines(v.mutated_groups(), ["S0_mutated", "S0_wt"], "mutated", "wt", group="mut_group")


# cohort and metadata --------------------------------------------------------

def _typed_meta(v):
    meta = cohort.select_cohort(v.meta(), ["biospecimen", "sample_id", "comp"])
    return meta.withColumn("comp", text.recode("comp", COMPOSITION, TISSUE))


@query
def meta_select(v):
    return cohort.select_cohort(v.meta(), ["biospecimen", "sample_id", "comp"], strategy="1-URGENT")


@query
def meta_merge(v):
    orders = v.table("orders")
    shared = [F.col("o_custkey").cast("string").alias("participant"), F.col("o_orderkey").cast("string").alias("biospecimen"),
              F.nullif("o_orderpriority", F.lit("5-LOW")).alias("descriptor")]
    shared.append(F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("stage"))
    meta = orders.filter("o_orderstatus = 'F'").select(*shared, F.col("o_orderstatus").alias("composition_type"))
    histologies = orders.select(*shared, F.col("o_orderstatus").alias("sample_type"),
                                F.col("o_orderpriority").alias("composition"), "o_totalprice")
    condition = (F.col("sample_type") == "P") & (F.col("composition") == "1-URGENT")
    return cohort.extend_metadata(meta, histologies, "participant", condition, {"composition_type": "solid_tissue"})


@query
def recode_group(v):
    return cohort.with_levels(
        _typed_meta(v).select("biospecimen", "comp"), "comp",
        [("Suspension", "Suspension (s)"), ("Adhesion", "Adhesion (a)"), (TISSUE, "Solid Tissue (t)")], "comp")


@query
def label_parse(v):
    ids = v.table("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"),
        F.lower("p_type").alias("kind"))
    return cohort.parse_labels(ids, "label").withColumn("joined", text.make_label("sample_part", "kind"))


@query
def id_map(v):
    ids = v.id_mapping()
    return cohort.map_ids(ids.select("versioned_id"), ids.select("id", "symbol"), "versioned_id")


@query
def train_labels(v):
    return cohort.lookup_with_overrides(v.training_labels(), v.label_overrides(), "uid", "label").withColumn("positive", F.col("label") == "L0")


@query
def align_check(v):
    features = v.table("part").select(F.col("p_partkey").cast("string").alias("feature"))
    return cohort.align_counts(v.matrix().select("feature"), features, "feature")


@query
def set_intersect(v):
    return v.matrix().select("feature").intersect(v.surface())


@query
def sample_order(v):
    label = F.concat("sample", F.lit("_"), F.replace(F.lower("grp"), F.lit(" "), F.lit("_"))).alias("label")
    typed = explore.annotate_samples(v.samples().select(label), "label", [("asia", "Suspension"), ("europe", "Adherence")], "Solid Tissue")
    return ranks.with_position(typed, [], [F.col("type"), F.col("label")], "ord")


# variants -------------------------------------------------------------------

def _snv(v):
    return variants.class_counts(v.maf(), cohort.select_cohort(v.meta(), ["biospecimen", "sample_id", "comp"]), "vclass")


def _sv(v):
    return variants.class_counts(v.sv(), v.sv_meta(), "sv_type")


@query
def snv_class_counts(v):
    return _snv(v)


@query
def snv_class_pivot(v):
    return variants.class_pivot(v.keep("snv_counts", lambda: _snv(v), "sample_id"), "vclass")


@query
def sv_class_counts(v):
    return _sv(v)


@query
def sv_class_pivot(v):
    return variants.class_pivot(v.keep("sv_counts", lambda: _sv(v), "sample_id"), "sv_type")


@query
def variants_goi(v):
    return variants.of_interest(v.maf(), v.goi(), _typed_meta(v), ["symbol", "hgvsp", "vaf", "vclass", "biospecimen"])


@query
def mutated_samples(v):
    return variants.mutated_samples(v.maf(), v.goi(), _typed_meta(v))


@query
def group_by_mutation(v):
    meta = cohort.select_cohort(v.meta(), ["biospecimen", "comp"], strategy="1-URGENT")
    listed = variants.mutated_samples(v.maf(), v.goi(), v.meta().select("biospecimen"))
    return cohort.group_by_mutation(meta, listed, "biospecimen", "comp")


def _vaf(v):
    return variants.compare_vaf(v.maf(), _typed_meta(v), v.goi(), reference=TISSUE, types=["Suspension", "Adhesion"])


@query
def vaf_compare(v):
    return _vaf(v).select("sample_id", "type", "variant", "of_interest", "vaf_ref", "vaf_type", "n_rows", "origin", "label")


@query
def vaf_quadrants(v):
    return variants.vaf_quadrants(_vaf(v))


# matrices -------------------------------------------------------------------

@query
def matrix_build(v):
    chosen = v.samples().filter(F.col("grp").isin("ASIA", "EUROPE", "AFRICA"))
    meta = chosen.select(F.col("sample").alias("biospecimen"), F.col("sample").alias("sample_id"), F.col("grp").alias("type"))
    return matrix.build_matrix(v.keep("raw", v.expr_raw, "gene_id"), meta, drop_text="_blue_anvil", missing_ok=False)


@query
def dedup_best(v):
    means = v.expr_raw().groupBy("gene_id").agg(F.avg("value").alias("mean"))
    best = matrix.best_per_key(means.withColumn("symbol", text.after_first("gene_id")), "symbol", "gene_id", "mean")
    return rounded(best, "mean")


@query
def zscore(v):
    return rounded(matrix.log_zscore(v.expr()), "value")


@query
def center(v):
    return rounded(matrix.per_feature(v.expr(), "feature", scale=False), "value")


@query
def log_cpm(v):
    return rounded(v.log_counts(), "value")


@query
def minmax_scale(v):
    return rounded(matrix.min_max_scale(v.scores()), "scaled")


@query
def unpivot_long(v):
    return matrix.unpivot(v.deconv(), ["sample"], [n for n, _ in DECONV])


@query
def matrix_transpose(v):
    names = [r[0] for r in v.samples().select("sample").orderBy("sample").limit(variants.PIVOT_LIMIT + 1).collect()]
    require_at_most(len(names), variants.PIVOT_LIMIT, "columns of a transposed table (the long form has no such limit)")
    return matrix.transpose(v.deconv(), "sample", [n for n, _ in DECONV], names)


@query
def dedup_profiles(v):
    detected = v.expr().groupBy("feature", "grp").agg(F.count_if(F.col("value") > 0).cast("double").alias("value"))
    return matrix.distinct_profiles(detected, sample="grp").select("feature", "n_copies")


@query
def rank_avg(v):
    return ranks.with_average_rank(v.expr(), ["sample"], "value", max_rows=v.cell_bound())


# differential features ------------------------------------------------------

def _fit(v):
    return diffexp.group_means_fit(v.log_counts())


@query
def group_means_fit(v):
    return rounded(_fit(v), "mean", "s2")


@query
def contrast_logfc(v):
    return rounded(diffexp.contrast_estimates(_fit(v), CONTRASTS), "logfc", "u", "s2")


def _moderated(v):
    fit = _fit(v)
    return diffexp.moderate(diffexp.contrast_estimates(fit, CONTRASTS), diffexp.variance_prior(fit, max_rows=v.feature_bound()))


@query
def moderated_var(v):
    fit = _fit(v)
    per_feature = fit.groupBy("feature").agg(F.max("s2").alias("s2"), F.max("df").alias("df"))
    moderated = diffexp.moderate(per_feature, diffexp.variance_prior(fit, max_rows=v.feature_bound()))
    return rounded(moderated, "s2", "d0", "s0_2", "s2_post", "df_total")


@query
def moderated_prior_null(v):
    """The matrix without planted effects: the prior has infinite degrees of freedom."""
    fit = diffexp.group_means_fit(matrix.log_cpm(v.kept_expr()))
    return rounded(diffexp.variance_prior(fit, max_rows=v.feature_bound()), "s0_2", "floor").withColumn(
        "d0_infinite", F.col("d0") == float("inf")).drop("d0")


@query
def moderated_t(v):
    tested = diffexp.t_table(_moderated(v), "s2_post", "df_total")
    return rounded(tested.select("contrast", "feature", "logfc", "t", "p_value"), "logfc", "t", "p_value")


@query
def bh_adjust(v):
    tested = stats.kruskal(v.expr(), by=["feature"], max_rows=v.cell_bound()).select("feature", F.round("p_value", 9).alias("p_value"))
    return rounded(ranks.bh_adjust(tested, max_rows=v.feature_bound()), "adj_p")


@query
def de_table(v):
    return rounded(v.de(), "logfc", "t", "p_value", "adj_p")


@query
def de_top(v):
    return rounded(diffexp.by_evidence(v.de().filter("contrast = 'asia_vs_europe'"), limit=100), "logfc", "t", "p_value", "adj_p")


@query
def de_by_stratum(v):
    """Two-class test inside each stratum (even and odd nations): two regions against the rest."""
    number = F.substring_index("sample", "_", -1).cast("int")
    counts = v.counts().withColumn("stratum", F.concat(F.lit("S"), (number % 2).cast("string"))).withColumn(
        "mut", F.when(F.col("grp").isin("ASIA", "AFRICA"), "Y").otherwise("N"))
    de = diffexp.de_table(counts, [("Y_vs_N", "Y", "N")], group="mut", by=["stratum"], max_rows=v.feature_bound() * 2)
    return rounded(diffexp.significant(de), "logfc", "t", "p_value", "adj_p")


@query
def de_split(v):
    return diffexp.split_hits(v.de(), F.col("adj_p") < 0.05)


def _tagged(v):
    return results.labelled_members(diffexp.significant(v.de()), v.surface(), "feature", PAIR)


@query
def deg_overlap_up(v):
    return results.overlap_table(_tagged(v), "up")


@query
def deg_overlap_down(v):
    return results.overlap_table(_tagged(v), "down")


@query
def deg_overlap_all(v):
    return rounded(results.overlap_rows(_tagged(v)), "logfc")


@query
def set_overlap(v):
    return results.overlap_sizes(_tagged(v), PAIR[0][1], PAIR[1][1])


@query
def deg_concordant(v):
    de = v.de()
    return results.concordant(de.filter(F.col("contrast") == PAIR[0][0]), de.filter(F.col("contrast") == PAIR[1][0]))


VOLCANO = ["contrast", "feature", "logfc", "adj_p", "sig", "de_class", "class_label", "neg_log10_p"]


@query
def volcano_classes(v):
    return rounded(results.volcano(v.de(), v.surface()).select(*VOLCANO), "logfc", "adj_p", "neg_log10_p")


@query
def volcano_combined(v):
    de = v.de().filter(F.col("contrast").isin([c for c, _ in PAIR]))
    out = results.volcano_combined(de, v.surface(), only_members=False)
    return rounded(out.select(*VOLCANO, "in_list", "n", "genes"), "logfc", "adj_p", "neg_log10_p")


# group statistics -----------------------------------------------------------

SEGMENT_PAIRS = [(a, b) for i, a in enumerate(SEGMENTS) for b in SEGMENTS[i + 1:]]


@query
def wilcoxon_pairs(v):
    out = stats.rank_sum_pairs(v.scores(), SEGMENT_PAIRS, exact=False, max_rows=v.table("customer").count())
    return rounded(out.drop("exact"), "p_value")


@query
def wilcoxon_exact(v):
    """Default choice of method: five samples a side are tested exactly unless values tie."""
    out = stats.rank_sum_pairs(v.expr(), [("ASIA", "EUROPE"), ("ASIA", "AFRICA")], by=["feature"], max_rows=v.cell_bound())
    return rounded(out, "p_value")


@query
def kruskal(v):
    return rounded(stats.kruskal(v.scores(), max_rows=v.table("customer").count()), "h", "p_value")


@query
def kruskal_by(v):
    return rounded(stats.kruskal(v.expr(), by=["feature"], max_rows=v.cell_bound()), "h", "p_value")


@query
def shapiro(v):
    """Balances by region and block of a thousand suppliers: groups multiply with the data and stay within the method's range."""
    nation, region = v.table("nation"), v.table("region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("grp"))
    balances = v.table("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("_", "grp", F.floor(F.col("s_suppkey") / 1000).cast("string")).alias("grp"), F.col("s_acctbal").alias("value"))
    return rounded(stats.shapiro(balances, ["grp"]), "w", "p_value")


@query
def shapiro_by(v):
    """Each feature over its samples: groups stay as large as the cohort and multiply with the data."""
    return rounded(stats.shapiro(v.kept_expr(), ["feature"]), "w", "p_value")


@query
def box_stats(v):
    out = stats.box_stats(v.table("events"), ["event_type"], "value", max_rows=v.table("events").count())
    return rounded(out, "q1", "median", "q3", "low_whisker", "high_whisker")


@query
def label_outliers(v):
    scaled = matrix.min_max_scale(v.scores())
    named = scaled.withColumn("name", F.col("c_custkey").cast("string"))
    return rounded(stats.label_outliers(named, "name", "grp", ["BUILDING", "MACHINERY"], "scaled", 0.5), "scaled").select("name", "grp", "scaled", "label")


@query
def feature_by_group(v):
    expr = v.kept_expr()
    top = expr.groupBy("feature").agg(F.sum("value").alias("t")).agg(
        F.min_by("feature", F.struct((-F.col("t")).alias("a"), F.col("feature"))).alias("feature"))
    return rounded(stats.feature_by_group(expr, top), "value")


# gene sets ------------------------------------------------------------------

ENRICHMENT_PAIRS = [("ASIA", "EUROPE"), ("ASIA", "AFRICA"), ("EUROPE", "AFRICA")]


def _features(v):
    return v.matrix().select("feature").distinct()


def _mapped(v, features=None):
    return enrich.map_sets(v.gene_sets(), features if features is not None else _features(v))


@query
def gene_set_select(v):
    return enrich.select_sets(v.gene_sets(), "C2")


@query
def gene_set_mapped(v):
    return _mapped(v)


def _ssgsea(v):
    return enrich.ssgsea(v.zscores(), _mapped(v, v.zscores()), max_rows=v.cell_bound())


@query
def ssgsea(v):
    return rounded(_ssgsea(v), "es", "score")


@query
def enrichment_by_group(v):
    out = enrich.scores_by_group(_ssgsea(v), v.samples(), TYPE_CASES, "Solid_Tissue", TYPE_LEVELS)
    return rounded(out.select("gs_name", "sample", "score", "type", "type_ord", "type_label"), "score")


def _scored(v):
    return v.keep("scores", lambda: _ssgsea(v).join(v.samples(), "sample").withColumn("score", F.round("score", 9)), "gs_name")


@query
def enrichment_sets_by_type(v):
    """Sets compared inside each group of samples."""
    scores = _scored(v).select(F.col("grp").alias("type"), F.col("gs_name").alias("grp"), "score")
    return rounded(stats.kruskal(scores, value="score", by=["type"], max_rows=v.cell_bound()), "h", "p_value")


@query
def enrichment_tests_pooled(v):
    """Pairwise tests between groups over the scores of all sets together."""
    out = stats.rank_sum_pairs(_scored(v), ENRICHMENT_PAIRS, value="score", exact=False, max_rows=v.cell_bound())
    return rounded(out.drop("exact"), "p_value")


@query
def gene_set_limits(v):
    """Narrower limits, over sets that multiply with the data instead of growing."""
    return enrich.map_sets(v.gene_set_blocks(), _features(v), min_size=10, max_size=30)


@query
def gene_set_block_limits(v):
    """Only sets within size limits that the caller gives; half of them are in range at every scale."""
    return enrich.map_sets(v.gene_set_blocks(), _features(v), min_size=5, max_size=45)


@query
def enrichment_tests(v):
    """Pairwise tests of the scores between groups, per set."""
    scores = _scored(v)
    bound = v.cell_bound()  # one score per set and sample, and sets are made of features
    out = stats.rank_sum_pairs(scores, ENRICHMENT_PAIRS, value="score", by=["gs_name"], max_rows=bound)
    return rounded(out, "p_value")


@query
def gsva_kcdf(v):
    return rounded(enrich.kernel_cdf(matrix.log_zscore(v.matrix()).filter("value IS NOT NULL")), "f")


@query
def gsva_maxdev(v):
    density = v.zscores().withColumnRenamed("value", "f")
    return rounded(enrich.max_deviation(density, _mapped(v, density), max_rows=v.cell_bound()), "es")


@query
def gsva(v):
    z = matrix.log_zscore(v.matrix()).filter("value IS NOT NULL")
    density = v.keep("density", lambda: enrich.kernel_cdf(z).withColumn("f", F.round("f", 9)))
    return rounded(enrich.max_deviation(density, _mapped(v, density), max_rows=v.cell_bound()), "es")


@query
def top_markers(v):
    return enrich.top_markers(v.markers(), _features(v))


@query
def marker_svd(v):
    out = enrich.marker_svd(v.kept_matrix().withColumn("value", F.log2(F.col("value") + 1)), v.samples(), v.markers())
    return rounded(out, "score")


# signature and exploration --------------------------------------------------

@query
def oneclass_train(v):
    return rounded(signature.train_signature(v.train()), "weight")


@query
def signature_pipeline(v):
    """From labels, overrides, versioned ids, mapping and a gene subset to the weights of the signature."""
    ids, chosen = v.id_mapping().select("id", "symbol"), v.table("part").filter("p_size <= 30").select(F.col("p_name").alias("symbol")).distinct()
    train = signature.training_table(v.training_cells(), v.training_labels(), v.label_overrides(), ids, positive="L0", subset=chosen)
    names = train.select("feature", "symbol").distinct()
    return rounded(signature.train_signature(train).join(names, "feature").select("symbol", "weight"), "weight")


@query
def signature_score(v):
    out = signature.spearman_scores(v.matrix(), v.signature(), max_rows=v.cell_bound())
    return rounded(matrix.min_max_scale(out, "score", "scaled"), "score", "scaled")


@query
def loo_auc(v):
    return rounded(signature.leave_one_out(v.train()), "auc", "running_auc")


@query
def pca_samples(v):
    return rounded(explore.pca_samples(v.matrix(), v.samples()), "pc1", "pc2", digits=5)


@query
def sample_gram(v):
    return rounded(explore.sample_gram(v.matrix(), v.samples()), "total")


@query
def sample_distance(v):
    return rounded(explore.sample_distance(v.matrix(), v.samples()), "distance")


@query
def celltype_distance(v):
    long = matrix.unpivot(v.deconv(), ["sample"], [n for n, _ in DECONV])
    kinds = v.spark.createDataFrame([(n,) for n, _ in DECONV], "variable string")
    return rounded(explore.sample_distance(long, kinds, sample="variable", feature="sample"), "distance")
