"""Differential features: group means, contrasts, variance moderation, adjusted p-values.

``by`` columns (strata) and the contrast are keys of one plan; nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortile.functions.sizing import one_row, small_side
from cohortile.functions.special import digamma_udf, prior_df_udf, t_two_sided_udf, trigamma_udf
from cohortile.operators import ranks
from cohortile.operators.matrix import log_cpm
from cohortile.session import stored


def group_means_fit(expr: DataFrame, *, feature: str = "feature", group: str = "grp", value: str = "value",
                    by: Sequence[str] = (), sample: str | None = None) -> DataFrame:
    """One row per (by, feature, group): n, mean, and the feature's residual s2 with df = N - K.

    With ``sample`` the query fails, with counts, at a feature that does not have exactly the samples of its
    ``by``, once each: rows and a fingerprint of the samples ride along with the sums.
    """
    mark = F.xxhash64(sample) if sample else F.lit(0).cast("long")
    cells = expr.groupBy(*by, feature, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("_v"),
        F.count(F.lit(1)).alias("_rows"), F.bit_xor(mark).alias("_mark"))
    w = Window.partitionBy(*by, feature)
    if sample:
        whole = expr.select(*by, sample).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_want"), F.bit_xor(F.xxhash64(sample)).alias("_want_mark"))
        cells = cells.join(small_side(whole), list(by)) if by else cells.withColumn("_w", one_row(whole)).select(*cells.columns, "_w.*")
        rows = F.sum("_rows").over(w)
        said = F.concat(F.lit(f"{feature} "), F.col(feature).cast("string"), F.lit(" has "), F.col("_held").cast("string"),
                        F.lit(" rows where "), F.col("_want").cast("string"), F.lit(" samples are expected, once each"))
        right = (F.col("_held") == F.col("_want")) & (F.col("_seen") == F.col("_want_mark"))
        cells = cells.withColumns({"_held": rows, "_seen": F.bit_xor("_mark").over(w)}).withColumn(
            "mean", F.when(right, F.col("mean")).otherwise(F.raise_error(said)))
    cells = cells.select(*by, feature, group, "n", "mean", "_v")
    ss = F.sum(F.coalesce("_v", F.lit(0.0)) * (F.col("n") - 1)).over(w)
    df = F.sum("n").over(w) - F.count(F.lit(1)).over(w)
    return (
        cells.withColumn("df", df)
        .withColumn("s2", F.try_divide(ss, F.nullif(F.col("df"), F.lit(0))))
        .drop("_v")
    )


def contrast_terms(spark: SparkSession, contrasts: Sequence[tuple[str, str, str]], group: str = "grp") -> DataFrame:
    """(contrast, group, weight) rows of 'a minus b' contrasts: two literal rows per contrast."""
    rows = [(c, g, w) for c, a, b in contrasts for g, w in ((a, 1.0), (b, -1.0))]
    return F.broadcast(spark.createDataFrame(rows, f"contrast string, {group} string, weight double"))


def contrast_estimates(fit: DataFrame, contrasts: Sequence[tuple[str, str, str]], *, feature: str = "feature",
                       group: str = "grp", by: Sequence[str] = ()) -> DataFrame:
    """logFC and its unscaled standard error u = sqrt(sum w^2 / n), per contrast.

    A contrast missing one of its groups for a feature is left out.
    """
    terms = contrast_terms(fit.sparkSession, contrasts, group)
    out = fit.join(terms, group).groupBy(*by, feature, "contrast").agg(
        F.sum(F.col("weight") * F.col("mean")).alias("logfc"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight") / F.col("n"))).alias("u"),
        F.max("s2").alias("s2"), F.max("df").alias("df"), F.count(F.lit(1)).alias("_terms"),
    )
    return out.filter("_terms = 2").drop("_terms")


def variance_prior(fit: DataFrame, *, feature: str = "feature", by: Sequence[str] = (),
                   max_rows: int | None = None) -> DataFrame:
    """Prior d0, s0_2, the variance floor and the pooled df: one row, or one per ``by``.

    log-variances are matched by moments to a scaled F; d0 is infinite when their spread
    is no more than sampling noise. Variances below 1e-5 of their median are floored.
    """
    var = fit.groupBy(*by, feature).agg(F.max("s2").alias("s2"), F.max("df").alias("df")).filter("s2 IS NOT NULL")
    med = ranks.quantiles(var, by, "s2", [0.5], ["_med"], max_rows=max_rows).drop("n")
    if by:
        var = var.join(small_side(med), list(by))
    else:
        var = var.withColumn("_med", one_row(med)["_med"])
    floor = F.when(F.col("_med") > 0, F.col("_med")).otherwise(1.0) * 1e-5
    half = F.col("df") / 2.0
    floored = var.withColumn("_floor", floor).withColumn("x", F.greatest("s2", "_floor"))
    # digamma / trigamma depend on df alone, so they are looked up once per distinct df
    per_df = floored.groupBy(*by, "df").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.log("x")).alias("m"), F.var_samp(F.log("x")).alias("v"),
        F.sum("x").alias("sx"), F.max("_floor").alias("floor"),
    ).withColumn("psi", digamma_udf(half)).withColumn("tri", trigamma_udf(half))
    shift = F.col("m") - F.col("psi") + F.log(half)
    moments = per_df.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * shift) / F.sum("n")).alias("emean"),
        (F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0)) + F.col("n") * shift * shift)
         - F.sum(F.col("n") * shift) * F.sum(F.col("n") * shift) / F.sum("n")).alias("ess"),
        (F.sum(F.col("n") * F.col("tri")) / F.sum("n")).alias("tri"),
        (F.sum("sx") / F.sum("n")).alias("xmean"), F.max("floor").alias("floor"),
        F.sum(F.col("n") * F.col("df")).alias("pooled_df"),
    )
    evar = F.try_divide(F.col("ess"), F.nullif(F.col("n") - 1, F.lit(0))) - F.col("tri")
    with_d0 = moments.withColumn("d0", prior_df_udf(F.coalesce(evar, F.lit(0.0))))
    finite = F.col("d0") < float("inf")
    safe = F.when(finite, F.col("d0")).otherwise(2.0) / 2
    return (
        with_d0.withColumn("_psi0", digamma_udf(safe))
        .withColumn("s0_2", F.when(finite, F.exp(F.col("emean") + F.col("_psi0") - F.log(safe))).otherwise(F.col("xmean")))
        .select(*by, "d0", "s0_2", "floor", "pooled_df", F.col("n").alias("n_features"))
    )


def moderate(table: DataFrame, prior: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shrink s2 towards the prior: adds s2_post and df_total to any table holding s2 and df."""
    if by:
        joined = table.join(small_side(prior), list(by))
    else:
        joined = table.withColumn("_p", one_row(prior)).select(
            *table.columns, "_p.d0", "_p.s0_2", "_p.floor", "_p.pooled_df")
    d0, d = F.col("d0"), F.col("df")
    x = F.greatest("s2", "floor")
    post = F.when(d0 == float("inf"), F.col("s0_2")).otherwise((d0 * F.col("s0_2") + d * x) / (d0 + d))
    return (
        joined.withColumn("s2_post", F.when(F.col("s2").isNotNull(), post))
        .withColumn("df_total", F.least(d0 + d, F.col("pooled_df").cast("double")))
        .drop("floor", "pooled_df")
    )


def t_table(estimates: DataFrame, variance: str = "s2", df: str = "df") -> DataFrame:
    """t = logFC / (u sqrt(variance)) and its two-sided p-value."""
    se = F.col("u") * F.sqrt(F.col(variance))
    return (
        estimates.withColumn("t", F.try_divide(F.col("logfc"), F.nullif(se, F.lit(0.0))))
        .withColumn("p_value", t_two_sided_udf(F.col("t"), F.col(df).cast("double")))
    )


def de_table(counts: DataFrame, contrasts: Sequence[tuple[str, str, str]], *, feature: str = "feature",
             sample: str = "sample", group: str = "grp", value: str = "value", by: Sequence[str] = (),
             moderated: bool = True, max_rows: int | None = None) -> DataFrame:
    """Counts to (by, contrast, feature, logfc, t, p_value, adj_p), every contrast in one plan.

    ``max_rows`` is a proven bound on features x contrasts (counted when absent).
    """
    fit = group_means_fit(log_cpm(counts, sample, value, value, by), feature=feature, group=group, value=value, by=by, sample=sample)
    if moderated:
        # three readers follow (median, moments, contrasts); the fit is one row per feature and group
        fit = stored(fit, "fit")
    est = contrast_estimates(fit, contrasts, feature=feature, group=group, by=by)
    if moderated:
        prior = variance_prior(fit, feature=feature, by=by, max_rows=max_rows)
        tested = t_table(moderate(est, prior, by), "s2_post", "df_total")
    else:
        tested = t_table(est)
    adjusted = ranks.bh_adjust(tested, "p_value", [*by, "contrast"], max_rows=max_rows)
    return adjusted.select(*by, "contrast", feature, "logfc", "t", "p_value", "adj_p")


def by_evidence(de: DataFrame, feature: str = "feature", limit: int | None = None) -> DataFrame:
    """Strongest first; with a limit this is a top-k, not a sort."""
    out = de.orderBy(F.abs("t").desc_nulls_last(), feature)
    return out.limit(limit) if limit else out


def significant(de: DataFrame, alpha: float = 0.05, adj: str = "adj_p") -> DataFrame:
    return de.filter(F.col(adj) < alpha)


def split_hits(de: DataFrame, hit, *, by: Sequence[str] = ("contrast",), logfc: str = "logfc", fold: float = 1.0):
    """Counts of hits, up, down and beyond the fold cut-off, in one pass per ``by``."""
    up, down = F.col(logfc) > 0, F.col(logfc) < 0
    return de.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_sig"),
        F.count_if(hit & up).alias("n_up"), F.count_if(hit & down).alias("n_down"),
        F.count_if(hit & (F.abs(logfc) > fold)).alias("n_fold"),
    )
