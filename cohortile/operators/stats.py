"""Group comparison statistics from compressed ranks: one row per distinct value is ordered, not one per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortile.functions.sizing import null_safe_join, small_side
from cohortile.functions.special import chi2_tail_udf, norm_quantile_udf, rank_sum_p_udf, shapiro_p_udf
from cohortile.operators import ranks


def rank_sum_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], *, group: str = "grp", value: str = "value",
                   by: Sequence[str] = (), exact: bool | None = None, max_rows: int | None = None,
                   rows_per_task: int | None = None) -> DataFrame:
    """Two-sided rank-sum test of each listed pair within ``by``.

    ``exact=None``: exact p below 50 per side without ties, normal approximation otherwise.
    """
    spark = df.sparkSession
    sides = [(a, b, g, side) for a, b in pairs for g, side in ((a, 1), (b, 0))]
    terms = F.broadcast(spark.createDataFrame(sides, f"grp_a string, grp_b string, {group} string, _is_a int"))
    df, (edges,) = ranks.laid_out(df, by, [value], max_rows, rows_per_task)
    counts = ranks.value_counts(df, [*by, group], value).join(terms, group)
    keys = [*by, "grp_a", "grp_b"]
    cum = ranks.cumulate(counts, keys, value, "n", edges)
    # doubles: products of counts pass the range of a long from two million ties on
    is_a, n, tied = F.col("_is_a"), F.col("n"), F.col("n_tied").cast("double")
    mid = F.col("n_below") + (tied + 1) / 2.0
    stats = cum.groupBy(*keys).agg(
        F.sum(is_a * n).alias("n_a"), F.sum((1 - is_a) * n).alias("n_b"),
        F.sum(is_a * n * mid).alias("_r"), F.sum(n * (tied * tied - 1)).alias("tie_sum"),
    ).filter("n_a > 0 AND n_b > 0")
    few = (F.col("n_a") < 50) & (F.col("n_b") < 50) & (F.col("tie_sum") == 0)
    use_exact = few if exact is None else F.lit(exact)
    return (
        stats.withColumn("w", F.col("_r") - F.col("n_a").cast("double") * (F.col("n_a") + 1) / 2.0).drop("_r")
        .withColumn("exact", use_exact)
        .withColumn("p_value", rank_sum_p_udf("w", "n_a", "n_b", "tie_sum", "exact"))
    )


def kruskal(df: DataFrame, *, group: str = "grp", value: str = "value", by: Sequence[str] = (),
            max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Tie-corrected H over the groups of each ``by``, df and chi-square p; NULL when all values tie.

    To test across panels pass the panel columns in ``by``; to test another factor pass it as ``group``.
    """
    ready = df.filter(F.col(group).isNotNull())
    cum = ranks.cumulative_counts(ready, by, value, labels=[group], max_rows=max_rows, rows_per_task=rows_per_task)
    n, tied = F.col("n"), F.col("n_tied").cast("double")
    per_group = cum.groupBy(*by, group).agg(
        F.sum(n).alias("_n"), F.sum(n * (F.col("n_below") + (tied + 1) / 2.0)).alias("_r"),
        F.sum(n * (tied * tied - 1)).alias("_t"),
    )
    total = F.col("n")
    out = per_group.groupBy(*by).agg(
        F.sum("_n").alias("n"), (F.count(F.lit(1)) - 1).alias("df"),
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.sum("_t").alias("_t"),
    ).withColumn("n", total.cast("double"))
    raw = 12.0 / (total * (total + 1)) * F.col("_s") - 3 * (total + 1)
    tie = 1 - F.try_divide(F.col("_t"), total * total * total - total)
    return (
        out.withColumn("h", F.when(F.col("df") > 0, F.try_divide(raw, F.when(tie > 1e-12, tie))))
        .withColumn("p_value", chi2_tail_udf(F.col("h"), F.col("df").cast("double")))
        .select(*by, F.col("n").cast("long").alias("n"), "df", "h", "p_value")
    )


def shapiro(df: DataFrame, by: Sequence[str], value: str = "value", max_n: int = 5000) -> DataFrame:
    """W and p per group of 3..max_n values (the method's own range); NULL outside it or for constant values.

    Groups outside the range are sized first and never ordered.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_mean"))
    fits = sizes.filter((F.col("n") >= 3) & (F.col("n") <= max_n) & (F.col("_lo") < F.col("_hi")))
    rows = null_safe_join(df.filter(F.col(value).isNotNull()), fits, by)
    w = Window.partitionBy(*by)
    n = F.col("n")
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy(value))).withColumn(
        "m", norm_quantile_udf((F.col("i") - 0.375) / (n + 0.25)))
    u = 1 / F.sqrt("n")
    sums = ranked.groupBy(*by, "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.max("m").alias("m1"),
        F.max(F.when(F.col("i") == n - 1, F.col("m"))).alias("m2"),
        F.sum(F.col("m") * F.col(value)).alias("mx"),
        F.min(value).alias("x1"), F.max(value).alias("xn"),
        F.max(F.when(F.col("i") == 2, F.col(value))).alias("x2"),
        F.max(F.when(F.col("i") == n - 1, F.col(value))).alias("xn1"),
        F.sum((F.col(value) - F.col("_mean")) * (F.col(value) - F.col("_mean"))).alias("ss"),
    )

    def poly(start, *coef):
        out = start
        power = u
        for c in coef:
            out, power = out + F.lit(c) * power, power * u
        return out

    root = F.sqrt("mm")
    # fixed values of the published weights
    a1 = poly(F.col("m1") / root, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
    a2 = poly(F.col("m2") / root, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
    s = sums.withColumns({"a1": F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(a1), "a2": a2})
    m1, m2 = F.col("m1"), F.col("m2")
    eps_small = (F.col("mm") - 2 * m1 * m1) / (1 - 2 * F.col("a1") * F.col("a1"))
    eps_large = (F.col("mm") - 2 * m1 * m1 - 2 * m2 * m2) / (
        1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2"))
    ends = F.col("xn") - F.col("x1")
    next_ends = F.col("xn1") - F.col("x2")
    small = F.col("a1") * ends + (F.col("mx") - m1 * ends) / F.sqrt(eps_small)
    large = F.col("a1") * ends + F.col("a2") * next_ends + (F.col("mx") - m1 * ends - m2 * next_ends) / F.sqrt(eps_large)
    weighted = F.when(n == 3, F.col("a1") * ends).when(n <= 5, small).otherwise(large)
    tested = (
        s.withColumn("w", F.least(F.lit(1.0), weighted * weighted / F.col("ss")))
        .withColumn("p_value", shapiro_p_udf("w", "n")).select(*by, "w", "p_value")
    )
    return null_safe_join(sizes.select(*by, "n"), tested, by, "left")


def box_stats(df: DataFrame, by: Sequence[str], value: str = "value", *, max_rows: int | None = None,
              rows_per_task: int | None = None) -> DataFrame:
    """Quartiles, whisker ends (furthest points within 1.5 IQR) and outlier count per group."""
    by = list(by)
    q = ranks.quantiles(df, by, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                        max_rows=max_rows, rows_per_task=rows_per_task)
    counts = ranks.value_counts(df, by, value, "_n")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - fence) & (F.col(value) <= F.col("q3") + fence)
    return null_safe_join(counts, q, by).groupBy(*by).agg(
        F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("low_whisker"),
        F.max(F.when(inside, F.col(value))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
    )


def label_outliers(df: DataFrame, name: str, group: str, groups: Sequence[str], value: str, above: float) -> DataFrame:
    flagged = F.col(group).isin(list(groups)) & (F.col(value) > above)
    return df.withColumn("label", F.when(flagged, F.col(name)).otherwise(F.lit("")))


def feature_by_group(expr: DataFrame, features: DataFrame, *, feature: str = "feature", value: str = "value",
                     log: bool = True) -> DataFrame:
    """Rows of the picked features, optionally as log2(x + 1)."""
    picked = expr.join(small_side(features.select(feature).distinct()), feature, "left_semi")
    return picked.withColumn(value, F.log2(F.col(value) + 1) if log else F.col(value))


