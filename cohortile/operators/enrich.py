"""Gene-set scores per sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortile.functions.sizing import small_side
from cohortile.functions.special import norm_cdf
from cohortile.functions.text import recode
from cohortile.operators import ranks
from cohortile.operators.cohort import with_levels
from cohortile.operators.explore import block_products
from cohortile.operators.matrix import per_feature, with_complete_samples
from cohortile.session import stored


def select_sets(catalogue: DataFrame, category: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    out = catalogue
    if category is not None:
        out = out.filter(F.col("category") == category)
    if names is not None:
        out = out.filter(F.col("gs_name").isin(list(names)))
    return out


def map_sets(sets: DataFrame, features: DataFrame, *, feature: str = "feature", min_size: int = 1,
             max_size: int | None = None) -> DataFrame:
    """(gs_name, feature, set_size) of sets whose size among the present features is in range; no upper limit unless given."""
    present = sets.select("gs_name", feature).distinct().join(features.select(feature).distinct(), feature, "left_semi")
    sizes = present.groupBy("gs_name").agg(F.count(F.lit(1)).alias("set_size")).filter(F.col("set_size") >= min_size)
    if max_size is not None:
        sizes = sizes.filter(F.col("set_size") <= max_size)
    return present.join(small_side(sizes), "gs_name").select("gs_name", feature, "set_size")


def ssgsea(scores: DataFrame, mapped: DataFrame, *, alpha: float = 0.25, normalise: bool = True,
           feature: str = "feature", sample: str = "sample", value: str = "value",
           max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Single-sample enrichment in closed form, so no walk over all features is made.

    With features ordered by (value desc, feature), o = N + 1 - position and r = floor of
    the ascending mean rank: ES = sum(r^a o) / sum(r^a) - (N(N+1)/2 - sum(o)) / (N - k), sums
    over set members. Scores are divided by each set's range over samples when normalised.
    """
    known = scores.filter(F.col(value).isNotNull())
    placed = ranks.with_position_and_rank(known, [sample], value, feature, "_p", "_r", max_rows=max_rows, rows_per_task=rows_per_task)
    totals = small_side(known.groupBy(sample).agg(F.count(F.lit(1)).alias("_n")))
    members = placed.select(sample, feature, "_r", "_p").join(mapped.select("gs_name", feature), feature)
    n, o = F.col("_n"), F.col("_n") + 1 - F.col("_p")
    weight = F.pow(F.floor("_r").cast("double"), F.lit(alpha))
    sums = members.join(totals, sample).groupBy(sample, "gs_name").agg(
        F.max("_n").alias("_n"), F.count(F.lit(1)).alias("k"), F.sum(weight).alias("_w"),
        F.sum(weight * o).alias("_wo"), F.sum(o).alias("_o"),
    )
    outside = F.try_divide(n.cast("double") * (n + 1) / 2.0 - F.col("_o"), F.nullif((n - F.col("k")).cast("double"), F.lit(0.0)))
    es = sums.select(sample, "gs_name", (F.col("_wo") / F.col("_w") - outside).alias("es"))
    return normalise_by_range(es) if normalise else es


def normalise_by_range(scores: DataFrame, score: str = "es", by: Sequence[str] = ("gs_name",)) -> DataFrame:
    """Score over (max - min) of its set; NULL when the set's scores are all equal. One row per sample and set."""
    w = Window.partitionBy(*by)
    span = F.nullif(F.max(score).over(w) - F.min(score).over(w), F.lit(0.0))
    return scores.withColumn("score", F.try_divide(F.col(score), span))


NODES, REACH = 13, 7.0  # points of a cell's polynomial, and bandwidths beyond which a sample counts 0 or 1


def kernel_means(x: np.ndarray, h: float) -> np.ndarray:
    """Mean over k of the normal CDF at (x_i - x_k) / h, for every i, to about 1e-11.

    Few values are compared with each other. Many are cut into cells one bandwidth wide: within a cell the
    mean is a polynomial through NODES Chebyshev points, off by less than 1e-11 since the normal CDF is entire
    (on the ellipse with sum of half-axes 5 around a cell it stays below 30), and a point looks only at the sorted
    values within REACH bandwidths. So the work grows with the occupied cells times the values, not with their square.
    """
    cell = np.floor((x - x.min()) / h).astype(np.int64)
    cells, of = np.unique(cell, return_inverse=True)
    if len(x) <= 2 * NODES * len(cells):
        step = max(1, 4_000_000 // max(1, x.size))
        return np.concatenate([norm_cdf((x[i:i + step, None] - x[None, :]) / h).mean(axis=1) for i in range(0, x.size, step)])
    points = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
    signs = np.where(np.arange(NODES) % 2, -1.0, 1.0) * np.sin((np.arange(NODES) + 0.5) * np.pi / NODES)  # barycentric weights
    ordered = np.sort(x)
    middle = x.min() + (cells + 0.5) * h
    lo, hi = np.searchsorted(ordered, middle - (REACH + 0.5) * h), np.searchsorted(ordered, middle + (REACH + 0.5) * h)
    by = np.argsort(of, kind="stable")
    first = np.searchsorted(of[by], np.arange(len(cells) + 1))
    out = np.empty(len(x))
    for c in range(len(cells)):
        at = middle[c] + points * h / 2
        near = ordered[lo[c]:hi[c]]
        step = max(1, 4_000_000 // NODES)
        total = sum(norm_cdf((at[:, None] - near[None, i:i + step]) / h).sum(axis=1) for i in range(0, len(near), step))
        mine = by[first[c]:first[c + 1]]
        gap = (x[mine] - middle[c])[:, None] / (h / 2) - points[None, :]
        share = signs / np.where(gap == 0, 1e-300, gap)
        out[mine] = (lo[c] + (share @ total) / share.sum(axis=1)) / len(x)
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def _kernel_cdf(v: pd.Series) -> pd.Series:
    """Mean normal CDF of each value against all values of its feature, bandwidth sd / 4."""
    rows = [np.asarray(row, float) for row in v]
    return pd.Series([kernel_means(x, x.std(ddof=1) / 4) for x in rows])


def kernel_cdf(expr: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """(feature, sample, f): Gaussian kernel CDF per feature; constant features drop out.

    Each feature is one array, so nothing is multiplied as rows; see ``kernel_means`` for wide cohorts. Needs a dense matrix.
    """
    packed = expr.groupBy(feature).agg(
        F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(value).cast("double").alias("x")))).alias("_c"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
    ).filter("_lo < _hi")
    scored = packed.select(feature, F.col("_c.s").alias("_s"), _kernel_cdf("_c.x").alias("_f"))
    pairs = F.explode(F.arrays_zip("_s", "_f"))
    return scored.select(feature, pairs.alias("_z")).select(feature, F.col("_z._s").alias(sample), F.col("_z._f").alias("f"))


def max_deviation(density: DataFrame, mapped: DataFrame, *, feature: str = "feature", sample: str = "sample",
                  value: str = "f", max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Extreme of the random walk with the larger absolute value, from set members only.

    Between two members the walk only falls, so its extremes lie at or just before a member.
    Weight at position p is |N/2 - p + 1|; on a tie of the two extremes the negative one wins.
    The score is NULL when the members' weights are all 0 or no feature lies outside the set.
    """
    placed = ranks.with_position(density, [sample], [F.col(value).desc(), F.col(feature)], "_p",
                                 max_rows=max_rows, rows_per_task=rows_per_task)
    totals = small_side(density.groupBy(sample).agg(F.count(F.lit(1)).alias("_n")))
    hits = placed.select(sample, feature, "_p").join(mapped.select("gs_name", feature), feature).join(totals, sample)
    w = F.abs(F.col("_n") - F.col("_p") + 1 - F.col("_n") / 2.0)
    group = Window.partitionBy(sample, "gs_name")
    order = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    walk = hits.withColumn("_w", w).select(
        sample, "gs_name", "_p", "_n", "_w", F.row_number().over(group.orderBy("_p")).alias("_j"),
        F.sum("_w").over(order).alias("_cum"), F.sum("_w").over(group).alias("_all"), F.count(F.lit(1)).over(group).alias("_k"),
    )
    miss = F.try_divide((F.col("_p") - F.col("_j")).cast("double"), F.nullif((F.col("_n") - F.col("_k")).cast("double"), F.lit(0.0)))
    at = F.try_divide(F.col("_cum"), F.nullif(F.col("_all"), F.lit(0.0))) - miss
    before = F.try_divide(F.col("_cum") - F.col("_w"), F.nullif(F.col("_all"), F.lit(0.0))) - miss
    ends = walk.groupBy(sample, "gs_name").agg(
        F.greatest(F.lit(0.0), F.max(at)).alias("_up"), F.least(F.lit(0.0), F.min(before)).alias("_down"),
        (F.max(F.when(F.col("_all") > 0, miss))).alias("_ok"))
    es = F.when(F.col("_up") > -F.col("_down"), F.col("_up")).otherwise(F.col("_down"))
    return ends.select(sample, "gs_name", F.when(F.col("_ok").isNotNull(), es).alias("es"))


def gsva(expr: DataFrame, mapped: DataFrame, **kw) -> DataFrame:
    """Kernel CDF per feature, then the maximum deviation per sample and set."""
    return max_deviation(kernel_cdf(expr), mapped, **kw)


def scores_by_group(scores: DataFrame, samples: DataFrame, cases: Sequence[tuple[str, str]], default: str,
                    levels: Sequence[tuple[str, str]], sample: str = "sample", group: str = "grp") -> DataFrame:
    """Scores with a recoded, ordered group."""
    typed = scores.join(small_side(samples.select(sample, group)), sample)
    return with_levels(typed.withColumn("type", recode(group, cases, default)), "type", levels, "type")


def top_markers(markers: DataFrame, features: DataFrame, k: int = 50, *, cell_type: str = "cell_type",
                feature: str = "feature", order: str = "ord") -> DataFrame:
    """First k markers per cell type that are present in the data.

    Only k rows per type survive each task before the shuffle (window group limit).
    """
    present = markers.join(features.select(feature).distinct(), feature, "left_semi")
    rank = F.row_number().over(Window.partitionBy(cell_type).orderBy(order, feature))
    return present.withColumn("rank", rank).filter(F.col("rank") <= k).select(cell_type, feature, "rank")


def marker_svd(expr: DataFrame, samples: DataFrame, markers: DataFrame, k: int = 50, *, cell_type: str = "cell_type",
               feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """Cell-type score of each sample: first right singular vector of the scaled top-k marker rows.

    The vector is reached from the other side: the products of a type's marker rows are a k x k matrix, summed
    over samples in blocks, and its leading vector u gives a sample's score as u . x / sigma. So no task holds an
    array of all samples. The sign makes the loadings u sum to >= 0.
    """
    top = small_side(top_markers(markers, expr, k, cell_type=cell_type, feature=feature))
    chosen = with_complete_samples(expr.join(top.select(feature).distinct(), feature, "left_semi"), samples, feature, sample, value)
    scaled = per_feature(chosen, feature, scale=True, value=value, out=value).filter(F.col(value).isNotNull())
    cells = F.array_sort(F.collect_list(F.struct("rank", value)))
    arrays = stored(scaled.join(top, feature).groupBy(cell_type, sample).agg(cells.alias("_c"))
                    .select(cell_type, sample, F.col(f"_c.{value}").alias("v")), "markers")

    def loadings(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        m = np.zeros((n, n))
        m[pdf["i"], pdf["j"]] = m[pdf["j"], pdf["i"]] = pdf["total"]
        size, vec = np.linalg.eigh(m)
        u = vec[:, -1] * (-1.0 if vec[:, -1].sum() < 0 else 1.0)
        return pd.DataFrame({cell_type: [pdf[cell_type].iloc[0]], "u": [list(u / np.sqrt(size[-1]))]})

    kind = markers.schema[cell_type].dataType.simpleString()
    products = block_products(arrays, "v", by=[cell_type])  # at most k x k rows a type
    fitted = products.groupBy(cell_type).applyInPandas(loadings, f"{cell_type} {kind}, u array<double>")
    score = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return arrays.join(small_side(fitted), cell_type).select(sample, cell_type, score.alias("score"))
