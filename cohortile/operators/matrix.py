"""Feature x sample matrices in long form: (feature, sample, value).

One feature holds at most one row per sample, so grouping by feature is always bounded.
Operators keep rows hashed by feature; chained per-feature steps need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortile.functions.sizing import one_row, small_side
from cohortile.functions.text import after_first, make_label
from cohortile.operators.cohort import require_aligned


def sample_names(samples: DataFrame, sample: str = "sample"):
    """Sorted sample names as one array column (scalar subquery)."""
    return samples.agg(F.array_sort(F.collect_set(sample)).alias("names")).scalar()


def densify(cells: DataFrame, samples: DataFrame, feature: str = "feature", sample: str = "sample",
            value: str = "value", fill: float = 0.0, unique: bool = False) -> DataFrame:
    """Every (feature, sample) of the grid; repeated cells are summed, absent ones filled.

    ``unique`` says that cells do not repeat, which saves the summing shuffle.
    Absent samples are appended inside each feature's own list, so only existing cells
    are shuffled and no feature x sample product is joined.
    """
    known = samples.select(sample).distinct()
    total = cells.join(known, sample, "left_semi")
    if not unique:
        total = total.groupBy(feature, sample).agg(F.sum(value).alias(value))
    held = total.groupBy(feature).agg(F.collect_list(F.struct(sample, value)).alias("_have"))
    gaps = held.select(feature, "_have", F.array_except(sample_names(samples, sample), F.col(f"_have.{sample}")).alias("_absent"))
    blank = F.transform("_absent", lambda s: F.struct(s.alias(sample), F.lit(fill).alias(value)))
    return (
        gaps.select(feature, F.explode(F.concat("_have", blank)).alias("_c"))
        .select(feature, f"_c.{sample}", f"_c.{value}")
    )


def build_matrix(raw: DataFrame, meta: DataFrame, *, key: str = "biospecimen", drop_text: str = "_PAR_",
                 symbol: str = "symbol", missing_ok: bool = True) -> DataFrame:
    """Symbol x label matrix from composite-id rows and selected metadata.

    Keeps features with a positive total over the selected samples, drops ids holding
    ``drop_text``, splits the id at the first '_' and keeps the id with the highest mean
    over all selected samples per symbol (smallest id on a tie): their number is the same for
    every id, so the totals decide, and absent cells count as 0. ``meta`` needs key, sample_id and type columns.

    The query fails, with counts, if a sample has several labels or a label several samples, and, unless
    ``missing_ok``, if a chosen sample has no row in ``raw``. Samples of ``raw`` that were not chosen are left out.
    """
    labels = meta.select(key, make_label("sample_id", F.lower("type")).alias("label")).distinct()
    held = raw.select(F.col(key).alias("_key")).distinct()
    cells = raw.filter(~F.col("gene_id").contains(drop_text)).join(labels, key)
    per_id = (
        cells.groupBy("gene_id").agg(F.sum("value").alias("_total"))
        .filter("_total > 0").withColumn(symbol, after_first("gene_id"))
    )
    best = small_side(best_per_key(per_id, symbol, "gene_id", "_total").select("gene_id", symbol))
    built = cells.join(best, "gene_id").select(symbol, "label", "value")
    aligned = require_aligned(built, labels, held, key, "_key", missing=not missing_ok, extra=False, says="samples of the matrix and of the metadata do not match")
    return require_aligned(aligned, labels, labels.select("label").distinct(), "label", says="labels stand for several samples")


def best_per_key(df: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """Candidate with the highest score per key (smallest candidate on a tie), by partial aggregation."""
    return df.groupBy(key).agg(
        F.min_by(candidate, F.struct((-F.col(score)).alias("s"), F.col(candidate))).alias(candidate),
        F.max(score).alias(score),
    )


def per_feature(df: DataFrame, feature: str, *, scale: bool, value: str = "value", out: str = "value") -> DataFrame:
    """Centre (and scale by the sample sd) within each feature; constant features give NULL when scaled."""
    w = Window.partitionBy(feature)
    centred = F.col(value) - F.avg(value).over(w)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn(out, F.try_divide(centred, F.nullif(sd, F.lit(0.0))) if scale else centred)


def with_complete_samples(expr: DataFrame, samples: DataFrame, feature: str = "feature", sample: str = "sample",
                          value: str = "value") -> DataFrame:
    """``expr`` as it is; a feature that does not have exactly the listed samples, once each, fails the query.

    The counts ride on the windows per feature that the next step needs anyway, so the check is no job of its own.
    """
    whole = samples.select(F.col(sample).alias("_sample")).distinct()
    n = whole.agg(F.count(F.lit(1))).scalar()
    group = Window.partitionBy(feature)
    held = expr.join(small_side(whole), F.col(sample) == F.col("_sample"), "left")
    again = F.when(F.lag(sample).over(group.orderBy(sample)) == F.col(sample), 1).otherwise(0)
    held = held.withColumns({"_again": again, "_rows": F.count(F.lit(1)).over(group), "_known": F.count("_sample").over(group)})
    held = held.withColumn("_again", F.sum("_again").over(group))
    said = F.concat(F.lit(f"unequal samples: {feature} "), F.col(feature).cast("string"), F.lit(" has "), F.col("_rows").cast("string"),
                    F.lit(" sample values, "), (F.col("_known") - F.col("_again")).cast("string"), F.lit(" of the "), n.cast("string"), F.lit(" expected ones"))
    right = (F.col("_rows") == n) & (F.col("_known") == n) & (F.col("_again") == 0)
    return held.withColumn(value, F.when(right, F.col(value)).otherwise(F.raise_error(said))).select(*expr.columns)


def log_zscore(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """log2(x + 1), then z-score per feature."""
    return per_feature(df.withColumn(value, F.log2(F.col(value) + 1)), feature, scale=True, value=value, out=value)


def log_cpm(df: DataFrame, sample: str = "sample", value: str = "value", out: str = "value",
            by: Sequence[str] = ()) -> DataFrame:
    """log2((count + 0.5) / (library size + 1) * 1e6), library size = sample total."""
    sizes = small_side(df.groupBy(*by, sample).agg(F.sum(value).alias("_lib")))
    scaled = F.log2((F.col(value) + 0.5) / (F.col("_lib") + 1) * 1e6)
    return df.join(sizes, [*by, sample]).withColumn(out, scaled).drop("_lib")


def min_max_scale(df: DataFrame, value: str = "value", out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) over the whole table; NULL when all values are equal."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = df.withColumn("_e", one_row(ends))
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    return span.withColumn(out, F.try_divide(F.col(value) - lo, F.nullif(hi - lo, F.lit(0.0)))).drop("_e")


def vectors(df: DataFrame, feature: str = "feature", sample: str = "sample", value: str = "value",
            out: str = "v", keep: Sequence[str] = (), of: DataFrame | None = None) -> DataFrame:
    """One array per feature, values in sample order (needs a dense matrix).

    With ``of``, the table of samples, every feature must have exactly those samples, once each:
    a place in an array then means the same sample in all of them. Otherwise the query fails.
    """
    ordered = F.array_sort(F.collect_list(F.struct(sample, value)))
    packed = df.groupBy(*keep, feature).agg(ordered.alias("_c"))
    if of is None:
        return packed.select(*keep, feature, F.col(f"_c.{value}").alias(out))
    named = packed.withColumn("_names", sample_names(of, sample))
    said = F.concat(F.lit(f"{feature} "), F.col(feature).cast("string"), F.lit(" has "), F.size("_c").cast("string"), F.lit(f" {sample} values, "),
                    F.size(F.array_intersect(F.col(f"_c.{sample}"), F.col("_names"))).cast("string"), F.lit(" of the "),
                    F.size("_names").cast("string"), F.lit(" expected ones"))
    aligned = F.when(F.col(f"_c.{sample}") == F.col("_names"), F.col(f"_c.{value}")).otherwise(F.raise_error(said))
    return named.select(*keep, feature, aligned.alias(out))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value"):
    return df.unpivot(list(ids), list(values), name, value)


def transpose(df: DataFrame, key: str, columns: Sequence[str], key_values: Sequence[str], name: str = "variable"):
    """Swap rows and columns of a narrow wide-form table; ``key_values`` become the columns."""
    long = df.unpivot([key], list(columns), name, "_x")
    return long.groupBy(name).pivot(key, list(key_values)).agg(F.max("_x"))


def distinct_profiles(df: DataFrame, feature: str = "feature", sample: str = "sample", value: str = "value"):
    """Collapse features with identical rows; keeps the smallest name and the number of copies."""
    return (
        vectors(df, feature, sample, value).groupBy("v")
        .agg(F.min(feature).alias(feature), F.count(F.lit(1)).alias("n_copies"))
    )
