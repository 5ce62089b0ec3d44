"""Set algebra and classes over differential results (label, feature, logfc, adj_p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortile.functions.sizing import with_group_count
from cohortile.functions.text import neg_log10
from cohortile.operators.cohort import flag_members, keep_members


def direction_filter(direction: str, logfc: str = "logfc") -> Column:
    return {"up": F.col(logfc) > 0, "down": F.col(logfc) < 0, "all": F.lit(True)}[direction]


def labelled_members(de: DataFrame, members: DataFrame, feature: str, labels: list[tuple[str, str]],
                     source: str = "contrast") -> DataFrame:
    """Hits in the list, tagged with a display label and its order; ``labels`` is (source value, label)."""
    kept = keep_members(de, members, feature).filter(F.col(source).isin([v for v, _ in labels]))
    tag = F.when(F.lit(False), F.lit(None).cast("string"))
    order = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, (value, label) in enumerate(labels):
        tag = tag.when(F.col(source) == value, F.lit(label))
        order = order.when(F.col(source) == value, F.lit(i))
    return kept.withColumns({"label": tag, "label_ord": order})


def overlap_table(tagged: DataFrame, direction: str, feature: str = "feature") -> DataFrame:
    """Feature, its labels in input order and their number.

    Copies are counted per label first, so the list gathered per feature has one entry
    per label however often a feature repeats.
    """
    per_label = tagged.filter(direction_filter(direction)).groupBy(feature, "label_ord", "label").agg(
        F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct("label_ord", "label", "_n")))
    spread = F.flatten(F.transform(F.col("_e"), lambda e: F.array_repeat(e["label"], e["_n"].cast("int"))))
    return (
        per_label.groupBy(feature).agg(entries.alias("_e"), F.sum("_n").alias("n"))
        .select(feature, F.array_join(spread, ", ").alias("labels"), "n")
    )


def overlap_rows(tagged: DataFrame, feature: str = "feature") -> DataFrame:
    """Every tagged row with the number of rows its feature has."""
    return with_group_count(tagged, [feature], "n").select(feature, "logfc", "label", "n")


def overlap_sizes(tagged: DataFrame, label_a: str, label_b: str, feature: str = "feature") -> DataFrame:
    """Set sizes and shared features, up / down / all, from one membership pass per feature."""
    dirs = F.array(*[F.struct(F.lit(d).alias("direction"), direction_filter(d).alias("on")) for d in ("up", "down", "all")])
    rows = tagged.select(feature, "label", F.explode(dirs).alias("_d")).filter("_d.on")
    per = rows.groupBy(F.col("_d.direction").alias("direction"), feature).agg(
        F.count_if(F.col("label") == label_a).alias("a"), F.count_if(F.col("label") == label_b).alias("b"))
    return per.groupBy("direction").agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("n_ab"),
    )


def side_by_side(a: DataFrame, b: DataFrame, feature: str = "feature", columns=("logfc", "adj_p")) -> DataFrame:
    """Inner join of two result tables on the feature, columns suffixed _x and _y."""
    left = a.select(feature, *[F.col(c).alias(f"{c}_x") for c in columns])
    right = b.select(feature, *[F.col(c).alias(f"{c}_y") for c in columns])
    return left.join(right, feature)


def concordant(a: DataFrame, b: DataFrame, feature: str = "feature", alpha: float = 0.05) -> DataFrame:
    """Features significant in both tables with the same sign."""
    both = side_by_side(a, b, feature).filter((F.col("adj_p_x") < alpha) & (F.col("adj_p_y") < alpha))
    same = ((F.col("logfc_x") > 0) & (F.col("logfc_y") > 0)) | ((F.col("logfc_x") < 0) & (F.col("logfc_y") < 0))
    return both.filter(same).select(feature).distinct()


def classify(de: DataFrame, alpha: float = 0.05, fold: float = 1.0) -> DataFrame:
    sig = F.col("adj_p") < alpha
    side = (
        F.when(F.col("adj_p").isNull() | F.col("logfc").isNull(), F.lit(None))
        .when(sig & (F.col("logfc") > fold), "Up").when(sig & (F.col("logfc") < -fold), "Down").otherwise("Unchanged")
    )
    return de.withColumns({"sig": sig, "de_class": side})


def _in_list(de: DataFrame, members: DataFrame | None, feature: str, only_members: bool) -> DataFrame:
    if members is None:
        return de
    if only_members:
        return keep_members(de, members, feature).withColumn("in_list", F.lit(True))
    return flag_members(de, members, feature, "in_list")


def _with_class_size(df: DataFrame, keys: list[str]) -> DataFrame:
    return with_group_count(df, keys, "freq").withColumn("class_label", F.concat("de_class", F.lit(" (n = "), "freq", F.lit(")")))


def volcano(de: DataFrame, members: DataFrame | None = None, *, only_members: bool = True, feature: str = "feature",
            label: str = "contrast", alpha: float = 0.05, fold: float = 1.0) -> DataFrame:
    """Class, class label with its size and -log10 p, one plot per ``label`` value."""
    classed = classify(_in_list(de, members, feature, only_members), alpha, fold)
    return _with_class_size(classed, [label, "de_class"]).withColumn("neg_log10_p", neg_log10("adj_p"))


def volcano_combined(de: DataFrame, members: DataFrame | None = None, *, only_members: bool = True,
                     feature: str = "feature", label: str = "contrast", alpha: float = 0.05, fold: float = 1.0):
    """As ``volcano`` with features marked Unique or Common over (feature, class, sig)."""
    classed = classify(_in_list(de, members, feature, only_members), alpha, fold)
    counted = with_group_count(classed, [feature, "de_class", "sig"], "n")
    marked = counted.withColumn("genes", F.when(F.col("n") == 1, "Unique").otherwise("Common"))
    return _with_class_size(marked, [label, "de_class"]).withColumn("neg_log10_p", neg_log10("adj_p"))
