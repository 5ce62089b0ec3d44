"""Text layouts for outside tools. A matrix row is one line, built per feature from its own cells.

Lines carry (section, name, line): writing sorts by section and name with a range sort, so
no task numbers or holds all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortile.functions.sizing import small_side
from cohortile.functions.text import plain_number

TAB = "\t"


def _body(expr: DataFrame, order: DataFrame, feature: str, sample: str, value: str, lead: list) -> DataFrame:
    cells = expr.join(small_side(order), sample)
    packed = cells.groupBy(feature).agg(
        F.array_sort(F.collect_list(F.struct("_ord", sample, plain_number(value).alias("t")))).alias("_c"))
    line = F.concat_ws(TAB, F.col(feature), *lead, F.col("_c.t"))
    return packed.select(F.lit(9).alias("section"), F.col(feature).alias("name"), line.alias("line"))


def _ordered_names(order: DataFrame, sample: str):
    return F.array_sort(F.collect_list(F.struct("_ord", sample)))[sample]


def mixture_lines(expr: DataFrame, samples: DataFrame, *, feature: str = "feature", sample: str = "sample",
                  value: str = "value") -> DataFrame:
    """Header ``!Sample_title`` and sample names, then feature and values."""
    order = samples.select(sample).distinct().withColumn("_ord", F.lit(0))
    head = order.agg(F.concat_ws(TAB, F.lit("!Sample_title"), _ordered_names(order, sample)).alias("line"))
    top = head.select(F.lit(1).alias("section"), F.lit("").alias("name"), "line")
    return top.unionByName(_body(expr, order, feature, sample, value, []))


def _two_groups(samples: DataFrame, groups: list[str], sample: str, group: str) -> DataFrame:
    """Samples of the two groups, ordered by group name then sample."""
    picked = samples.filter(F.col(group).isin(groups)).select(sample, group).distinct()
    place = F.when(F.lit(False), F.lit(0))
    for i, g in enumerate(sorted(groups)):
        place = place.when(F.col(group) == g, F.lit(i))
    return picked.withColumn("_ord", place)


def gct_lines(expr: DataFrame, samples: DataFrame, groups: list[str], *, feature: str = "feature",
              sample: str = "sample", group: str = "grp", value: str = "value") -> DataFrame:
    """``#1.2``; sizes; NAME, Description, samples; then feature, ``na``, values."""
    order = _two_groups(samples, groups, sample, group).select(sample, "_ord")
    names = order.agg(_ordered_names(order, sample).alias("names"))
    n_features = expr.agg(F.count_distinct(feature).alias("n")).scalar()
    heads = names.select(F.explode(F.array(
        F.struct(F.lit(1).alias("section"), F.lit("#1.2").alias("line")),
        F.struct(F.lit(2).alias("section"), F.concat_ws(TAB, n_features.cast("string"), F.size("names").cast("string")).alias("line")),
        F.struct(F.lit(3).alias("section"), F.concat_ws(TAB, F.lit("NAME"), F.lit("Description"), F.col("names")).alias("line")),
    )).alias("h")).select("h.section", F.lit("").alias("name"), "h.line")
    return heads.unionByName(_body(expr, order, feature, sample, value, [F.lit("na")]))


def cls_lines(samples: DataFrame, groups: list[str], control: str, treat: str, *, sample: str = "sample",
              group: str = "grp") -> DataFrame:
    """Three lines: counts, class names, one group label per sample in GCT order."""
    order = _two_groups(samples, groups, sample, group)
    labels = order.agg(F.array_sort(F.collect_list(F.struct("_ord", sample, group)))[group].alias("labels"))
    return labels.select(F.explode(F.array(
        F.struct(F.lit(1).alias("section"), F.concat_ws(" ", F.size("labels").cast("string"), F.lit("2"), F.lit("1")).alias("line")),
        F.struct(F.lit(2).alias("section"), F.lit(f"# {control} {treat}").alias("line")),
        F.struct(F.lit(3).alias("section"), F.concat_ws(" ", F.col("labels")).alias("line")),
    )).alias("h")).select("h.section", "h.line")


def write_lines(lines: DataFrame, path: str) -> None:
    order = [c for c in ("section", "name") if c in lines.columns]
    lines.orderBy(*order).select("line").write.text(path)
