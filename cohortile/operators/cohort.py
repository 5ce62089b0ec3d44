"""Metadata selection, membership, alignment and recoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortile.functions.sizing import small_side
from cohortile.functions.text import after_first, after_last, before_first, make_label, recode, strip_version


def select_cohort(meta: DataFrame, columns: Sequence[str], **equals) -> DataFrame:
    """Distinct rows of ``columns`` where every named column equals its value."""
    keep = meta
    for name, value in equals.items():
        keep = keep.filter(F.col(name) == F.lit(value))
    return keep.select(*columns).distinct()


def keep_members(df: DataFrame, members: DataFrame, key: str, member_key: str | None = None) -> DataFrame:
    """Rows whose key is in the list (NULL matches NULL, as set membership does)."""
    listed = small_side(members.select(F.col(member_key or key).alias("_m")).distinct())
    return df.join(listed, F.col(key).eqNullSafe(F.col("_m")), "left_semi")


def flag_members(df: DataFrame, members: DataFrame, key: str, out: str, member_key: str | None = None) -> DataFrame:
    """Add a boolean: key is in the list. The list is made distinct, so rows do not multiply."""
    listed = small_side(members.select(F.col(member_key or key).alias("_m"), F.lit(True).alias("_hit")).distinct())
    return (
        df.join(listed, F.col(key).eqNullSafe(F.col("_m")), "left")
        .withColumn(out, F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_m", "_hit")
    )


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def blank_nulls(df: DataFrame) -> DataFrame:
    """NULL becomes empty text in every column; columns that are not text become text."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def extend_metadata(meta: DataFrame, extra: DataFrame, key: str, condition: Column, tag: dict[str, str]) -> DataFrame:
    """Add the rows of ``extra`` that belong to known keys, on the columns both tables have; all of them as text without NULLs."""
    added = keep_members(extra, meta, key).filter(condition)
    for name, value in tag.items():
        added = added.withColumn(name, F.lit(value))
    cols = shared_columns(meta, added)
    return blank_nulls(meta.select(*cols).unionByName(added.select(*cols)).distinct())


def parse_labels(df: DataFrame, column: str) -> DataFrame:
    """Text parts of ``<sample>_<type>``: cut at the first and after the last separator."""
    return df.withColumns({
        "sample_part": before_first(column), "type_part": after_first(column), "last_part": after_last(column),
    })


def with_levels(df: DataFrame, column: str, levels: Sequence[tuple[str, str]], out: str = "level") -> DataFrame:
    """Display label and order of a category; ``levels`` lists (value, label) in display order."""
    order = recode(column, [(v, i + 1) for i, (v, _) in enumerate(levels)], None)
    label = recode(column, list(levels), None)
    return df.withColumns({f"{out}_ord": order.cast("int"), f"{out}_label": label})


def align_counts(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """One row: keys in both tables, only on the left, only on the right."""
    a = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(F.col(right_key or key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_matched"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_right_only"),
    )


def guarded(df: DataFrame, counts: DataFrame, bad: Column, says: str) -> DataFrame:
    """``df`` as it is, or an error with the numbers in ``counts`` (one row) if ``bad`` holds of them.

    The check is a branch of the same plan that yields no rows, so it costs no job of its own. It stands in the
    branch's filter and in each of its columns, so it holds whatever is pushed into the branch or pruned from it.
    """
    told = F.concat(F.lit(f"{says}: "), F.concat_ws(", ", *[F.concat(F.col(c).cast("string"), F.lit(f" {c.removeprefix('n_').replace('_', ' ')}")) for c in counts.columns]))
    fails = F.when(bad, F.raise_error(told))
    none = counts.filter(F.coalesce(fails.cast("boolean"), F.lit(False)))
    return df.unionByName(none.select(*[fails.cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def key_problems(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, *, unique_right: bool = False) -> DataFrame:
    """One row: keys that are missing on the right, extra there, and on several rows of the left (or, on demand, of the right)."""
    a = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(F.col(right_key or key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    again = (F.col("l") > 1) | ((F.col("r") > 1) if unique_right else F.lit(False))
    return sides.agg(F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("n_matched"), F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("n_missing"),
                     F.count_if((F.col("l") == 0) & (F.col("r") > 0)).alias("n_extra"), F.count_if(again).alias("n_duplicate"))


def require_aligned(df: DataFrame, left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, *,
                    missing: bool = True, extra: bool = True, duplicate: bool = True, says: str = "keys do not match") -> DataFrame:
    """``df``, which fails with counts if keys of ``left`` and ``right`` do not match in the ways asked for; nothing in common always fails."""
    bad = F.col("n_matched") == 0
    for flag, name in ((missing, "n_missing"), (extra, "n_extra"), (duplicate, "n_duplicate")):
        bad = bad | (F.col(name) > 0) if flag else bad
    return guarded(df, key_problems(left, right, key, right_key), bad, says)


def lookup_with_overrides(df: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Replace ``value`` by the hand-made one where the key has an override."""
    patch = small_side(overrides.select(F.col(key), F.col(value).alias("_patch")))
    return df.join(patch, key, "left").withColumn(value, F.coalesce("_patch", value)).drop("_patch")


def map_ids(df: DataFrame, mapping: DataFrame, id_column: str, symbol: str = "symbol") -> DataFrame:
    """Attach symbols to versioned ids; ids without a symbol drop out, several symbols repeat the row.

    The query fails if no id at all can be mapped.
    """
    named = mapping.filter(F.col(symbol) != "").select(F.col("id"), F.col(symbol)).distinct()
    stripped = df.withColumn("id", strip_version(id_column))
    return require_aligned(stripped.join(named, "id"), stripped.select("id").distinct(), named, "id", missing=False, extra=False, duplicate=False,
                           says="no id could be mapped")


def group_by_mutation(samples: DataFrame, mutated: DataFrame, key: str, type_column: str) -> DataFrame:
    """Full join of samples and mutated list; group is ``<type>_mutated`` or ``<type>_wt``.

    ``in_samples`` is false for listed ids that have no sample row: report these.
    """
    a = samples.withColumn("in_samples", F.lit(True))
    b = mutated.select(key).distinct().withColumn("status", F.lit("mutated"))
    return (
        a.join(b, key, "full")
        .withColumn("status", F.coalesce("status", F.lit("wt")))
        .withColumn("in_samples", F.coalesce("in_samples", F.lit(False)))
        .withColumn("mut_group", make_label(type_column, "status"))
    )
