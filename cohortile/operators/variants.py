"""Variant tables: class counts, genes of interest, mutated samples, patient-vs-model comparison.

One biospecimen may carry very many variants, so every summary counts or reduces per
biospecimen before it is joined to metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortile.functions.sizing import require_at_most
from cohortile.functions.text import make_label
from cohortile.operators.cohort import flag_members, keep_members

PIVOT_LIMIT = 10_000


def class_counts(variants: DataFrame, meta: DataFrame, klass: str, key: str = "biospecimen",
                 groups: Sequence[str] = ("sample_id", "comp")) -> DataFrame:
    """Variants per (sample, type, class)."""
    per_key = variants.groupBy(key, klass).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.join(meta.distinct(), key).groupBy(*groups, klass).agg(F.sum("_n").alias("n"))


def class_pivot(counts: DataFrame, klass: str, classes: Sequence[str] | None = None,
                groups: Sequence[str] = ("sample_id", "comp")) -> DataFrame:
    """One column per class, NULL where a sample has none."""
    if classes is None:
        found = counts.select(klass).distinct().orderBy(klass).limit(PIVOT_LIMIT + 1).collect()
        require_at_most(len(found), PIVOT_LIMIT, "pivot classes")
        classes = [r[0] for r in found]
    return counts.groupBy(*groups).pivot(klass, list(classes)).agg(F.sum("n"))


def of_interest(variants: DataFrame, genes: DataFrame, meta: DataFrame, columns: Sequence[str],
                symbol: str = "symbol", key: str = "biospecimen") -> DataFrame:
    """Variant rows of listed genes with their sample's metadata.

    Rows themselves are the result, so the join carries them; a crowded biospecimen is
    split over tasks by adaptive skew handling.
    """
    return keep_members(variants, genes, symbol).select(*columns).join(meta.distinct(), key)


def mutated_samples(variants: DataFrame, genes: DataFrame, meta: DataFrame, *, symbol: str = "symbol",
                    change: str = "hgvsp", key: str = "biospecimen", missing: str = ".") -> DataFrame:
    """Distinct samples with a protein change in a listed gene."""
    hit = keep_members(variants.filter(F.col(change) != missing), genes, symbol).select(key).distinct()
    return hit.join(meta.distinct(), key).distinct()


def compare_vaf(variants: DataFrame, meta: DataFrame, genes: DataFrame, *, reference: str = "Solid_Tissue",
                types: Sequence[str], key: str = "biospecimen", missing: str = ".", unknown: str = "Unknown") -> DataFrame:
    """Largest VAF of each variant in the reference arm and in each other type of the same sample.

    All (sample, type) pairs are one plan: variants are reduced to one row per
    (sample, variant) holding the VAF of every type, then spread over the types the sample has.
    Repeated rows of an arm are reduced to their maximum and counted in ``n_rows``.
    """
    # the arms of a sample are those with any variant row, before the change and symbol filters
    arms = meta.select(key, "sample_id", "comp").distinct()
    present = variants.select(key).distinct().join(arms, key).groupBy("sample_id").agg(
        *[F.max(F.col("comp") == t).alias(f"_has_{i}") for i, t in enumerate([reference, *types])])
    per_key = (
        variants.filter((F.col("hgvsp") != missing) & (F.col("symbol") != unknown))
        .groupBy(key, "symbol", "hgvsp").agg(F.max("vaf").alias("vaf"), F.count(F.lit(1)).alias("n"))
    )
    usable = per_key.join(arms, key)
    wide = usable.groupBy("sample_id", "symbol", "hgvsp").agg(
        *[F.max(F.when(F.col("comp") == t, F.col("vaf"))).alias(f"_vaf_{i}") for i, t in enumerate([reference, *types])],
        *[F.sum(F.when(F.col("comp") == t, F.col("n")).otherwise(0)).alias(f"_n_{i}") for i, t in enumerate([reference, *types])],
    )
    pairs = F.array(*[
        F.struct(F.lit(t).alias("type"), F.col(f"_has_{i}").alias("has"), F.col(f"_vaf_{i}").alias("vaf"),
                 F.col(f"_n_{i}").alias("n"))
        for i, t in enumerate(types, 1)
    ])
    spread = (
        wide.join(present.filter("_has_0"), "sample_id")
        .select("sample_id", "symbol", "hgvsp", "_vaf_0", "_n_0", F.explode(pairs).alias("_p"))
        .filter(F.col("_p.has") & (F.col("_vaf_0").isNotNull() | F.col("_p.vaf").isNotNull()))
    )
    flat = spread.select(
        "sample_id", F.col("_p.type").alias("type"), "symbol", make_label("symbol", "hgvsp").alias("variant"),
        F.coalesce("_vaf_0", F.lit(0.0)).alias("vaf_ref"), F.coalesce("_p.vaf", F.lit(0.0)).alias("vaf_type"),
        (F.col("_n_0") + F.col("_p.n")).alias("n_rows"),
    )
    origin = (
        F.when(F.col("vaf_type") == F.col("vaf_ref"), "Common").when(F.col("vaf_type") == 0, reference)
        .when(F.col("vaf_ref") == 0, F.col("type")).otherwise("Common")
    )
    named = flag_members(flat, genes, "symbol", "of_interest")
    return named.withColumn("origin", origin).withColumn(
        "label", F.when(F.col("of_interest"), F.col("variant")).otherwise(""))


def vaf_quadrants(compared: DataFrame, cut: float = 0.1) -> DataFrame:
    """Variants on each side of the cut-off lines, per type; values outside 0..1 are left out as the axes do."""
    inside = F.col("vaf_ref").between(0, 1) & F.col("vaf_type").between(0, 1)
    return compared.filter(inside).groupBy(
        "type", (F.col("vaf_ref") >= cut).alias("ref_high"), (F.col("vaf_type") >= cut).alias("type_high")
    ).agg(F.count(F.lit(1)).alias("n"))
