"""Size checks that stand in front of every explicit broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from cohortile.session import run_dir

#: A side is broadcast only if its measured rows take at most this many bytes.
SIDE_BYTES = 32 << 20


def _width(field) -> Column:
    """Bytes of one value: measured for text, by the number of items for arrays."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, (ArrayType, MapType)):
        return F.coalesce(F.size(col), F.lit(0)) * 16 + 32
    return F.lit(64 if isinstance(field.dataType, StructType) else 8)


def small_side(df: DataFrame, max_bytes: int = SIDE_BYTES) -> DataFrame:
    """``df`` stored once, with a broadcast hint if its measured size is at most ``max_bytes``.

    The size is observed while the side is written, so nothing comes to the driver but two numbers and the
    upstream plan runs once whatever the size. Beyond the bound there is no hint: the stored side is joined by
    shuffle and adaptive execution splits skewed partitions.
    """
    seen = Observation()
    width = F.lit(16)
    for field in df.schema.fields:
        width = width + _width(field)
    path = run_dir(df.sparkSession, "side")
    df.observe(seen, F.sum(width.cast("long")).alias("bytes")).write.parquet(path)
    side = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(side) if (seen.get["bytes"] or 0) <= max_bytes else side


def one_row(df: DataFrame):
    """Column holding the single row of ``df`` as a struct (an uncorrelated scalar subquery)."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def with_group_count(df: DataFrame, keys, out: str) -> DataFrame:
    """Rows of each group on every row, by aggregation and a join back.

    A window would put a whole group in one task; here a large group is only split rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return null_safe_join(df, small_side(counts), keys)


class TooWide(ValueError):
    """A method that needs a sample x sample matrix met more samples than one task can hold."""


def require_at_most(n: int, limit: int, what: str) -> int:
    if n > limit:
        raise TooWide(f"{what}: {n} is above the limit of {limit}")
    return n
