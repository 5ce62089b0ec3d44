"""Reading, row identity, stored tables and checked broadcasts, shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortile.session import run_dir, ship_package

#: A side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Give Python workers the package, and texts to them in batches of 8 MB where the session has Spark's 64 MB."""
    ship_package(spark)
    if spark.conf.get(ARROW_BYTES) in ("67108864b", "64m", "64MB"):
        spark.conf.set(ARROW_BYTES, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: the lineage ends at files every executor reaches.

    A table of groups is stored before it is joined to their rows: then both sides of the join are plain
    shuffles, and adaptive execution can split the rows of a hot group.
    """
    path = run_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scanned(df: DataFrame) -> DataFrame:
    """``df`` itself if it only filters and projects one scan of files, else stored, so that its rows keep their places."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return df if plan.nodeName() == "LogicalRelation" else stored(df, "rows")


def keyed(df: DataFrame, *cols) -> DataFrame:
    """``cols`` behind a row identity (_f, _r): hash of the file's path and the row's place in that file.

    It tells repeated rows and repeated or null ids apart and is the same in every pass over the
    files. Who takes several passes calls ``scanned`` once before them.
    """
    scan = scanned(df)
    meta = scan.metadataColumn("_metadata")
    return scan.select(F.xxhash64(meta["file_path"]).alias("_f"), meta["row_index"].alias("_r"), *cols)


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Whether the counted rows of a stored table stay below the bound."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def joined_small(df: DataFrame, side: DataFrame, keys, how: str, row_bytes: int) -> DataFrame:
    """Join a stored ``side``: by broadcast if its counted size is below the bound, else by shuffle."""
    return df.join(F.broadcast(side) if fits_broadcast(side, row_bytes) else side, keys, how)


def least_count(side: DataFrame, count: str, width, most: int = BROADCAST_BYTES) -> int:
    """The least power of two of ``count`` from which the rows of the stored ``side`` take at most ``most`` bytes.

    ``width`` measures a row. A join's hot keys lie above this count and can be broadcast; the keys below
    it are rare. The counts of the powers, at most 64 numbers, reach the driver.
    """
    tiers = side.groupBy(F.floor(F.log2(count)).cast("int").alias("tier")).agg(F.sum(width).alias("bytes")).collect()
    total, least = 0, 63
    for tier, size in sorted(((r["tier"], r["bytes"]) for r in tiers), reverse=True):
        total += size
        if total > most:
            break
        least = tier
    return 1 << least if least < 63 else (1 << 63) - 1


def numbered(df: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """``df`` with its place from 0 in the order of the columns ``order``, which must tell rows apart.

    The rows are laid out by range once and stored; a place is the place in the partition plus the
    rows of the partitions before it, of which there is one number each.
    """
    laid = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()), name)
    part = F.shiftright("_seq", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = stored(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")), f"{name}-parts")
    at = joined_small(laid.withColumn("_part", part), shift, "_part", "inner", 16)
    return at.withColumn(out, F.col("_seq") - F.shiftleft("_part", 33) + F.col("_shift")).drop("_part", "_seq", "_shift")


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of partitions for rows dealt out to Python: stated, so that few bytes but much work are not merged into few tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run):
    """``run`` for ``mapInArrow``; when it ends, the worker gives memory that it no longer uses back to the system.

    Workers live on for the next stage, and an executor's limit counts what they have kept.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def sliced(batches, *columns: str, most: int = 4 << 20):
    """Parts of Arrow batches with about ``most`` bytes in the binary ``columns``; a longer row is a part of its own."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
