"""Readers and writers of tables, lists and matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tab-separated text with a declared schema. Compressed files decode by extension."""
    return spark.read.csv(path, sep="\t", header=header, schema=schema, quote="", escape="", nullValue="NA", enforceSchema=True)


def read_gzip_tsv(spark: SparkSession, path: str, schema: str, header: bool = True, parts: int | None = None) -> DataFrame:
    """A gzip file is read by one task; spread its rows before any work is done on them."""
    df = read_tsv(spark, path, schema, header)
    return df.repartition(parts) if parts else df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One value per line, no header."""
    return spark.read.text(path).select(F.col("value").alias(column)).filter(F.length(column) > 0)


def write_tsv(df: DataFrame, path: str, header: bool = True, gzip: bool = False) -> None:
    df.write.csv(path, sep="\t", header=header, quote="", escape="", nullValue="NA", emptyValue="",
                 compression="gzip" if gzip else "none")


def write_list(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def append_version(df: DataFrame, path: str, version: str) -> None:
    """Add one version of a table (the place of a workbook sheet); the same version written again replaces itself."""
    rows = df.withColumn("version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version).drop("version")


def is_complete(spark: SparkSession, path: str) -> bool:
    """A finished write leaves _SUCCESS; a folder without it is not reused."""
    try:
        spark.read.text(f"{path}/_SUCCES[S]")  # as a pattern: a missing file is then no warning
        return True
    except AnalysisException:
        return False


def store(df: DataFrame, path: str, key: str = "feature") -> DataFrame:
    """Write a matrix or table clustered by ``key`` and read it back with its known schema.

    Rows of one feature lie together, so a feature filter skips row groups.
    """
    df.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: str = "feature") -> DataFrame:
    """Stored result if complete, else compute, store and read back."""
    return spark.read.parquet(path) if is_complete(spark, path) else store(build(), path, key)
