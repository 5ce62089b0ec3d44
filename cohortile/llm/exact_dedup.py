"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get one integer name, unequal
blocks different ones; adjacent names are then paired and the pairs named anew, level by level,
until every text is one (level, name). Two texts have the same identity if and only if they are
equal: a 64-bit hash only brings equal blocks together, and blocks that share a hash but differ
get names of their own.

Defined results: a null text is an empty one, and empty texts equal each other. Only A-Z is
lower-cased. Of rows with the same id and text one stays. A null id is below every other. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm.common import joined_small, keyed, scanned, stored, table, tidy

BLOCK_BYTES = 4096
ROW = ["_f", "_r"]


def _cut(size: int):
    schema = pa.schema([("_f", pa.int64()), ("_r", pa.int64()), ("id", pa.int64()), ("sha", pa.binary()),
                        ("blocks", pa.list_(pa.binary()))])

    def run(batches):
        for batch in batches:
            texts = [(t or b"").lower() for t in batch.column("text").to_pylist()]  # bytes: A-Z only
            yield pa.RecordBatch.from_arrays([
                batch.column("_f"), batch.column("_r"), batch.column("id"),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([[t[i:i + size] for i in range(0, len(t), size)] or [b""] for t in texts], schema.field("blocks").type),
            ], schema=schema)

    return run


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """Integer names in the sorted order of each partition; the partition is the upper part of the name."""
    return df.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES,
               handle=F.xxhash64) -> DataFrame:
    """(_f, _r, id, sha, level, name) per row; (level, name) is the text's identity, sha its SHA-256."""
    docs = scanned(docs)
    cut = keyed(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        tidy(_cut(block_bytes)), "_f long, _r long, id long, sha binary, blocks array<binary>")
    rows = stored(cut.select(*ROW, "id", "sha", F.transform("blocks", lambda b: handle(b)).alias("hs")), "block-hashes")

    # every distinct block once per task before the shuffle, then once: (hash, place among blocks of that hash)
    one = cut.select(F.explode("blocks").alias("b")).groupBy(handle("b").alias("h")).agg(F.array_sort(F.collect_set("b")).alias("bs"))
    names = stored(_numbered(
        one.select("h", F.size("bs").alias("same"), F.posexplode("bs").alias("k", "b"))
        .select("h", "same", "k", F.when(F.col("same") > 1, F.col("b")).alias("b")), "h", "k"), "block-names")

    seq = rows.select(*ROW, F.size("hs").alias("n"), F.posexplode("hs").alias("i", "h"))
    now = seq.join(names.filter("same = 1").select("h", "name"), "h").select(*ROW, "n", "i", "name")
    shared = names.filter("same > 1")
    if not shared.isEmpty():  # different blocks under one hash: these are joined by their bytes
        again = (cut.select(*ROW, F.size("blocks").alias("n"), F.posexplode("blocks").alias("i", "b")).withColumn("h", handle("b"))
                 .join(shared.select("h", "b", "name"), ["h", "b"]).select(*ROW, "n", "i", "name"))
        now = now.unionByName(again)
    now = stored(now, "names-0")

    done, level = now.filter("n = 1").select(*ROW, F.lit(0).alias("level"), "name"), 0
    most = rows.agg(F.max(F.size("hs"))).first()[0] or 0
    while most > 1:
        level, most = level + 1, -(-most // 2)
        even = F.col("i") % 2 == 0
        pairs = now.filter("n > 1").groupBy(*ROW, "n", F.expr("i div 2").cast("int").alias("i")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        named = stored(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
        now = stored(pairs.join(named, ["a", "b"]).select(*ROW, F.ceil(F.col("n") / 2).cast("int").alias("n"), "i", "name"), f"names-{level}")
        done = done.unionByName(now.filter("n = 1").select(*ROW, F.lit(level).alias("level"), "name"))
    return rows.select(*ROW, "id", "sha").join(done, ROW)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES,
                handle=F.xxhash64) -> DataFrame:
    """(_f, _r, doc_id, keep_id, group_size, kept, text_sha256); of equal texts the row with the largest id is kept."""
    found = stored(identities(docs, text_col, id_col, block_bytes, handle), "identities")
    groups = stored(found.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", *ROW)).alias("best")), "groups")
    return found.join(groups, ["level", "name"]).select(
        *ROW, F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        ((F.col("best._f") == F.col("_f")) & (F.col("best._r") == F.col("_r"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that exact_dedup does not keep, with the same columns."""
    docs = scanned(docs)
    lost = stored(exact_dedup(docs, text_col, id_col).filter(~F.col("kept")).select(*ROW), "copies")
    return joined_small(keyed(docs, F.struct("*").alias("_row")), lost, ROW, "left_anti", 16).select("_row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop(*ROW)


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
