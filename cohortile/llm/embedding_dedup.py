"""Near duplicates among vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and quantised; a table's bucket is
the tuple of its quantised projections. Vectors that share a bucket in any table are compared by
cosine in double precision. With eight projections of width 2 and 24 tables a pair at cosine 0.93
shares no bucket with a chance of 4 in 10,000, one at 0.96 with 1 in 100,000.

Equal vectors are one class with a count, so copies are compared once. A bucket is cut into blocks
and every pair of its blocks is a task's work, so no bucket has to fit one task; vectors travel as bytes. A pair is counted
in the first table in which it meets, which the keys that travel with a vector tell; per block only
link counts and a spanning forest of its links leave the task, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing; vectors of unequal length do not link. Rows with one id are
rows of their own. A null id is no component's least id unless all its ids are null, and is not
kept. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm.common import joined_small, shuffle_partitions, stored, table
from cohortile.llm.components import components
from cohortile.llm.shingles import mixed

TABLES, PROJECTIONS, WIDTH, LEAST_COSINE, SEED = 24, 8, 2.0, 0.93, 20_011
#: Vectors of a bucket that one task compares with another such block.
BLOCK = 2048


def bucket_keys(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int = SEED) -> np.ndarray:
    """A 64-bit key per row and table of the buckets of normalised ``vectors``."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    directions = rng.standard_normal((vectors.shape[1], tables * projections))
    shifts = rng.uniform(0, width, tables * projections)
    cells = np.floor((vectors @ directions + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, projections)
    key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), cells.shape[:2]).copy()
    for p in range(projections):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, p])
    return key.view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(tables: int, projections: int, width: float):
    """Unit vectors as bytes, and their bucket keys in all tables, as numbers and as bytes."""
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            size, n = np.diff(at), batch.num_rows
            keys, unit = np.zeros((n, tables), np.int64), [b""] * n
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = _unit(values[at[rows][:, None] + np.arange(dim)])
                keys[rows] = bucket_keys(x, tables, projections, width)
                for r, v in zip(rows, x):
                    unit[r] = v.tobytes()
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit, pa.binary()), flat, pa.array([k.tobytes() for k in keys], pa.binary())],
                                             names=["node", "unit", "cells", "keys"])

    return run


def _links(left: dict, right: dict | None, t: int, least: float):
    """(node, links added, least node of its local group) over one pair of blocks; ``right`` None: one block with itself."""
    other = right or left
    cos = left["x"] @ other["x"].T
    fresh = cos >= least
    if right is None:
        fresh = np.triu(fresh, 1)
    if not fresh.any():
        return None
    for u in range(t):  # met before in table u
        fresh &= left["keys"][:, u][:, None] != other["keys"][:, u][None, :]
    if not fresh.any():
        return None
    if right is None:
        fresh = fresh | fresh.T
    node = left["node"] if right is None else np.concatenate([left["node"], right["node"]])
    split = len(left["node"])
    add = fresh.astype(np.int64) @ other["n"]
    if right is not None:
        add = np.concatenate([add, fresh.T.astype(np.int64) @ left["n"]])
    label, big = node.copy(), np.iinfo(np.int64).max
    while True:
        a, b = (label, label) if right is None else (label[:split], label[split:])
        low = np.minimum(a, np.where(fresh, b[None, :], big).min(axis=1))
        new = low if right is None else np.concatenate([low, np.minimum(b, np.where(fresh, low[:, None], big).min(axis=0))])
        if (new == label).all():
            break
        label = new
    some = add > 0
    return node[some], add[some], label[some]


def _compared(least: float, tables: int):
    """Rows come sorted by (bucket, i, j); every run of equal ones is a pair of blocks."""
    place = ("key", "i", "j")

    def side_of(parts: list[dict], side: int | None, size: int) -> dict | None:
        rows = [(p, r) for p in parts for r in np.flatnonzero((p["size"] == size) & (True if side is None else p["side"] == side)).tolist()]
        if not rows:
            return None
        pick = lambda c: [p[c][r] for p, r in rows]
        return {"x": np.frombuffer(b"".join(x.as_py() for x in pick("unit")), float).reshape(len(rows), -1), "node": np.array(pick("node")), "n": np.array(pick("n")),
                "keys": np.frombuffer(b"".join(x.as_py() for x in pick("keys")), np.int64).reshape(len(rows), tables)}

    def settle(parts: list[dict]):
        if sum(len(p["node"]) for p in parts) < 2:
            return
        two, t = parts[0]["i"][0] != parts[0]["j"][0], parts[0]["t"][0]
        for size in np.unique(np.concatenate([p["size"] for p in parts])):  # unequal lengths do not link
            left = side_of(parts, 0 if two else None, size)
            right = side_of(parts, 1, size) if two else None
            if left and (right or not two) and (found := _links(left, right, t, least)):
                yield found

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {f: batch.column(f).to_numpy() for f in (*place, "t", "side", "node", "n", "size")}
            new = np.flatnonzero(np.any([c[k][1:] != c[k][:-1] for k in place], axis=0)) + 1
            done = []
            for lo, hi in zip([0, *new], [*new, batch.num_rows]):
                if held and any(held[-1][k][-1] != c[k][lo] for k in place):
                    done += settle(held)
                    held = []
                held.append({**{k: v[lo:hi] for k, v in c.items()}, "unit": batch.column("unit").slice(lo, hi - lo), "keys": batch.column("keys").slice(lo, hi - lo)})
            yield _batch(done)
        yield _batch(list(settle(held)) if held else [])

    return run


def _batch(done):
    parts = [np.concatenate(x) for x in zip(*done)] if done else [np.array([], np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["node", "add", "root"])


def near_vectors(vectors: DataFrame, vec_col: str = "embedding", label_col: str = "label", id_col: str = "vec_id",
                 least: float = LEAST_COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH,
                 block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    classes = stored(rows.filter("ok").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
                     .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    hashed = stored(classes.select("node", "vec").mapInArrow(_hashed(tables, projections, width), "node long, unit binary, cells array<long>, keys binary"), "vector-keys")
    hashed = classes.select("node", "label", "n", F.size("vec").alias("size")).join(hashed, "node")
    # a bucket is a cell of one label
    cells = hashed.select("*", F.posexplode("cells").alias("t", "cell")).withColumn("key", F.xxhash64("label", "t", "cell"))
    sizes = stored(cells.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1), "bucket-sizes")
    large = stored(sizes.filter(F.col("members") > block).select("key", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "large-buckets")
    placed = cells.join(sizes.select("key"), "key", "left_semi")
    cut = joined_small(placed, large, "key", "left", 16).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = cut.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "t", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "n", "size", "unit", "keys")
    found = stored(pairs.repartition(shuffle_partitions(vectors.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _compared(least, tables), "node long, add long, root long"), "vector-links")
    return _assembled(rows, classes, found)


def _assembled(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    links = found.groupBy("node").agg(F.sum("add").alias("more"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    groups = components(edges).withColumnRenamed("v", "node")
    owned = stored(classes.join(groups.withColumnRenamed("label", "group"), "node", "left").withColumn("group", F.coalesce("group", "node")), "owned")
    least = stored(owned.groupBy("group").agg(F.min("least").alias("component_id")), "least")
    per_class = (owned.join(least, "group").join(links, "node", "left")
                 .select("label", "vec", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    known = rows.filter("ok").join(per_class, ["label", "vec"])
    alone = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.select("id", "n_links", "component_id").unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
