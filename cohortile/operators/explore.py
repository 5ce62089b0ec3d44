"""Sample-by-sample products, principal components, distances and annotation.

Features are the long axis and stay distributed: each task folds its features into one block of partial
sums, whose rows are then added up by key, so no pair of samples is ever emitted per feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortile.functions.sizing import small_side
from cohortile.functions.text import after_last, recode
from cohortile.operators import subspace
from cohortile.operators.matrix import per_feature, sample_names, vectors, with_complete_samples
from cohortile.session import stored

SAMPLE_BLOCK = 2_000  # samples per side of one block of sums
TASK_BYTES = 256 << 20  # values that one task of a pair of slices should read
HELD = 8 << 20  # numbers of partial sums that a task holds before it passes them on
FAN = 64  # partial sums of one key that are added in one step; more are added in two


def _arrays(column) -> list[np.ndarray]:
    """Rows of an Arrow list column as numpy arrays."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    return [values[x:y] for x, y in zip(at[:-1], at[1:])]


def _folded(n_keys: int, keys: Sequence[str], same: bool):
    """Sums of outer products of the arrays a and b by the leading columns, a row per row of a block."""

    def rows(key, acc, types):
        n = len(acc)
        cols = [pa.array([k] * n, t) for k, t in zip(key, types)]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * acc.shape[1], pa.int32()), pa.array(acc.ravel()))
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(n), pa.int32()), flat], names=[*keys, "i", "x"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in range(n_keys)]
            places: dict = {}
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(n_keys)))) if n_keys else [(0, ())]:
                places.setdefault(key, []).append(r)
            if not n_keys:
                places[()] = range(batch.num_rows)
            a = _arrays(batch.column("a"))
            b = a if same else _arrays(batch.column("b"))
            for key, at in places.items():
                left = np.stack([a[r] for r in at])
                part = left.T @ (left if same else np.stack([b[r] for r in at]))
                held[key] = part if key not in held else held[key] + part
            if sum(x.size for x in held.values()) > HELD and len(held) > 1:
                for key in list(held):
                    yield rows(key, held.pop(key), types)
        for key, acc in held.items():
            yield rows(key, acc, types)

    return run


def _added(n_keys: int):
    """Arrays of rows with equal leading columns, which come sorted, added up."""

    def run(batches):
        key, acc, names = None, None, None
        for batch in batches:
            names = batch.schema.names
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(n_keys))))
            for now, x in zip(keys, _arrays(batch.column(n_keys))):
                if now == key:
                    acc = acc + x
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_arrays([*(pa.array([k], f.type) for k, f in zip(key, batch.schema)), pa.array([acc])], names=names)
                key, acc, schema = now, x, batch.schema
        if key is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([k], f.type) for k, f in zip(key, schema)), pa.array([acc])], names=names)

    return run


def add_up(rows: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """(keys, x): arrays of equal keys added up; in two steps where many tasks may hold one key."""
    rows = rows.select(*keys, x)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tasks > FAN:
        part = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks) + 1)).alias("_part")
        some = rows.select(*keys, part, x).repartition(*keys, "_part").sortWithinPartitions(*keys, "_part")
        rows = some.mapInArrow(_added(len(keys) + 1), types.replace(f"{x} array", f"_part int, {x} array")).drop("_part")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added(len(keys)), types)


def block_products(df: DataFrame, left: str, right: str | None = None, *, by: Sequence[str] = (),
                   width: int | None = None, block: int = SAMPLE_BLOCK) -> DataFrame:
    """(by, i, j, total): products left_i * right_j summed over the rows of each ``by``.

    ``right=None`` uses ``left`` twice and keeps i <= j. Arrays longer than ``block`` (say so
    by ``width``) are cut into slices; each pair of slices is summed in its own tasks, several
    per pair, so a task never holds more than one block of sums.
    """
    same, by = right is None, list(by)
    rows = df.select(*by, F.col(left).alias("a"), F.col(right or left).alias("b"))
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-2])
    if width is None or width <= block:
        partial = rows.select(*by, "a", *([] if same else ["b"])).mapInArrow(_folded(len(by), by, same), f"{types}i int, x array<double>")
        each = add_up(partial, [*by, "i"]).select(*by, "i", F.posexplode("x").alias("j", "total"))
        return each.filter("i <= j") if same else each
    keys = [*by, "p", "q"]
    partial = _sliced(rows, by, same, width, block).mapInArrow(_folded(len(keys), keys, False), f"{types}p int, q int, i int, x array<double>")
    each = add_up(partial, [*keys, "i"]).select(
        *by, (F.col("p") * block + F.col("i")).alias("i"), "q", F.posexplode("x").alias("j", "total")).withColumn("j", F.col("q") * block + F.col("j")).drop("q")
    return each.filter("i <= j") if same else each


def _sliced(rows: DataFrame, by: list[str], same: bool, width: int, block: int) -> DataFrame:
    """(by, p, q, a, b): slices of the arrays, every pair of them dealt to as many tasks as its values need."""
    cuts = range(-(-width // block))
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in cuts for q in cuts if p <= q or not same])
    salts = max(1, math.ceil(rows.count() * min(width, block) * 16 / TASK_BYTES))
    piece = lambda c, k: F.slice(c, F.col(k) * block + 1, F.lit(block))
    each = rows.select(*by, "a", "b", F.pmod(F.xxhash64("a"), F.lit(salts)).alias("salt"), F.explode(pairs).alias("pq")).select(*by, "pq.p", "pq.q", "salt", "a", "b")
    return each.select(*by, "p", "q", "salt", piece("a", "p").alias("a"), piece("b", "q").alias("b")).repartition(*by, "p", "q", "salt").drop("salt")


def name_pairs(pairs: DataFrame, samples: DataFrame, sample: str = "sample") -> DataFrame:
    named = pairs.withColumn("_n", sample_names(samples, sample))
    return named.select(
        F.element_at("_n", F.col("i") + 1).alias("sample_a"), F.element_at("_n", F.col("j") + 1).alias("sample_b"), "total")


def scaled_features(expr: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Centred and scaled per feature; constant features cannot be scaled and drop out."""
    return per_feature(expr, feature, scale=True, value=value, out=value).filter(F.col(value).isNotNull())


def constant_features(expr: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return expr.groupBy(feature).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo = hi").select(feature)


def count_samples(samples: DataFrame, sample: str = "sample") -> int:
    return samples.select(sample).distinct().count()


def sample_gram(expr: DataFrame, samples: DataFrame, sample: str = "sample", block: int = SAMPLE_BLOCK) -> DataFrame:
    """Inner products of sample profiles over scaled features, i <= j."""
    pairs = block_products(vectors(scaled_features(expr), sample=sample, of=samples), "v", width=count_samples(samples, sample), block=block)
    return name_pairs(pairs, samples, sample)


def sample_distance(expr: DataFrame, samples: DataFrame, sample: str = "sample", feature: str = "feature", value: str = "value",
                    block: int = SAMPLE_BLOCK) -> DataFrame:
    """Euclidean distance of sample profiles, each pair once, from the products of centred values.

    What lies below the rounding of the products counts as 0: a distance is exact to about 1e-7 of the
    profiles' own spread.
    """
    centred = per_feature(expr.withColumn(value, F.col(value).cast("double")), feature, scale=False, value=value, out=value)
    rows = vectors(centred, feature, sample, value, of=samples)
    gram = stored(block_products(rows, "v", width=count_samples(samples, sample), block=block), "products")
    own = gram.filter("i = j")
    a = small_side(own.select("i", F.col("total").alias("aa")))
    b = small_side(own.select("j", F.col("total").alias("bb")))
    both = F.col("aa") + F.col("bb")
    square = both - 2 * F.col("total")
    pairs = gram.join(a, "i").join(b, "j").select("i", "j", F.sqrt(F.when(square > both * 64 * float(np.finfo(float).eps), square).otherwise(0.0)).alias("total"))
    named = name_pairs(pairs, samples, sample).filter("sample_a < sample_b")
    return named.select("sample_a", "sample_b", F.col("total").alias("distance"))


def pca_samples(expr: DataFrame, samples: DataFrame, k: int = 2, sample: str = "sample", feature: str = "feature",
                value: str = "value", width: int = subspace.WIDTH) -> DataFrame:
    """Scores of the samples on the first k components. The largest score by size is positive.

    Every feature must have exactly the samples, once each; constant features drop out. Neither samples nor
    features are limited in number: see ``subspace.leading_components``.
    """
    scaled = scaled_features(with_complete_samples(expr, samples, feature, sample, value), feature, value)
    scores = subspace.leading_components(stored(scaled.select(feature, sample, value), "scaled"), k, feature=feature, sample=sample, value=value, width=width)
    names = [f"pc{c + 1}" for c in range(k)]
    return scores.select(sample, *[F.col("score")[c].alias(name) for c, name in enumerate(names)])


def annotate_samples(df: DataFrame, label: str, cases, default: str) -> DataFrame:
    """Type from the text after the last separator, recoded."""
    return df.withColumn("type", recode(after_last(label), cases, default))
