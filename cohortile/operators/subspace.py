"""Leading components of a long matrix by block subspace iteration.

The matrix X stays as rows (feature, sample, value). The subspace is a table with one short array per sample
and its image under X'X another; an image is two distributed products, samples to features and
back. Only small square matrices (the subspace's own products) reach the driver, so neither samples
nor features are limited in number. Each round finds the best vectors within the subspace, and adds their
residuals to it until those vanish; a subspace that has grown to ``BLOCKS`` blocks shrinks to its best vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortile.functions.sizing import small_side
from cohortile.session import stored

WIDTH, BLOCKS = 32, 3


def _rows(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def times(x: DataFrame, y: DataFrame, on: str, to: str, width: int, value: str = "value") -> DataFrame:
    """(to, y): for every ``to`` the sum of value * y over the rows of ``x``; ``y`` holds an array per ``on``."""
    sums = F.array(*[F.sum(F.col(value) * F.col("y")[c]) for c in range(width)])
    return x.join(y, on).groupBy(to).agg(sums.alias("y"))


def image(x: DataFrame, y: DataFrame, width: int, feature: str, sample: str, value: str) -> DataFrame:
    """X'X y. ``y`` and what it becomes along the features are broadcast only below a measured size."""
    along = small_side(times(x, y, sample, feature, width, value))
    return times(x, along, feature, sample, width, value)


def inner(rows: DataFrame, left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """left' left and left' right over all rows: one small matrix per task, added up by place."""

    def fold(batches):
        acc = None
        for batch in batches:
            if batch.num_rows:
                a = _rows(batch.column(0))
                part = a.T @ np.hstack([a, _rows(batch.column(1))])
                acc = part if acc is None else acc + part
        if acc is not None:
            i, j = np.indices(acc.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(acc.ravel())], names=["i", "j", "x"])

    parts = rows.select(left, right).mapInArrow(fold, "i int, j int, x double")
    got = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # as wide as the subspace
    out = np.zeros((got["i"].max() + 1, got["j"].max() + 1))
    out[got["i"], got["j"]] = got["x"]
    return out[:, :len(out)], out[:, len(out):]


def watched(df: DataFrame, name: str, sums: list) -> tuple[DataFrame, list]:
    """``df``, stored, and aggregates of its rows seen while they are written."""
    seen = Observation()
    held = stored(df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(sums)]), name)
    return held, [seen.get[f"c{i}"] for i in range(len(sums))]


def turned(rows: DataFrame, sample: str, **by) -> DataFrame:
    """(sample, name: sum of column @ matrix) for every name: [(column, matrix), ...]."""
    used = sorted({c for parts in by.values() for c, _ in parts})

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                held = {c: _rows(batch.column(c)) for c in used}
                yield pa.RecordBatch.from_arrays([batch.column(0), *(_lists(sum(held[c] @ m for c, m in parts)) for parts in by.values())], names=[sample, *by])

    key = rows.schema[sample].dataType.simpleString()
    return rows.select(sample, *used).mapInArrow(run, f"{sample} {key}, " + ", ".join(f"{n} array<double>" for n in by))


def _ritz(bb: np.ndarray, bw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values, descending, and coefficients of the best orthonormal vectors within the subspace."""
    size, turn = np.linalg.eigh((bb + bb.T) / 2)
    keep = size > size.max() * 1e-13
    white = turn[:, keep] / np.sqrt(size[keep])
    inside = white.T @ bw @ white
    value, vector = np.linalg.eigh((inside + inside.T) / 2)
    return value[::-1][:width], white @ vector[:, ::-1][:, :width]


def leading_components(x: DataFrame, k: int, *, feature: str = "feature", sample: str = "sample", value: str = "value",
                       width: int = WIDTH, tol: float = 1e-10, max_rounds: int = 300) -> DataFrame:
    """(sample, score): the k leading right singular vectors of ``x`` (stored) times their singular values.

    The largest score by size of a component is positive. Raises if the residuals do not fall below ``tol`` of the largest value.
    """
    width = max(width, k + 2)
    start = F.array(*[F.xxhash64(F.col(sample), F.lit(c)) / F.lit(2.0**63) for c in range(width)])
    block, columns, rows = small_side(x.select(sample).distinct().select(sample, start.alias("y"))), width, None
    for _ in range(max_rounds):
        new = image(x, block, columns, feature, sample, value).withColumnRenamed("y", "w")
        both = block.withColumnRenamed("y", "b").join(new, sample)
        if rows is not None:
            more = both.select(sample, F.col("b").alias("_b"), F.col("w").alias("_w"))
            both = rows.join(more, sample).select(sample, F.concat("b", "_b").alias("b"), F.concat("w", "_w").alias("w"))
        rows = stored(both, "subspace")
        theta, q = _ritz(*inner(rows, "b", "w"), width)
        found = turned(rows, sample, b=[("b", q)], w=[("w", q)], r=[("w", q), ("b", -q * theta)])
        best, rr = watched(found, "best", [F.sum(F.col("r")[c] * F.col("r")[c]) for c in range(q.shape[1])])
        far = np.sqrt(np.maximum(rr, 0.0))
        if far[:k].max() <= tol * max(theta[0], np.finfo(float).tiny):
            break
        moving = far > tol * theta[0] * 1e-2
        block = small_side(turned(best, sample, y=[("r", np.diag(1 / np.where(moving, far, 1.0))[:, moving])]))
        columns = int(moving.sum())
        if q.shape[0] + width > BLOCKS * width:
            rows = best.select(sample, "b", "w")
    else:
        raise ArithmeticError(f"components have not settled after {max_rounds} rounds: the largest residual is {far[:k].max():.3g} of {theta[0]:.3g}")
    scale = np.zeros((len(theta), k))  # a matrix of lower rank has components of 0
    at = np.arange(min(k, len(theta)))
    scale[at, at] = np.sqrt(np.maximum(theta[at], 0.0))
    each = [F.col("score")[c] for c in range(k)]
    scores, ends = watched(turned(best, sample, score=[("b", scale)]), "scores", [F.max_by(c, F.abs(c)) for c in each])
    return turned(scores, sample, score=[("score", np.diag([-1.0 if (e or 0) < 0 else 1.0 for e in ends]))])
