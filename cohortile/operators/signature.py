"""One-class signature: training, scoring and leave-one-out validation.

Training minimises lam/2 |w|^2 - mean(s - ln(1 + e^s)) with s = w.x over the positive samples. One solver serves every
size: Newton steps whose equations are solved by conjugate gradients, so the samples are only ever multiplied
with vectors, never with each other, and a pass over them moves one vector as long as the features.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortile.functions.sizing import small_side
from cohortile.operators import ranks
from cohortile.operators.cohort import keep_members, lookup_with_overrides, map_ids, require_aligned
from cohortile.operators.explore import add_up
from cohortile.session import stored

CHUNK = 1 << 16  # numbers of a vector that move as one row
BLOCK_BYTES = 4 << 20  # values of a block of samples
TILE = 512  # rows on either side of the products that a task holds at once
TOL, STEPS = 1e-10, 100


def _sigmoid(s):
    return 0.5 * (1 + np.tanh(s / 2))


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def conjugate(product: Callable, b: np.ndarray, share: float, limit: int) -> np.ndarray:
    """x with |product(x) - b| at most ``share`` of |b|, for a positive definite product."""
    x, r = np.zeros_like(b), b.copy()
    q, size = r.copy(), r @ r
    for _ in range(limit):
        if np.sqrt(size) <= share * np.linalg.norm(b):
            break
        image = product(q)
        step = size / (q @ image)
        x += step * q
        r -= step * image
        q, size = r + (r @ r) / size * q, r @ r
    return x


def newton(gradient: Callable, curvature: Callable, d: int, tol: float = TOL, max_steps: int = STEPS) -> np.ndarray:
    """Where the gradient vanishes: Newton steps by conjugate gradients, halved until the gradient falls."""
    w = np.zeros(d)
    g = gradient(w)
    bar = tol * max(1.0, np.linalg.norm(g))
    for _ in range(max_steps):
        size = np.linalg.norm(g)
        if size < bar:
            return w
        step, t = conjugate(lambda v: curvature(w, v), -g, max(min(0.1, size), 0.1 * bar / size), 10 * d + 10), 1.0
        while t > 1e-10:
            new = gradient(w + t * step)
            if np.linalg.norm(new) < size:
                break
            t /= 2
        else:
            break
        w, g = w + t * step, new
    if not np.linalg.norm(g) < bar:
        raise ArithmeticError(f"no optimum after at most {max_steps} steps: the gradient's norm is {np.linalg.norm(g):.3g}")
    return w


def training_table(cells: DataFrame, labels: DataFrame, overrides: DataFrame, mapping: DataFrame, *, positive: str,
                   subset: DataFrame | None = None, sample: str = "uid", label: str = "label", value: str = "value") -> DataFrame:
    """(feature, symbol, sample, value, positive): from measured cells (tracking_id, sample, value) to what training takes.

    Labels are looked up by sample and corrected by ``overrides``, also where there was none; a sample without a label is
    background. The version is dropped from ids, and ids without a symbol drop out; an id with several symbols stands for
    each. With ``subset`` (symbol) only its symbols stay, each by its first id.
    """
    samples = cells.select(sample).distinct().join(labels.select(sample, label).dropDuplicates([sample]), sample, "left")
    known = lookup_with_overrides(samples, overrides, sample, label).select(
        F.col(sample).alias("sample"), F.coalesce(F.col(label) == positive, F.lit(False)).alias("positive"))
    ids = map_ids(cells.select("tracking_id").distinct(), mapping, "tracking_id").select("tracking_id", "id", "symbol")
    if subset is not None:
        first = keep_members(ids, subset, "symbol").groupBy("symbol").agg(F.min_by(F.struct("tracking_id", "id"), F.struct("id", "tracking_id")).alias("_t"))
        ids = first.select("_t.tracking_id", "_t.id", "symbol")
    named = ids.select("tracking_id", F.concat_ws("|", "symbol", "tracking_id").alias("feature"), "symbol")
    rows = cells.join(small_side(named), "tracking_id").withColumnRenamed(sample, "sample")
    return rows.join(small_side(known), "sample").select("feature", "symbol", "sample", F.col(value).alias("value"), "positive")


def sample_vectors(train: DataFrame, positive: str, feature: str, sample: str, value: str) -> DataFrame:
    """(sample, positive, v): centred values of every sample in feature order, stored.

    The query fails if a sample does not have every feature exactly once. The means come as one array as long as the
    features, as a model does; samples are only ever grouped, so neither a feature's samples nor their names meet in one place.
    """
    cells = train.withColumn(value, F.col(value).cast("double"))
    means = cells.groupBy(feature).agg(F.avg(value).alias("_mean"))
    centre = means.agg(F.array_sort(F.collect_list(F.struct(feature, "_mean"))).alias("_m")).scalar()
    listed = F.array_sort(F.collect_list(F.struct(feature, value)))
    packed = cells.groupBy(sample, F.col(positive).alias("positive")).agg(listed.alias("_c")).withColumn("_m", centre)
    said = F.concat(F.lit(f"unequal samples: {sample} "), F.coalesce(F.col(sample).cast("string"), F.lit("NULL")), F.lit(" has "), F.size("_c").cast("string"), F.lit(f" {feature} values, "),
                    F.size(F.array_intersect(F.col(f"_c.{feature}"), F.col(f"_m.{feature}"))).cast("string"), F.lit(" of the "),
                    F.size("_m").cast("string"), F.lit(" expected ones"))
    right = F.col(sample).isNotNull() & (F.col(f"_c.{feature}") == F.col(f"_m.{feature}"))
    v = F.zip_with("_c", "_m", lambda c, m: c[value] - m["_mean"])
    return stored(packed.select(sample, "positive", F.when(right, v).otherwise(F.raise_error(said)).alias("v")), "vectors")


def _summed(rows: DataFrame, d: int, part_of: Callable) -> np.ndarray:
    """The d-vectors that ``part_of`` makes of blocks of rows of ``v``, added up."""

    def run(batches):
        acc = np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                acc += part_of(_matrix(batch.column(0)))
        for c in range(0, d, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([acc[c:c + CHUNK]])], names=["c", "x"])

    parts = rows.select("v").mapInArrow(run, "c int, x array<double>").select("c", F.posexplode("x").alias("i", "x"))
    got = parts.groupBy((F.col("c") + F.col("i")).alias("i")).agg(F.sum("x").alias("x")).toArrow()  # d rows
    out = np.zeros(d)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out


def _trained(rows: DataFrame, n: int, d: int, lam: float, tol: float, max_steps: int) -> np.ndarray:
    def gradient(w):
        return lam * w - _summed(rows, d, lambda x: (1 - _sigmoid(x @ w)) @ x) / n

    def curvature(w, v):
        def part_of(x):
            p = _sigmoid(x @ w)
            return (p * (1 - p) * (x @ v)) @ x

        return lam * v + _summed(rows, d, part_of) / n

    return newton(gradient, curvature, d, tol, max_steps)


def _shape(rows: DataFrame) -> tuple[int, int]:
    return rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()


def train_signature(train: DataFrame, positive: str = "positive", *, lam: float = 1.0, feature: str = "feature",
                    sample: str = "sample", value: str = "value", tol: float = TOL, max_steps: int = STEPS) -> DataFrame:
    """(feature, weight) of the one-class logistic model on the positive samples, centred over all samples."""
    rows = sample_vectors(train, positive, feature, sample, value).filter("positive")
    n, d = _shape(rows)
    if not n:
        raise ValueError("no positive sample")
    w = _trained(rows, n, d, lam, tol, max_steps)
    spark = train.sparkSession
    weights = spark.createDataFrame(pa.table({"_pos": np.arange(1, d + 1), "weight": w}), "_pos long, weight double")
    names = ranks.with_position(train.select(feature).distinct(), [], [F.col(feature)], "_pos")
    return names.join(weights, "_pos").select(feature, "weight")


def spearman_scores(expr: DataFrame, signature: DataFrame, *, feature: str = "feature", sample: str = "sample",
                    value: str = "value", weight: str = "weight", max_rows: int | None = None,
                    rows_per_task: int | None = None) -> DataFrame:
    """Spearman correlation of each sample with the signature over common features (complete pairs only).

    Weights are ranked within each sample, so samples with NULL cells use their own pairs. The query fails if a
    feature of the signature is there twice, or if it shares no feature with the matrix.
    """
    names = expr.select(feature).distinct()
    signature = require_aligned(signature.select(feature, weight), signature, names, feature, missing=False, extra=False,
                                says="features of the signature and of the matrix do not match")
    both = expr.join(signature.select(feature, weight), feature).filter(
        F.col(value).isNotNull() & F.col(weight).isNotNull())
    size = {"max_rows": max_rows, "rows_per_task": rows_per_task}
    ranked = ranks.with_average_ranks(both, [sample], {value: "_x", weight: "_y"}, **size)
    return correlate(ranked, [sample], "_x", "_y", "score")


def correlate(df: DataFrame, keys, x: str, y: str, out: str) -> DataFrame:
    """Pearson correlation from sums; NULL when a side is constant."""
    x, y = F.col(x), F.col(y)
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    scale = F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy))
    return s.select(*keys, F.try_divide(cov, scale).alias(out))


def _blocks(rows: DataFrame, n: int, d: int, name: str, size: int, of: Callable = np.asarray) -> DataFrame:
    """(p, ids, x): what ``of`` makes of the vectors v of the ``n`` ``rows`` (id, v), as matrices of about ``size`` bytes, numbered from 0 and stored.

    How many there are follows from the vectors, not from the partitions they come in; pairs of blocks are enough for all cores.
    """
    most = max(1, size // (8 * d))
    parts = max(ceil(n / most), isqrt(rows.sparkSession.sparkContext.defaultParallelism) + 1)
    most += most // 8  # partitions are not quite even

    def run(batches):
        from pyspark import TaskContext

        at, ids, held = TaskContext.get().partitionId() << 32, [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.concatenate(ids)], pa.list_(pa.int64())),
                                               pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block", "ids", "x"])

        for batch in batches:
            x, i = _matrix(batch.column(1)) if batch.num_rows else None, batch.column(0).to_numpy()
            for lo in range(0, batch.num_rows, most):
                if ids and sum(map(len, ids)) + len(i[lo:lo + most]) > most:
                    yield block()
                    at, ids, held = at + 1, [], []
                ids.append(i[lo:lo + most])
                held.append(of(x[lo:lo + most]))
        if ids:
            yield block()

    made = stored(rows.select(F.col("id").cast("long"), "v").repartition(parts).mapInArrow(run, "block long, ids array<long>, x binary"), name)
    number = ranks.with_position(made.select("block"), [], [F.col("block")], "p")  # a row per block
    return stored(made.join(small_side(number), "block").select((F.col("p") - 1).alias("p"), "ids", "x"), name)


def _tiles(n: int, m: int):
    """Slices of n rows and of m rows that pair all of them; those on the diagonal are equal."""
    for i in range(0, n, TILE):
        for j in range(0, m, TILE):
            yield slice(i, i + TILE), slice(j, j + TILE)


def _gradients(same: bool, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For every row of w the sum of (1 - sigmoid) x over the rows of x, without its own where they are the ``same`` vectors."""
    out = np.zeros_like(w)
    for i, j in _tiles(len(w), len(x)):
        p = 1 - _sigmoid(w[i] @ x[j].T)
        if same and i == j:
            np.fill_diagonal(p, 0.0)
        out[i] += p @ x[j]
    return out


def _curvatures(same: bool, w: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For every row of w the curvature over the rows of x times its row of q."""
    out = np.zeros_like(w)
    for i, j in _tiles(len(w), len(x)):
        p = _sigmoid(w[i] @ x[j].T)
        p = p * (1 - p) * (q[i] @ x[j].T)
        if same and i == j:
            np.fill_diagonal(p, 0.0)
        out[i] += p @ x[j]
    return out


class _Blocks:
    """Blocks of vectors that every block of another table meets, pair by pair.

    A pair is a key of a shuffled join, so the blocks never come to the driver, whatever their size.
    """

    def __init__(self, blocks: DataFrame, d: int):
        self.n, self.d = blocks.count(), d
        self.side = blocks.select(F.col("p").alias("_to"), F.col("x").alias("_right"))

    def meet(self, left: DataFrame, n: int, columns: list[str], part_of: Callable) -> DataFrame:
        """(p, _sum): for each of the ``n`` blocks of ``left`` the arrays that ``part_of`` makes of it and each block here, added up.

        ``part_of`` gets whether both are the same block, then ``columns`` of the left one and the vectors here, as flat arrays.
        """
        numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>"))
        dealt = lambda df: df.repartition(n * self.n, "p", "_to")  # noqa: E731  about a pair a task, which gets all its pairs in one batch
        every = dealt(self.side.withColumn("p", numbers(n))).hint("merge")  # a small file would be broadcast
        pairs = dealt(left.select("p", *columns).withColumn("_to", numbers(self.n))).join(every, ["p", "_to"])

        def row(p, x):
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([x])], names=["p", "_sum"])

        def run(batches):
            held: dict = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    p, to = batch.column("p")[r].as_py(), batch.column("_to")[r].as_py()
                    made = part_of(p == to, *(np.frombuffer(batch.column(c)[r].as_buffer(), float) for c in (*columns, "_right")))
                    if p not in held and len(held) > 4:
                        yield from [row(k, held.pop(k)) for k in list(held)]
                    held[p] = held[p] + made if p in held else made
            yield from [row(k, x) for k, x in held.items()]

        return add_up(pairs.select("p", "_to", *columns, "_right").mapInArrow(run, "p long, _sum array<double>"), ["p"], "_sum").hint("merge")


class _Folds:
    """All folds of a leave-one-out training at once: fold f leaves out vector f, and its model is row f of w.

    Models, gradients and search directions lie beside the vectors in blocks of folds. A pass multiplies
    every block of folds with every block of vectors, so no fold x sample table is ever written and a task holds two
    blocks. The folds share the steps of Newton and of the conjugate gradients; a fold that is done stands still.
    """

    def __init__(self, blocks: DataFrame, n: int, d: int, lam: float, start: np.ndarray, bar: float):
        self.vectors, self.n, self.d, self.lam, self.bar = _Blocks(blocks, d), n, d, lam, bar
        w = np.ascontiguousarray(start, float)
        self.state, _ = self.changed(blocks, ["ids"], lambda i: ({"w": np.tile(w, (len(i), 1)), "s": np.zeros((len(i), d))}, 0.0, 0.0))

    def changed(self, table: DataFrame, columns: list[str], update: Callable) -> tuple[DataFrame, tuple[float, float]]:
        """The blocks, stored, with the matrices that ``update`` makes of ``columns``, and the largest of each of its two numbers."""
        d, kept = self.d, ["p", "ids", "x"]
        names = list(update(*(np.zeros(1, np.int64) if c == "ids" else np.zeros((1, d)) for c in columns))[0])

        def given(column, r, name):
            if name == "ids":
                return np.array(column[r].as_py())
            if pa.types.is_list(column.type):
                return np.asarray(column[r].values).reshape(-1, d)
            return np.frombuffer(column[r].as_buffer(), float).reshape(-1, d)

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    made, one, two = update(*(given(batch.column(c), r, c) for c in columns))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in kept), *(pa.array([made[n].tobytes()], pa.binary()) for n in names),
                                                      pa.array([float(one)]), pa.array([float(two)])], names=[*kept, *names, "_one", "_two"])

        seen = Observation()
        types = "p long, ids array<long>, x binary, " + ", ".join(f"{n} binary" for n in names) + ", _one double, _two double"
        new = table.select(*dict.fromkeys([*kept, *columns])).mapInArrow(run, types)
        held = stored(new.observe(seen, F.max("_one").alias("one"), F.max("_two").alias("two")), "folds")
        return held, (seen.get["one"], seen.get["two"])

    def gradient(self, table: DataFrame) -> DataFrame:
        """``table`` and, as the array _sum, the sum of (1 - sigmoid) x over the other vectors at w + s."""
        d = self.d

        def part_of(same, w, s, x):
            return _gradients(same, (w + s).reshape(-1, d), x.reshape(-1, d)).ravel()

        return table.join(self.vectors.meet(table, self.vectors.n, ["w", "s"], part_of), "p")

    def curvature(self, table: DataFrame) -> DataFrame:
        """``table`` and, as the array _sum, the sum of the curvature's products with q at w."""
        d = self.d

        def part_of(same, w, q, x):
            return _curvatures(same, *(m.reshape(-1, d) for m in (w, q, x))).ravel()

        return table.join(self.vectors.meet(table, self.vectors.n, ["w", "q"], part_of), "p")

    def solve(self, max_steps: int) -> DataFrame:
        """(p, ids, x, w) with the model of every fold; raises if a gradient does not vanish."""
        lam, others, bar, limit = self.lam, self.n - 1, self.bar, 10 * self.d + 10
        norm = lambda m: np.sqrt((m * m).sum(axis=1))

        def ready(w, g, s, worse):
            return {"w": w, "g": g, "s": s, "r": -g, "q": -g}, norm(g).max(), worse

        def begin(w, s, total):
            return ready(w, lam * w - total / others, s, 0.0)

        def turn(w, g, s, r, q, total):
            """One step of the conjugate gradients."""
            image = lam * q + total / others
            rr, qi = (r * r).sum(axis=1), (q * image).sum(axis=1)
            t = np.divide(rr, qi, out=np.zeros_like(rr), where=qi > 0)[:, None]
            new = r - t * image
            more = np.divide((new * new).sum(axis=1), rr, out=np.zeros_like(rr), where=rr > 0)[:, None]
            return {"w": w, "g": g, "s": s + t * q, "r": new, "q": new + more * q}, norm(new).max(), 0.0

        def judge(w, g, s, total):
            """Takes the step, or half of it again where the gradient has grown."""
            new = lam * (w + s) - total / others
            worse = (norm(new) > norm(g)) & (norm(new) > bar)
            back = worse[:, None]
            return ready(np.where(back, w, w + s), np.where(back, g, new), np.where(back, s / 2, 0.0), float(worse.any()))

        table, (largest, _) = self.changed(self.gradient(self.state), ["w", "s", "_sum"], begin)
        for _ in range(max_steps):
            if largest < bar:
                return table.select("p", "ids", "x", "w")
            share, left = max(min(0.1, largest), 0.1 * bar / largest), largest
            for _ in range(limit):
                if left <= share * largest:
                    break
                table, (left, _) = self.changed(self.curvature(table), ["w", "g", "s", "r", "q", "_sum"], turn)
            for _ in range(40):
                table, (largest, worse) = self.changed(self.gradient(table), ["w", "g", "s", "_sum"], judge)
                if not worse:
                    break
        raise ArithmeticError(f"a fold has no optimum after {max_steps} steps: the largest gradient is {largest:.3g}")


def double_ranks(x: np.ndarray) -> np.ndarray:
    """Twice the mean rank of every value within its row: whole numbers, so their products are exact."""
    by = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, by, axis=1)
    n, at = x.shape[1], np.arange(x.shape[1])
    new = np.ones(x.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    ends = np.ones(x.shape, bool)
    ends[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(ends, at, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, by, first + last + 2.0, axis=1)
    return out


def _spearman(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of every row of ``a`` with every row of ``b`` (double ranks), to 12 digits; NaN for constant rows."""
    n = a.shape[1]
    va, vb = (n * (m * m).sum(axis=1) - m.sum(axis=1) ** 2 for m in (a, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round((n * (a @ b.T) - np.outer(a.sum(axis=1), b.sum(axis=1))) / np.outer(np.sqrt(va), np.sqrt(vb)), 12)


def _own(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The correlation of every row of ``a`` with the same row of ``b``."""
    return np.concatenate([np.diag(_spearman(a[i], b[i])) for i, j in _tiles(len(a), len(b)) if i == j])


def _below(mine: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many rows of ``b`` correlate less with each row of ``a`` than ``mine`` says."""
    out = np.zeros(len(a))
    for i, j in _tiles(len(a), len(b)):
        out[i] += (mine[i, None] > _spearman(a[i], b[j])).sum(axis=1)
    return out


def leave_one_out(train: DataFrame, positive: str = "positive", *, lam: float = 1.0, feature: str = "feature",
                  sample: str = "sample", value: str = "value", tol: float = TOL, max_steps: int = STEPS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(fold, auc, running_auc): each positive left out, scored against all background samples.

    All folds are trained together from the model of all positives. A fold's model and every sample are ranked over the
    features within their own rows, and blocks of folds meet blocks of background samples; AUC is the share of
    background strictly below the left-out sample.
    """
    rows = sample_vectors(train, positive, feature, sample, value)
    own = rows.filter("positive")
    n, d = _shape(own)
    if n < 2:
        raise ValueError("leave-one-out needs two positive samples")
    start = _trained(own, n, d, lam, tol, max_steps)
    numbered = ranks.with_position(own.select(sample), [], [F.col(sample)], "id")
    folds = _blocks(own.join(numbered, sample).select((F.col("id") - 1).alias("id"), "v"), n, d, "fold-blocks", block_bytes)
    bar = tol * max(1.0, np.linalg.norm(_summed(own, d, lambda x: x.sum(axis=0))) / (2 * n))
    solver = _Folds(folds, n, d, lam, start, bar)
    models = solver.solve(max_steps)
    background = rows.filter(~F.col("positive")).select(F.lit(0).alias("id"), "v")
    others = background.count()
    if not others:
        return models.select(F.explode("ids").cast("int").alias("fold"), F.lit(None).cast("double").alias("auc"), F.lit(None).cast("double").alias("running_auc"))

    def ranked(w, x):
        a = double_ranks(np.round(w, 12))
        return {"a": a, "mine": _own(a, double_ranks(np.round(x, 12)))}, 0.0, 0.0

    def below(_, a, mine, other):
        return _below(mine, a.reshape(-1, d), other.reshape(-1, d))

    left, _ = solver.changed(models, ["w", "x"], ranked)
    against = _blocks(background, others, d, "background-blocks", block_bytes, lambda x: double_ranks(np.round(x, 12)))
    counts = _Blocks(against, d).meet(left, solver.vectors.n, ["a", "mine"], below)
    each = left.select("p", "ids").join(counts, "p").select(F.explode(F.arrays_zip("ids", "_sum")).alias("z"))
    auc = each.select(F.col("z.ids").cast("int").alias("fold"), (F.col("z._sum") / others).alias("auc"))
    return ranks.with_running_mean(auc, "fold", "auc", "running_auc")
