"""Order statistics over groups of any size.

A window ordered over one group runs in one task. That is fine up to ``ROWS_PER_TASK``
rows, so every function here first checks the largest group (or takes a bound on all rows
the caller can prove); nothing is stored then. Beyond it the input is stored once and the work is cut into
value ranges: quantile cut points become literals of the plan, so a row's range is the same on every
retry; each range is ordered on its own and shifted by the totals of the ranges before it. Tied
values are counted before the shuffle, so one value holding most of the rows is still one row.
Positions need every row in order: they, and mean ranks beside them, are read from one ``RangeLayout``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortile.functions.sizing import null_safe_join, small_side
from cohortile.session import stored

ROWS_PER_TASK = 2_000_000


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the fullest group and of all groups, from partial counts."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return sizes[0] or 0, sizes[1] or 0


def outgrown(df: DataFrame, keys: Sequence[str], max_rows: int | None, rows_per_task: int | None) -> int:
    """0 if one task can hold every group, else the number of ranges to cut the rows into."""
    room = rows_per_task or ROWS_PER_TASK
    if max_rows is not None and max_rows <= room:
        return 0
    fullest, rows = group_sizes(df, keys)
    return ceil(rows / room) + 1 if fullest > room else 0


def laid_out(df: DataFrame, keys: Sequence[str], values: Sequence[str], max_rows: int | None,
             rows_per_task: int | None) -> tuple[DataFrame, list[list[float]]]:
    """The input and, for each of ``values``, the cut points between its ranges; none when a task can hold every group.

    Only where groups outgrow a task is the input stored, once for all its values, so that cut points and
    ranges do not run what made it again.
    """
    parts = outgrown(df, keys, max_rows, rows_per_task)
    if not parts:
        return df, [[] for _ in values]
    df = stored(df, "ranked")
    probs, edges = [i / parts for i in range(1, parts)], []
    for value in values:
        usable = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
        edges.append(sorted({q + 0.0 for q in usable.approxQuantile("v", probs, 0.5 / parts)}))
    return df, edges


def with_range(df: DataFrame, value: str, edges: Sequence[float], out: str = "_range") -> DataFrame:
    """Value range number; NaN goes to the last range, where Spark orders it."""
    splits = [-float("inf"), *edges, float("inf")]
    as_double = df.withColumn("_v", F.col(value).cast("double"))
    binned = Bucketizer(splits=splits, inputCol="_v", outputCol=out, handleInvalid="keep").transform(as_double)
    return binned.withColumn(out, F.col(out).cast("int")).drop("_v")


def cumulate(counts: DataFrame, keys: Sequence[str], value: str, n: str, edges: Sequence[float]) -> DataFrame:
    """Add n_tied, n_below, n_total per key to a table of (keys, value, ..., n) counts.

    Several rows may share a value (one per group label); ties are summed over them.
    """
    keys = list(keys)
    if not edges:
        group = Window.partitionBy(*keys)
        order = group.orderBy(value)
        le = F.sum(n).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        tied = F.sum(n).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        return counts.select("*", tied.alias("n_tied"), (le - tied).alias("n_below"), F.sum(n).over(group).alias("n_total"))
    cut = with_range(counts, value, edges)
    part = [*keys, "_range"]
    order = Window.partitionBy(*part).orderBy(value)
    le = F.sum(n).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum(n).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    local = cut.select("*", tied.alias("n_tied"), (le - tied).alias("_local"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy(*part).agg(F.sum(n).alias("_in"))
        .select(*part, F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_shift"),
                F.sum("_in").over(group).alias("n_total"))
    )
    return (
        null_safe_join(local, small_side(shift), part)  # keys x ranges rows
        .withColumn("n_below", F.col("_local") + F.col("_shift"))
        .drop("_range", "_local", "_shift")
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, *, labels: Sequence[str] = (),
                      max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """(keys, labels, value, n, n_tied, n_below, n_total); labels split the counts, not the order."""
    df, (edges,) = laid_out(df, keys, [value], max_rows, rows_per_task)
    return cumulate(value_counts(df, [*keys, *labels], value), keys, value, "n", edges)


def with_average_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, str], *,
                       max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Mean rank of ties within each key, ascending, for every value: rank column; NULL values get a NULL rank.

    Large inputs are stored once for all values, and each value is ranked from its own counts.
    """
    columns = [*df.columns, *values.values()]
    df, cuts = laid_out(df, keys, list(values), max_rows, rows_per_task)
    for edges, (value, out) in zip(cuts, values.items()):
        if not edges:
            order = Window.partitionBy(*keys).orderBy(value)
            le = F.count(value).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            tied = F.count(value).over(order.rangeBetween(Window.currentRow, Window.currentRow))
            df = df.withColumn(out, F.when(F.col(value).isNotNull(), le - (tied - 1) / 2.0))
            continue
        cum = cumulate(value_counts(df, keys, value), keys, value, "n", edges)
        ranks = cum.select(*keys, value, (F.col("n_below") + (F.col("n_tied") + 1) / 2.0).alias(out))
        df = null_safe_join(df, ranks, [*keys, value], "left")
    return df.select(*columns)


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", **size) -> DataFrame:
    """Mean rank of ties within each key, ascending; NULL values get a NULL rank."""
    return with_average_ranks(df, keys, {value: out}, **size)


class RangeLayout:
    """Rows in the order of (keys, order), stored once in ranges, with the rows that lie before each range.

    The order must tell rows apart, so that one value with very many rows is cut as well. Positions, mean
    ranks and totals per key are all read from this one layout.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence, parts: int):
        self.keys, self.columns = list(keys), df.columns
        key_cols = [F.col(k) for k in self.keys]
        ranged = df.repartitionByRange(parts, *key_cols, *order).sortWithinPartitions(*key_cols, *order)
        rows = stored(ranged.withColumn("_seq", F.monotonically_increasing_id()), "layout").withColumn("_part", F.shiftright("_seq", 33))
        group = Window.partitionBy(*self.keys)
        before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        # one row per key and range it touches: at most ranges + keys rows
        offsets = (
            rows.groupBy(*self.keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .select(*self.keys, "_part", "_first", "_shift", F.sum("_n").over(group).alias("_total"))
        )
        placed = null_safe_join(rows, small_side(offsets), [*self.keys, "_part"])
        pos = F.col("_seq") - F.col("_first") + F.col("_shift") + 1
        self.rows = placed.select(*self.columns, pos.cast("long").alias("_pos"), "_total")

    def positions(self, out: str) -> DataFrame:
        """Every row with its 1-based position within its key."""
        return self.rows.select(*self.columns, F.col("_pos").alias(out))

    def positions_and_ranks(self, value: str, pos: str, rank: str) -> DataFrame:
        """Positions, and the ascending mean rank of ``value``, which the order has descending."""
        runs = self.rows.groupBy(*self.keys, value).agg(
            (F.max("_total") + 1 - (F.min("_pos") + F.max("_pos")) / 2.0).alias(rank))
        return null_safe_join(self.rows, runs, [*self.keys, value]).select(*self.columns, F.col("_pos").alias(pos), rank)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "pos", *,
                  max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """1-based position within each key under a full order (last order column must break ties)."""
    parts = outgrown(df, keys, max_rows, rows_per_task)
    if parts:
        return RangeLayout(df, keys, order, parts).positions(out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def with_position_and_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, pos: str, rank: str, *,
                           max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Position under (value descending, tie) and ascending mean rank of the value, NULL-free, from one order."""
    parts = outgrown(df, keys, max_rows, rows_per_task)
    order = [F.col(value).desc(), F.col(tie)]
    if parts:
        return RangeLayout(df, keys, order, parts).positions_and_ranks(value, pos, rank)
    group = Window.partitionBy(*keys)
    down = group.orderBy(*order)
    ge = F.count(F.lit(1)).over(group.orderBy(F.col(value).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.count(F.lit(1)).over(group.orderBy(F.col(value).desc()).rangeBetween(Window.currentRow, Window.currentRow))
    total = F.count(F.lit(1)).over(group)
    return df.select("*", F.row_number().over(down).cast("long").alias(pos), (total + 1 - ge + (tied - 1) / 2.0).alias(rank))


def with_running_mean(df: DataFrame, order: str, value: str, out: str, *, max_rows: int | None = None,
                      rows_per_task: int | None = None) -> DataFrame:
    """Mean of ``value`` over the rows up to each in ``order``, which tells rows apart."""
    parts = outgrown(df, [], max_rows, rows_per_task)
    up_to = lambda keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if not parts:
        return df.withColumn(out, F.avg(value).over(up_to([])))
    rows = RangeLayout(df, [], [F.col(order)], parts).rows.withColumn("_range", F.floor((F.col("_pos") - 1) / (rows_per_task or ROWS_PER_TASK)))
    rows = stored(rows, "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shift = rows.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_shift"))
    local = rows.withColumn("_local", F.sum(value).over(up_to(["_range"])))
    return local.join(small_side(shift), "_range").select(*df.columns, ((F.col("_local") + F.col("_shift")) / F.col("_pos")).alias(out))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], *,
              max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Exact interpolated quantiles (h = (n-1) p) per key; from cumulative counts when large."""
    df, (edges,) = laid_out(df, keys, [value], max_rows, rows_per_task)
    if not edges:
        picked = [F.percentile(value, F.lit(float(p))).alias(name) for p, name in zip(probs, names)]
        return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *picked)
    return quantiles_of(cumulate(value_counts(df, keys, value), keys, value, "n", edges), keys, value, probs, names)


def quantiles_of(cum: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    aggs, out = [F.max("n_total").alias("n")], []
    for p, name in zip(probs, names):
        h = (F.col("n_total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n_tied"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
        frac = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (frac - F.floor(frac)) * (hi - lo)).alias(name))
    return cum.groupBy(*keys).agg(*aggs).select(*keys, "n", *out)


def bh_adjust(df: DataFrame, p: str = "p_value", by: Sequence[str] = (), out: str = "adj_p", *,
              max_rows: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """False-discovery adjustment within ``by``: least over p' >= p of p' n / rank(p'), at most 1."""
    by = list(by)
    df, (edges,) = laid_out(df, by, [p], max_rows, rows_per_task)
    if not edges:
        group = Window.partitionBy(*by)
        order = group.orderBy(p)
        le = F.count(p).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        raw = df.withColumn("_q", F.col(p) * F.count(p).over(group) / F.nullif(le, F.lit(0)))
        # descending with a growing frame is one pass; an unbounded-following frame is quadratic
        tail = F.min("_q").over(group.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), tail))
        return raw.withColumn(out, adjusted).drop("_q")
    cum = cumulate(value_counts(df, by, p), by, p, "n", edges)
    q = with_range(cum, p, edges).withColumn("_q", F.col(p) * F.col("n_total") / (F.col("n_below") + F.col("n_tied")))
    part = [*by, "_range"]
    down = Window.partitionBy(*part).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    floors = q.groupBy(*part).agg(F.min("_q").alias("_m")).select(*part, F.min("_m").over(later).alias("_later"))
    table = (
        null_safe_join(q.withColumn("_here", F.min("_q").over(down)), small_side(floors), part)
        .select(*by, p, F.least(F.lit(1.0), F.col("_here"), F.col("_later")).alias(out))
    )
    return null_safe_join(df, table, [*by, p], "left").select(*df.columns, out)
