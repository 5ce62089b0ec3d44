"""Near duplicates by SetSketch registers: banding, joint likelihood estimate, exact check.

A register is the least of exponentially distributed hashes of a set's members, rounded to a power
of ``BASE`` and truncated to a byte. Registers of unions are register maxima, and equal registers
grow likelier with similarity, so bands of them are bucket keys. With six registers a band and 32
bands a pair at similarity 0.8 shares no bucket with a chance of about 1 in 70,000.

Candidates are never all pairs of a bucket. Equal sets are one class. In each round the buckets of
some bands have one centre each, to which their members of other components are compared; after each
round components are joined, and buckets whose members are all in one component are done. What is left after the
rounds is compared block by block, across components only: registers and full sets travel to the block, pairs are confirmed
there, and no more links leave it than join its components. Every candidate first has its similarity
estimated jointly from both registers and both set sizes by maximum likelihood, and those within four
standard errors of the threshold are confirmed on the full sets of both texts.

Defined results: A-Z are lower-cased, words are split at ASCII white space. A null or empty text, or
one without words, has no shingles, links with nothing and is its own component. Rows with one id
are rows of their own; a null id comes after every other. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm.common import joined_small, keyed, scanned, shuffle_partitions, sliced, stored, table, tidy
from cohortile.llm.components import components
from cohortile.llm.shingles import in_chunks, shingle_sets

ROW = ["_f", "_r"]
BASE, ROWS, BANDS = 1.2, 6, 32
REGISTERS = ROWS * BANDS
#: Bands whose buckets have a centre, by round. Few bands come first: after them most of a large group is one
#: component, and the other bands compare only what is not.
STARS = ((0, 2), (2, 8), (8, BANDS), (0, BANDS), (0, BANDS))
#: Sets of a bucket that one task compares with another such block, pairs it holds at a time, and bytes of the block's shingles.
BLOCK, PAIRS = 4096, 50_000
SET_BYTES = 16 << 20
_rng = np.random.default_rng(104_729)
_SALT = _rng.integers(1, 2**64, REGISTERS, dtype=np.uint64)
_FACTOR = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of REGISTERS bytes for every set values[bounds[i]:bounds[i + 1]]; all zero for an empty one."""
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint8)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    least = np.empty((REGISTERS, len(full)), np.uint64)
    starts = bounds[:-1][full]
    for i in range(REGISTERS):
        least[i] = np.minimum.reduceat((values ^ _SALT[i]) * _FACTOR[i], starts)
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    level = np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16))) / math.log(BASE))
    out[full] = np.clip(level, 0, 255).astype(np.uint8).T
    return out


def _p(x, base: float = BASE):
    return -np.log1p(-x * (base - 1) / base) / math.log(base)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sets of known sizes from their registers, row by row."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(na, nb) / np.maximum(na, nb)

    def loss(j):
        up, down = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
        log = lambda x: np.log(np.maximum(x, 1e-12))
        return above * log(up) + below * log(down) + (a.shape[1] - above - below) * log(1 - up - down)

    lo, hi, g = np.zeros(len(u)), top.astype(float), (math.sqrt(5) - 1) / 2
    for _ in range(24):  # the likelihood has one peak
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loss(c) > loss(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def least_estimate(threshold: float) -> float:
    return threshold - 4 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _sketched(k: int):
    names = ["_f", "_r", "id", "n", "digest", "regs"]

    def run(batches):
        for batch in sliced(batches, "text"):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            n, digest, regs = [], [], []
            for a, b in in_chunks(texts):
                values, at = shingle_sets(texts[a:b], k)
                n += np.diff(at).tolist()
                digest += [xxhash.xxh128_digest(values[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])]
                regs += [r.tobytes() for r in registers(values, at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(regs, pa.binary())], names=names)

    return run


def _likely(threshold: float):
    least = least_estimate(threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n) for n in batch.schema.names}
            a, b = (np.frombuffer(b"".join(c[x].to_pylist()), np.uint8).reshape(-1, REGISTERS) for x in ("ra", "rb"))
            keep = estimate(a, b, c["na"].to_numpy().astype(float), c["nb"].to_numpy().astype(float)) >= least
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(k: int, threshold: float):
    percent = round(threshold * 100)

    def run(batches):
        for batch in sliced(batches, "ta", "tb"):
            at: dict = {}
            texts: list = []
            for ids, column in (("a", "ta"), ("b", "tb")):
                for node, text in zip(batch.column(ids).to_pylist(), batch.column(column)):
                    if node not in at:
                        at[node] = len(texts)
                        texts.append(text.as_py() or b"")
            sets = []
            for x, y in in_chunks(texts):
                values, cuts = shingle_sets(texts[x:y], k)
                sets += [values[p:q] for p, q in zip(cuts[:-1], cuts[1:])]
            yes = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = sets[at[a]], sets[at[b]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _sets(k: int):
    def run(batches):
        for batch in sliced(batches, "text"):
            out = []
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for a, b in in_chunks(texts):
                values, at = shingle_sets(texts[a:b], k)
                out += [values[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "shingles"])

    return run


class _Forest:
    """Components of the labels that one task has met."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _across(threshold: float):
    """Rows come sorted by (key, kind, i, j): the links between components within each run, as a spanning forest.

    A pair counts in the first band that it shares, so no other bucket looks at it again. Likely pairs, the likeliest
    first, are confirmed on the full sets here, and only if their components are not linked yet.
    """
    least, percent = least_estimate(threshold), round(threshold * 100)
    place = ("key", "kind", "i", "j")

    def compared(left: dict, right: dict, same: bool):
        """Numbers of the rows of ``left`` and ``right`` that may be linked, by component, size and band, in parts."""
        rows = max(1, PAIRS // max(1, len(right["node"])))
        for lo in range(0, len(left["node"]), rows):
            part = slice(lo, lo + rows)
            ok = left["label"][part][:, None] != right["label"][None, :]
            ok &= np.minimum(left["n"][part][:, None], right["n"]) >= threshold * np.maximum(left["n"][part][:, None], right["n"])
            x, y = np.nonzero(ok)
            x += lo
            if same:
                x, y = x[y > x], y[y > x]
            if len(x):
                agree = (left["regs"][x] == right["regs"][y]).reshape(-1, BANDS, ROWS).all(axis=2)
                first = agree.argmax(axis=1) == left["t"][0]
                x, y = x[first], y[first]
            if len(x):
                close = estimate(left["regs"][x], right["regs"][y], left["n"][x], right["n"][y])
                keep = np.flatnonzero(close >= least)
                keep = keep[np.argsort(-close[keep], kind="stable")]
                yield x[keep], y[keep]

    def run(batches):
        held: list[dict] = []

        def settle():
            run_of = {k: np.concatenate([h[k] for h in held]) for k in held[0] if k != "shingles"}
            sets = [x for h in held for x in h["shingles"]]
            held.clear()
            same = run_of["kind"][0] == 1 and run_of["i"][0] == run_of["j"][0]
            run_of["at"] = np.arange(len(sets))
            left, right = [run_of] * 2 if same else [{k: v[run_of["side"] == s] for k, v in run_of.items()} for s in (0, 1)]
            if not len(left["node"]) or not len(right["node"]):
                return
            forest, links = _Forest(), []
            for x, y in compared(left, right, same):
                for i, j in zip(x.tolist(), y.tolist()):
                    a, b = int(left["label"][i]), int(right["label"][j])
                    if forest.root(a) == forest.root(b):
                        continue
                    one, two = (np.frombuffer(sets[side["at"][r]].as_buffer(), np.uint64) for side, r in ((left, i), (right, j)))
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both and 100 * both >= percent * (len(one) + len(two) - both):
                        forest.join(a, b)
                        links.append((int(left["node"][i]), int(right["node"][j])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy() for n in (*place, "t", "side", "node", "label")}
            c["n"] = batch.column("n").to_numpy().astype(float)
            c["regs"] = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            new = np.flatnonzero(np.any([c[k][1:] != c[k][:-1] for k in place], axis=0)) + 1
            for lo, hi in zip([0, *new], [*new, batch.num_rows]):
                if held and any(held[-1][k][-1] != c[k][lo] for k in place):
                    yield from settle()
                held.append({**{k: v[lo:hi] for k, v in c.items()}, "shingles": [batch.column("shingles")[r] for r in range(lo, hi)]})
        if held:
            yield from settle()

    return run


def _dealt(rest: DataFrame, block: int) -> DataFrame:
    """(key, t, node, label, kind, i, j, side): members of buckets with several components, dealt to pairs of blocks.

    Members of a bucket's largest component (kind 0, side 0) need no look at each other: every block of them meets the
    blocks of the other members (side 1), and those meet each other (kind 1). A block holds about
    ``block`` members or SET_BYTES of shingles.
    """
    by_label = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    most = F.max(F.struct("m", "label", "n")).alias("top")
    mixed = by_label.groupBy("key").agg(most, F.count(F.lit(1)).alias("labels"), F.sum("m").alias("m"), F.sum("n").alias("n")).filter("labels > 1")
    blocks = lambda m, n: F.greatest(F.ceil(m / block), F.ceil(n * 8 / SET_BYTES)).cast("int")
    mixed = stored(mixed.select("key", F.col("top.label").alias("major"), blocks(F.col("top.m"), F.col("top.n")).alias("large"),
                                blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("small")), "mixed")
    major = F.col("label") == F.col("major")
    own = F.pmod(F.xxhash64("node"), F.when(major, F.col("large")).otherwise(F.col("small"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    of_major = F.transform(upto("small"), lambda w: place(0, F.col("own"), w, F.lit(0)))
    with_major = F.transform(upto("large"), lambda w: place(0, w, F.col("own"), F.lit(1)))
    with_others = F.transform(upto("small"), lambda w: place(1, F.least("own", w), F.greatest("own", w), F.col("own") > w))
    rows = rest.join(mixed, "key").withColumn("own", own)
    return rows.select("key", "t", "node", "label", F.explode(F.when(major, of_major).otherwise(F.concat(with_major, with_others))).alias("at")).select(
        "key", "t", "node", "label", "at.*")


class _Linker:
    """Confirms candidate pairs of classes and keeps the components so far."""

    def __init__(self, rows: DataFrame, classes: DataFrame, k: int, threshold: float):
        self.rows, self.classes, self.k, self.threshold = rows, classes, k, threshold
        self.labels: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and registers allow the threshold."""
        one, two = (self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab")
        sized = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") >= self.threshold * F.greatest("na", "nb"))
        return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tidy(_likely(self.threshold)), "a long, b long")

    def link(self, pairs: DataFrame) -> bool:
        """Confirm ``pairs`` (stored) on full sets and join what they link; False if nothing was linked."""
        need = stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
                      .join(self.classes.select("node", *ROW), "node"), "needed")
        texts = stored(joined_small(self.rows, need, ROW, "inner", 24).select("node", "text"), "texts")
        one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        links = stored(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(
            tidy(_confirmed(self.k, self.threshold)), "a long, b long"), "links")
        if links.isEmpty():
            return False
        self.labels = components(links, self.labels)
        return True

    def labelled(self, nodes: DataFrame) -> DataFrame:
        if self.labels is None:
            return nodes.withColumn("label", F.col("node"))
        return nodes.join(self.labels.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, threshold: float = 0.8,
                block: int = BLOCK, stars: tuple = STARS) -> DataFrame:
    """(_f, _r, doc_id, n_shingles, component_id, first) per row; ``first`` marks one row of every component."""
    spark = docs.sparkSession
    rows = keyed(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    sketches = stored(rows.mapInArrow(tidy(_sketched(k)), "_f long, _r long, id long, n long, digest binary, regs binary"), "sketches")
    by_id = F.struct(F.col("id").isNull().alias("none"), "id", *ROW)
    classes = stored(sketches.filter("n > 0").groupBy("digest").agg(F.min(by_id).alias("best"), F.first("n").alias("n"), F.first("regs").alias("regs"))
                     .select("digest", "n", "regs", "best", "best._f", "best._r", F.monotonically_increasing_id().alias("node")), "classes")
    band = lambda t: F.xxhash64(t, F.substring("regs", t * ROWS + 1, F.lit(ROWS)))
    bands = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("t", "key"))
    shared = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared-bands")
    members = stored(bands.join(shared, "key"), "bands")
    linker = _Linker(rows, classes, k, threshold)
    for r, (lo, hi) in enumerate(stars):
        if (lo, hi) != (0, BANDS):
            known = stored(linker.labelled(members.filter(F.col("t").between(lo, hi - 1))), "labelled")
        else:  # buckets of two have been compared; those in one component are done
            known = stored(linker.labelled(members.filter("size > 2").drop("label")), "labelled")
            mixed_keys = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
            known = members = stored(known.join(stored(mixed_keys, "mixed"), "key"), "bands")
        order = F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "label")
        centres = stored(known.groupBy("key").agg(F.min(order).alias("c")), "centres")
        offered = known.join(centres, "key").filter(F.col("label") != F.col("c.label")).select(F.col("c.node").alias("a"), F.col("node").alias("b"))
        pairs = stored(linker.likely(offered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "stars")
        linked = not pairs.isEmpty() and linker.link(pairs)
        if (lo, hi) == (0, BANDS) and not linked:
            break
    every = {t for lo, hi in stars for t in range(lo, hi)} == set(range(BANDS))  # then buckets of two are settled
    rest = linker.labelled(members.filter(F.col("size") > (2 if every else 1)).drop("label")).join(classes.select("node", "n"), "node")
    dealt = stored(_dealt(stored(rest, "rest"), block), "dealt")
    if not dealt.isEmpty():
        need = stored(dealt.select("node").distinct().join(classes.select("node", *ROW), "node"), "needed")
        sets = stored(joined_small(rows, need, ROW, "inner", 24).select("node", "text").mapInArrow(tidy(_sets(k)), "node long, shingles binary"), "sets")
        sets = stored(sets.join(classes.select("node", "n", "regs"), "node"), "sets")
        runs = dealt.join(sets, "node").repartition(shuffle_partitions(spark), "key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")
        links = stored(runs.mapInArrow(tidy(_across(threshold)), "a long, b long"), "across")
        if not links.isEmpty():
            linker.labels = components(links, linker.labels)

    grouped = stored(linker.labelled(classes.select("node", "digest", "best")), "grouped")
    comps = stored(grouped.groupBy("label").agg(F.min("best").alias("top")), "tops")
    placed = grouped.join(comps, "label").select("digest", "top")
    found = sketches.filter("n > 0").join(placed, "digest").select(*ROW, "id", "n", F.col("top.id").alias("component_id"),
                                                                   ((F.col("top._f") == F.col("_f")) & (F.col("top._r") == F.col("_r"))).alias("first"))
    alone = sketches.filter("n = 0").select(*ROW, "id", "n", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return found.unionByName(alone).select(*ROW, F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "first")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of every component, with the same columns."""
    docs = scanned(docs)
    lost = stored(near_groups(docs, text_col, id_col, k, threshold).filter(~F.col("first")).select(*ROW), "near-copies")
    return joined_small(keyed(docs, F.struct("*").alias("_row")), lost, ROW, "left_anti", 16).select("_row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
