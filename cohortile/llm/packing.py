"""Packing of token pieces into sequences of fixed capacity by exact-complement hashing.

Texts become token ids plus an end id; longer ones are cut into full pieces behind a shorter first
one. Only the counts of the lengths (at most ``capacity`` numbers) reach the driver. There lengths
are taken from the largest down: single lengths, then pairs, then triples whose sums are exactly the
gap are looked up in tables of sums and consumed as often as their counts allow; what finds no exact
complement is filled by best fit. The plan says which run of pieces of a length goes to which run of
sequences, so placing the pieces is a distributed numbering by length and a join to the plan.

Defined results: a null or empty text is one piece holding the end id. Repeated rows are packed
each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortile.llm.common import stored, table, tidy

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k"
_SPACES = re.compile(r"\s\s")


class Encoder:
    """Ids of the tokenizers file ``<vocabulary>.json``, without special tokens added.

    The same vocabulary as ranks gives the same ids several times faster. Its split pattern looks
    ahead only to divide runs of white space, so texts without such runs take the pattern without
    that part. A text that holds a special token's string, which the tokenizers file treats apart,
    goes through that file. Each of the three is opened when a text first needs it.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers

        self.at, self.pattern = {k: public_tokenizers.path(f"{vocabulary}.{k}") for k in ("json", "tiktoken")}, public_tokenizers.PATTERN
        with open(self.at["json"], encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    def _quick(self, pattern: str):
        import tiktoken

        with open(self.at["tiktoken"], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def runs(self):
        return self._quick(self.pattern)

    @functools.cached_property
    def plain(self):
        return self._quick(self.pattern.replace(r"\s+(?!\S)|", ""))

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.at["json"])

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.runs if _SPACES.search(text) else self.plain).encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def _pieces(capacity: int, end_id: int, vocabulary: str):
    names = ["id", "piece", "start", "length", "crc", "place", "task"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, task, seen = Encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode((text or b"").decode("utf-8", "replace")) + end
                n = len(ids) // 4
                first, at = (n - 1) % capacity + 1, 0
                for piece in range(-(-n // capacity)):
                    size = capacity if piece else first
                    rows.append((key, piece, at, size, zlib.crc32(ids[4 * at:4 * (at + size)]), seen[size], task))
                    seen[size] += 1
                    at += size
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("piece", "task") else pa.int64()) for n, c in zip(names, cols)], names=names)

    return run


class _Sums:
    """Which available lengths add up to a gap: one, two or three of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def one(self, gap: int):
        return (gap,) if gap >= 1 and self.counts[gap] else None

    def two(self, gap: int):
        """The pair that can be used most often; a length that is used twice counts half."""
        a = np.arange(1, gap // 2 + 1)
        if not len(a):
            return None
        left, right = self.counts[a], self.counts[gap - a]
        times = np.where(a * 2 == gap, left // 2, np.minimum(left, right))
        i = int(times.argmax())
        return (gap - int(a[i]), int(a[i])) if times[i] else None

    def three(self, gap: int):
        lengths = np.flatnonzero(self.counts[:gap - 1])[::-1] if gap >= 3 else ()
        for c in lengths:
            c = int(c)
            if 3 * c < gap:  # the largest of three is at least a third
                break
            self.counts[c] -= 1
            pair = self.two(gap - c)
            self.counts[c] += 1
            if pair and max(pair) <= c:
                return (c, *pair)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) that use up ``counts``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, out = _Sums(left), []

    def consume(lengths):
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        if times:
            out.append((tuple(lengths), times))
        return times

    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            left[length] -= 1  # one of them is the sequence's own
            more = () if not gap else sums.one(gap) or sums.two(gap) or sums.three(gap)
            if more is None:  # best fit: the largest that fits, then an exact complement of the rest again
                more = []
                while gap:
                    exact = (sums.one(gap) or sums.two(gap) or sums.three(gap)) if more else None
                    fits = np.flatnonzero(left[1:gap + 1])
                    step = exact or ((int(fits[-1]) + 1,) if len(fits) else None)
                    if step is None:
                        break
                    for x in step:
                        left[x] -= 1
                        more.append(x)
                        gap -= x
                for x in more:
                    left[x] += 1
            left[length] += 1
            if not consume((length, *more)):  # lengths repeat more often than they are there
                left[length] -= 1
                out.append(((length,), 1))
    return out


def runs(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first place, end place, first sequence, offset): the plan by runs of places of a length."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, times in made:
        offset = 0
        for x in lengths:
            out.append((x, taken[x], taken[x] + times, sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return out


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID,
         vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    pieces = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        tidy(_pieces(capacity, end_id, vocabulary)), "id long, piece int, start long, length long, crc long, place long, task int"), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    at = spark.createDataFrame(runs(plan(counts, capacity)), "length long, lo long, hi long, first long, offset long")
    numbered = pieces.join(shift, ["length", "task"]).withColumn("place", F.col("place") + F.col("shift"))
    chosen = at.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "first", "offset"))).alias("runs"))
    placed = numbered.join(F.broadcast(chosen), "length").withColumn("run", F.element_at(F.filter("runs", lambda r: r["lo"] <= F.col("place")), -1))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                         (F.col("run.first") + F.col("place") - F.col("run.lo")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
