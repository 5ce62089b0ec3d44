"""Alignment of two tokenizers over the bytes of a text, by as-of merges.

Both sides' tokens of a batch of documents are laid along the bytes of all their texts in a row, where each document
begins with a token of both sides. A pandas ``merge_asof`` gives every token start the token of the other side that
covers it; the union of both directions is every overlapping pair. Overlapping pairs with equal ends close groups:
within a group no token of one side stays within its bounds alone. Links are all pairs of tokens of one group.

How many documents hold a pair of ids linked is counted over the corpus by Spark, from one row per document
and pair. Those counts go back to the documents' pairs by a broadcast of the most frequent pairs, as many as fit the
broadcast bound, and by shuffle for the rest, which are rare.

Defined results: a text that is null or empty, or that one of the tokenizers does not give back byte by
byte (U+2581 as text, or characters that it changes), has no tokens: zeros and an empty hash. Strings of special tokens
are plain text. Repeated rows and repeated or null ids are documents of their own. Texts are never cut;
the pairs of a long group are made in parts of bounded size. An empty table gives an empty result. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm import vocabularies
from cohortile.llm.common import BROADCAST_BYTES, keyed, least_count, sliced, stored, table

ROW = ["_f", "_r"]
A, B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of text that one merge takes (a longer text is merged alone), and pairs of a group made at a time.
MERGED_BYTES, PAIRS = 2 << 20, 1 << 20


class Sides:
    """Ids and bytes of both tokenizers for the same bytes: a space and the text."""

    def __init__(self, a: str = A, b: str = B):
        self.a, self.b = a, b
        ranks = vocabularies.byte_ranks(a)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.b_bytes = vocabularies.piece_bytes(b)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A of a space and each text, and by B of each text; both empty where the bytes differ."""
        left, right = [], []
        for text, ids in zip(texts, vocabularies.sentences(self.b).encode(texts, num_threads=1)):
            whole = (" " + text).encode("utf-8", "replace")
            own = np.array(vocabularies.plain_ids(self.a, " " + text) if text else [], np.int64)
            # byte-level pieces are the text's own bytes in order, so their number tells whether all are there
            same = len(own) and self.a_size[own].sum() == len(whole) and b"".join(map(self.b_bytes.__getitem__, ids)) == whole
            left.append(own if same else own[:0])
            right.append(np.array(ids if same else [], np.int64))
        return left, right


def _laid(ids: list[np.ndarray], size: np.ndarray) -> pd.DataFrame:
    """A row per token: document, id, and its start and end among the bytes of all documents in a row."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    end = np.cumsum(size[every])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(x) for x in ids]), "id": every, "start": end - size[every], "end": end})


def overlapping(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(i, j) of every token of ``left`` and token of ``right`` that share a byte, by place, in the order of those bytes."""
    one, two = pd.DataFrame({"start": left["start"], "i": np.arange(len(left))}), pd.DataFrame({"start": right["start"], "j": np.arange(len(right))})
    ab = pd.merge_asof(one, two, on="start")
    ba = pd.merge_asof(two, one, on="start")
    ba = ba[left["start"].to_numpy()[ba["i"]] != ba["start"].to_numpy()]  # tokens that start together are there already
    i, j, start = (np.concatenate([ab[c].to_numpy(), ba[c].to_numpy()]) for c in ("i", "j", "start"))
    by = np.argsort(start, kind="stable")
    return pd.DataFrame({"i": i[by], "j": j[by]})


def groups(left: pd.DataFrame, right: pd.DataFrame, pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of every token of both sides, counted over the batch, and the number of groups."""
    a_end, b_end = left["end"].to_numpy()[pairs["i"]], right["end"].to_numpy()[pairs["j"]]
    closing = a_end[a_end == b_end]  # pairs lie in order of bytes
    return (*(np.searchsorted(closing, side["start"].to_numpy(), "right") for side in (left, right)), len(closing))


def _counts(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their times."""
    if not len(key):
        return key, times
    by = np.argsort(key, kind="stable")
    key, times = key[by], times[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(times, first)


def linked(left: pd.DataFrame, right: pd.DataFrame, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, a, b, times): the distinct linked ids of every document and how many links they make."""
    (a_key, a_n), (b_key, b_n) = (_counts((g << 17) | side["id"].to_numpy(), np.ones(len(side), np.int64)) for g, side in ((a_group, left), (b_group, right)))
    if not len(a_key):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc_of = np.zeros(int(a_group[-1]) + 1, np.int64)
    doc_of[a_group] = left["doc"].to_numpy()
    b_first = np.searchsorted(b_key >> 17, np.arange(len(doc_of) + 1))
    partners = np.diff(b_first)[a_key >> 17]  # distinct ids of B for every distinct id of A in its group
    cuts = np.concatenate([[0], np.cumsum(partners)])
    keys, times, lo, total = [], [], 0, int(cuts[-1])
    while lo < total:  # the pairs from lo on, at most PAIRS of them, also amid one id's partners
        at = np.arange(lo, min(lo + PAIRS, total))
        x = np.searchsorted(cuts, at, "right") - 1
        y = b_first[a_key[x] >> 17] + at - cuts[x]
        key = (doc_of[a_key[x] >> 17] << 34) | ((a_key[x] & 0x1FFFF) << 17) | (b_key[y] & 0x1FFFF)
        k, t = _counts(key, a_n[x] * b_n[y])
        keys.append(k)
        times.append(t)
        if len(keys) > 64:
            k, t = _counts(np.concatenate(keys), np.concatenate(times))
            keys, times = [k], [t]
        lo = int(at[-1]) + 1
    key, n = _counts(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0])
    return key >> 34, (key >> 17) & 0x1FFFF, key & 0x1FFFF, n


@functools.cache
def _said(n: int) -> pa.Array:
    """Ids with what follows them: another of their side and group, the other side, the next group."""
    return pa.array([b"%d%c" % (i, sep) for sep in b",|;" for i in range(n)], pa.large_binary())


def digests(left: pd.DataFrame, right: pd.DataFrame, a_group: np.ndarray, b_group: np.ndarray, n_docs: int) -> list[str]:
    """Hash of ``a1,a2|b1;a3|b2,b3`` per document."""
    order = np.concatenate([a_group * 2, b_group * 2 + 1])
    by = np.argsort(order, kind="stable")
    order = order[by]
    mark = 1 + (order & 1)
    mark[:-1] *= order[1:] != order[:-1]
    ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])[by]
    at = np.searchsorted(np.concatenate([left["doc"].to_numpy(), right["doc"].to_numpy()])[by], np.arange(n_docs + 1))
    if not len(ids):
        return [""] * n_docs
    n = int(ids.max()) // 50_000 * 50_000 + 50_000
    _, ends, said = _said(n).take(pa.array(mark * n + ids)).buffers()
    said, ends = memoryview(said), np.frombuffer(ends, np.int64)[at].tolist()
    return [hashlib.sha256(said[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:])]


def _texts(batch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def _linked(a: str, b: str):
    names = ["_f", "_r", "id", "a", "b", "times", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        sides = Sides(a, b)
        for batch in sliced(batches, "text", most=MERGED_BYTES):
            ids = sides.encode(_texts(batch))
            left, right = _laid(ids[0], sides.a_size), _laid(ids[1], sides.b_size)
            a_group, b_group, n = groups(left, right, overlapping(left, right))
            n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
            doc_of = np.zeros(n, np.int64)
            doc_of[a_group] = left["doc"].to_numpy()
            links = np.zeros(batch.num_rows, np.int64)
            np.add.at(links, doc_of, n_a * n_b)
            long = lambda x: pa.array(x, pa.int64())
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in names[:3]), none, none, pa.nulls(batch.num_rows, pa.int64()), long([len(x) for x in ids[0]]),
                long([len(x) for x in ids[1]]), long(np.bincount(doc_of, minlength=batch.num_rows)), long(links),
                pa.array(digests(left, right, a_group, b_group, batch.num_rows), pa.string())], names=names)
            doc, x, y, times = linked(left, right, a_group, b_group)
            for lo in range(0, len(doc), PAIRS):
                part = slice(lo, lo + PAIRS)
                take, size = pa.array(doc[part]), len(doc[part])
                yield pa.RecordBatch.from_arrays([
                    batch.column("_f").take(take), batch.column("_r").take(take), pa.nulls(size, pa.int64()), pa.array(x[part], pa.int32()),
                    pa.array(y[part], pa.int32()), long(times[part]), *(pa.nulls(size, pa.int64()) for _ in range(4)), pa.nulls(size, pa.string())], names=names)

    return run


def _overlaps(a: str, b: str):
    names = ["_f", "_r", "id", "a_place", "b_place", "a", "b", "start", "end", "group"]

    def run(batches):
        sides = Sides(a, b)
        for batch in sliced(batches, "text", most=MERGED_BYTES):
            ids = sides.encode(_texts(batch))
            left, right = _laid(ids[0], sides.a_size), _laid(ids[1], sides.b_size)
            pairs = overlapping(left, right)
            if not len(pairs):
                continue
            a_group, _, _ = groups(left, right, pairs)
            one, two = left.iloc[pairs["i"]].reset_index(drop=True), right.iloc[pairs["j"]].reset_index(drop=True)
            doc, group = one["doc"].to_numpy(), a_group[pairs["i"]]
            first = {n: np.searchsorted(x, np.arange(batch.num_rows)) for n, x in (("a", left["doc"]), ("b", right["doc"]), ("pair", doc))}
            origin = np.concatenate([left["start"].to_numpy(), [0]])[first["a"]]
            at_first = np.concatenate([group, [0]])[first["pair"]]
            cols = [pairs["i"] - first["a"][doc], pairs["j"] - first["b"][doc], one["id"], two["id"], np.maximum(one["start"], two["start"]) - origin[doc],
                    np.minimum(one["end"], two["end"]) - origin[doc], group - at_first[doc]]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names[:3]), *(pa.array(np.asarray(c), pa.int64()) for c in cols)], names=names)

    return run


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return keyed(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def overlaps(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", a: str = A, b: str = B) -> DataFrame:
    """A row per overlapping pair of tokens: places, ids, shared bytes of a space and the text, and group."""
    schema = "_f long, _r long, id long, a_place long, b_place long, a long, b long, start long, end long, group long"
    return _rows(docs, text_col, id_col).mapInArrow(_overlaps(a, b), schema)


def aligned(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", a: str = A, b: str = B, most: int = BROADCAST_BYTES) -> DataFrame:
    """(_f, _r, id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    schema = "_f long, _r long, id long, a int, b int, times long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    found = stored(_rows(docs, text_col, id_col).mapInArrow(_linked(a, b), schema), "links")
    links = found.filter("a IS NOT NULL").select(*ROW, "a", "b", "times")
    pairs = stored(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    # one row for every id of A, a bounded vocabulary; the pairs of an id are at most the other vocabulary
    top = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    pairs = stored(pairs.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best")), "counted")
    least = least_count(pairs, "docs", F.lit(64), most)
    hot, rare = pairs.filter(F.col("docs") >= least), pairs.filter(F.col("docs") < least)
    score = lambda x: x.groupBy(*ROW).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    often = score(links.join(F.broadcast(hot), ["a", "b"]))
    seldom = score(links.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(rare, ["a", "b"]))
    none = F.lit(None).cast("long")
    heads = found.filter("a IS NULL").select(*ROW, "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.lit(0).cast("long").alias("n_best"),
                                             F.lit(0).cast("long").alias("count_sum"))
    every = heads
    for part in (often, seldom):
        every = every.unionByName(part.select(*ROW, *(none.alias(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")),
                                              F.lit(None).cast("string").alias("groups_sha256"), "n_best", "count_sum"))
    return every.groupBy(*ROW).agg(*(F.max(c).alias(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), F.sum("n_best").alias("n_best"),
                                   F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
