"""Ranked lexical search by NRA: sequential impact-sorted reads with score intervals, no random access.

A posting's impact (weight of its term times the saturated count in its document) does not depend on who
asks. The corpus is cut by documents: each task holds the postings of blocks of documents, a list per term
in falling impact. For an item the lists of its terms are read together, largest impact first. A document's
lower bound is the sum of the impacts read; its upper bound adds, for every list where it has not been
seen, the next impact of that list. When no document that was never seen can reach the lowest of the best
lower bounds, reads go on for the remaining candidates alone. Reading ends when every candidate's bounds
have met, so membership, ties and scores are settled; there is no limit on reads or candidates. A task's best so far
are the threshold of its next blocks. The best of the tasks meet in two steps, by parts and then by item.

Counts of documents, of words and of documents per term are Spark aggregates over all texts. Items are searched in
groups whose terms and results take at most ``most`` bytes, so the driver and the tasks hold a bounded
number of terms however many items there are; every group reads the texts anew.

Defined results: a null text has no terms, and an item without terms no rows. Repeated rows and repeated or
null ids are documents, or items, of their own; among equal scores a null id comes last and rows
with one id stand in the order of their files. Texts are never cut. Empty tables give an empty result. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortile.llm.common import keyed, scanned, sliced, stored, table

ROW = ["_f", "_r"]
TOP = 50
#: Bytes of the terms and results of a group of items, and what an item and a term take besides their text.
ITEM_BYTES, PER_ITEM, PER_TERM = 32 << 20, 4096, 64
#: Documents and postings of a block, and postings of the first read; each further read is twice as long.
BLOCK_DOCS, BLOCK_POSTINGS, FIRST_READ = 4096, 1 << 20, 1024
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all that is not ASCII; A-Z count as a-z."""
    return (text or b"").translate(_WORD).split()


def _asked(batches):
    for batch in batches:
        terms = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
        size = [PER_ITEM + sum(len(t) + PER_TERM for t in x) for x in terms]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_f", "_r", "id")), pa.array(terms, pa.list_(pa.binary())), pa.array(size, pa.int64())],
                                         names=["_f", "_r", "id", "terms", "bytes"])


def _postings(numbers):
    """Per document its words and, for the terms in ``numbers`` (a broadcast), their numbers and counts."""
    def run(batches):
        number = numbers.value
        for batch in sliced(batches, "text"):
            keep, n, terms, times = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = terms_of(text)
                if words:
                    found = {number[t]: c for t, c in Counter(words).items() if t in number}
                    keep.append(i)
                    n.append(len(words))
                    terms.append(list(found))
                    times.append(list(found.values()))
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("_f", "_r", "id")), pa.array(n, pa.int64()),
                                              pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                                             names=["_f", "_r", "id", "n", "terms", "times"])

    return run


class Lists:
    """Impact-sorted posting lists of a block of documents; list t is impact[start[t]:start[t + 1]]."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        held = np.flatnonzero(impact > 0)
        by = held[np.lexsort((-impact[held], term[held]))]
        self.doc, self.impact, self.n_docs = doc[by], impact[by], n_docs
        self.start = np.searchsorted(term[by], np.arange(n_terms + 1))

    def together(self, terms: np.ndarray):
        """(document, impact, list) of the postings of ``terms``, largest impact first."""
        lo, hi = self.start[terms], self.start[terms + 1]
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        by = np.argsort(-self.impact[at], kind="stable")
        return self.doc[at[by]], self.impact[at[by]], np.repeat(np.arange(len(terms)), size)[by]


def search(lists: Lists, terms: np.ndarray, top: int = TOP, least: int = 0, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block and their scores: all that may be among the ``top`` and reach ``least``, ties included."""
    doc, impact, of = lists.together(terms)
    lower, k, step = np.zeros(lists.n_docs, np.int64), len(terms), first_read
    seen_doc, seen_of = doc[:0], of[:0]
    candidate = np.ones(lists.n_docs, bool)
    while True:
        np.add.at(lower, doc[:step], impact[:step])
        seen_doc, seen_of = np.concatenate([seen_doc, doc[:step]]), np.concatenate([seen_of, of[:step]])
        doc, impact, of = doc[step:], impact[step:], of[step:]
        step *= 2
        positive = lower[candidate & (lower > 0)]
        bar = max(least, int(np.partition(positive, len(positive) - top)[len(positive) - top]) if len(positive) >= top else 0)
        if not len(doc):
            break
        ahead = np.zeros(k, np.int64)  # the next impact of every list
        np.maximum.at(ahead, of, impact)
        known = np.zeros(lists.n_docs, np.int64)
        np.add.at(known, seen_doc, ahead[seen_of])
        upper = lower + ahead.sum() - known
        candidate &= upper >= bar
        if (lower[candidate] == upper[candidate]).all():
            break
        if ahead.sum() < bar:  # nothing unseen can come in
            left, held = candidate[doc], candidate[seen_doc]
            doc, impact, of = doc[left], impact[left], of[left]
            seen_doc, seen_of = seen_doc[held], seen_of[held]
            if not len(doc):
                break
    found = np.flatnonzero(candidate & (lower > 0) & (lower >= bar))
    return found, lower[found]


class Best:
    """The best documents of every item so far: score, whether the id is null, id, file, row."""

    def __init__(self, n_items: int, top: int):
        self.top, self.rows = top, [None] * n_items

    def least(self, item: int) -> int:
        rows = self.rows[item]
        return int(rows[0][-1]) if rows is not None and len(rows[0]) == self.top else 0

    def offer(self, item: int, *columns: np.ndarray) -> None:
        if self.rows[item] is not None:
            columns = [np.concatenate(c) for c in zip(self.rows[item], columns)]
        score, none, ident, file, row = columns
        by = np.lexsort((row, file, ident, none, -score))[:self.top]
        self.rows[item] = [c[by] for c in columns]


def _blocks(batches):
    """Columns of at most BLOCK_DOCS documents with about BLOCK_POSTINGS postings."""
    for batch in batches:
        size = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        total, lo = np.concatenate([[0], np.cumsum(size)]), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, min(lo + BLOCK_DOCS, int(np.searchsorted(total, total[lo] + BLOCK_POSTINGS, "right")) - 1))
            yield batch.slice(lo, hi - lo), size[lo:hi]
            lo = hi


def _best(shared, top: int):
    def run(batches):
        items, weight, n_docs, n_words = shared.value
        best = Best(len(items), top)
        for block, size in _blocks(batches):
            n = block.column("n").to_numpy()
            doc = np.repeat(np.arange(block.num_rows), size)
            term, tf = (pc.list_flatten(block.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "times"))
            m = 100 - 50 + (50 * n * n_docs) // n_words
            lists = Lists(doc, term, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])), block.num_rows, len(weight))
            none = np.asarray(block.column("id").is_null())
            ident = block.column("id").fill_null(0).to_numpy()
            file, row = block.column("_f").to_numpy(), block.column("_r").to_numpy()
            for i, terms in enumerate(items):
                found, score = search(lists, terms, top, best.least(i))
                if len(found):
                    best.offer(i, score, none[found], ident[found], file[found], row[found])
        for i, rows in enumerate(best.rows):
            if rows is not None:
                score, none, ident, file, row = rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int64()), pa.array(score), pa.array(ident, mask=none), pa.array(file), pa.array(row)],
                                                 names=["item", "score", "id", "_f", "_r"])

    return run


def _groups(items: DataFrame, most: int):
    """A column that deals items into groups of at most ``most`` bytes (or one item), and the number of groups."""
    total = items.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / most))
    while True:
        group = F.pmod(F.xxhash64(*ROW), F.lit(parts))
        full = items.groupBy(group.alias("g")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") > most) & (F.col("n") > 1))
        if full.isEmpty():
            return group, parts
        parts *= 2


def weights(n_docs: int, held: list[int]) -> np.ndarray:
    """Weight of terms held by so many documents, in thousandths."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held], np.int64)


def ranked(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
           top: int = TOP, most: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, id, score, _f, _r): the ``top`` documents of every row of ``items``, best first."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, id long, score long, _f long, _r long"
    rows = keyed(scanned(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = keyed(items, F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("binary").alias("text"))
    asked = stored(asked.mapInArrow(_asked, "_f long, _r long, id long, terms array<binary>, bytes long").filter(F.size("terms") > 0), "items")
    group, parts = _groups(asked, most)
    out = spark.createDataFrame([], schema)
    for g in range(parts):  # items in blocks, each against all documents
        held = asked.filter(group == g).select("id", "terms").collect()  # at most `most` bytes, or one item
        if not held:
            continue
        number = {t: i for i, t in enumerate(sorted({bytes(t) for r in held for t in r["terms"]}))}
        known = spark.sparkContext.broadcast(number)
        schema_p = "_f long, _r long, id long, n long, terms array<int>, times array<int>"
        postings = stored(rows.mapInArrow(_postings(known), schema_p), "postings")
        n_docs, n_words = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = [0] * len(number)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # at most a row per term
            df[r["t"]] = r["df"]
        weight = weights(n_docs, df)
        wanted = [np.array([t for t in (number[bytes(t)] for t in r["terms"]) if df[t] and weight[t] > 0], np.int64) for r in held]
        shared = spark.sparkContext.broadcast((wanted, weight, n_docs, n_words))
        found = stored(postings.filter(F.size("terms") > 0).select("_f", "_r", "id", "n", "terms", "times").mapInArrow(
            _best(shared, top), "item long, score long, id long, _f long, _r long"), "best")
        order = [F.col("score").desc(), F.col("id").asc_nulls_last(), *ROW]
        part = Window.partitionBy("item", F.pmod(F.xxhash64(*ROW), F.lit(64))).orderBy(*order)
        some = found.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= top).drop("_n")
        final = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(held)], "item long, item_id long")
        out = out.unionByName(final.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score", *ROW))
        known.destroy()
        shared.destroy()
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
held AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM words) GROUP BY r, term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2e0 * docs + 2) / (2e0 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
asked AS (SELECT DISTINCT b, item_id, term FROM (SELECT row_number() OVER () AS b, item_id, unnest({_TERMS}) AS term FROM benchmark)),
scored AS (SELECT b, item_id, held.r, doc_id,
                  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
           FROM asked JOIN weighed USING (term) JOIN held USING (term) JOIN sizes ON sizes.r = held.r, total
           GROUP BY b, item_id, held.r, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
WHERE place <= {TOP}
"""
