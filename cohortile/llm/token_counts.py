"""Token counts from pre-token frequencies: no ids are made.

A text falls into pre-tokens by the vocabulary's pattern, and a pre-token's pieces depend on it alone. So
the pieces of every distinct pre-token of the corpus are counted once, that table is joined to the
frequencies of the pre-tokens per document, and the products are summed. The texts are read twice, once
for the distinct pre-tokens and once for the frequencies, which are never written as a whole.

The join has a hot side by nature: common pre-tokens are in nearly all documents. The most frequent
ones, as many as fit the broadcast bound by their measured bytes, are joined by broadcast, and what
is left of a document is then one row. Only the others, each of them rare, are joined by shuffle.

Defined results: a null text counts as empty and has no bytes and no tokens. A special token's string in
a text is one token, as the library reads it. Repeated rows and repeated or null ids are rows of their own.
A text is never cut; a very long pre-token is one row. An empty table gives an empty result. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm import vocabularies
from cohortile.llm.common import BROADCAST_BYTES, keyed, least_count, scanned, sliced, stored, table

ROW = ["_f", "_r"]
VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024


class Splitter:
    """Pre-tokens of a text, and the number of special tokens in it, as the library finds them."""

    def __init__(self, vocabulary: str):
        import regex

        self.whole = vocabularies.library(vocabulary)
        self.pattern = regex.compile(vocabularies.pattern())
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, bool] = {}

    def new_character(self, c: str) -> bool:
        """Whether Python's Unicode tables lack ``c``: the pattern's library may know it, the vocabulary's not."""
        if c not in self.known:
            self.known[c] = unicodedata.category(c) == "Cn"
        return self.known[c]

    def split(self, text: str) -> list[str]:
        if not text.isascii() and any(map(self.new_character, set(text))):
            return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        between = self.special.split(text)
        return [p for part in between for p in self.split(part)], len(between) - 1


def check_vocabulary(vocabulary: str) -> None:
    """Raise unless a pre-token's pieces depend on it alone and the pattern is the byte-level one."""
    with open(vocabularies.path(vocabulary), encoding="utf-8") as f:
        said = json.load(f)
    split = said["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    flags = [t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
    if said["model"]["type"] != "BPE" or said["normalizer"] or not plain or any(flags):
        raise ValueError(f"{vocabulary} is not a plain byte-level BPE vocabulary")


def _text(value) -> str:
    return (value or b"").decode("utf-8", "replace")


def _distinct(vocabulary: str):
    def run(batches):
        split = Splitter(vocabulary)
        for batch in sliced(batches, "text", most=8 << 20):
            held: Counter = Counter()
            for text in batch.column("text").to_pylist():
                held.update(set(split(_text(text))[0]))
            yield pa.RecordBatch.from_arrays([pa.array([p.encode() for p in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["piece", "docs"])

    return run


def _frequencies(vocabulary: str):
    names = ["_f", "_r", "id", "n_bytes", "piece", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches):
        split = Splitter(vocabulary)
        for batch in sliced(batches, "text", most=1 << 20):
            file, row, at = batch.column("_f"), batch.column("_r"), []
            size, piece, n, ids = [], [], [], batch.column("id").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts, special = split(_text(text))
                counts = Counter(parts)
                at += [i] * (len(counts) + 1)
                size += [len(text or b""), *[None] * len(counts)]
                piece += [None, *(p.encode() for p in counts)]
                n += [special, *counts.values()]
            take = pa.array(at, pa.int32())
            head = pa.array([ids[i] if p is None else None for i, p in zip(at, piece)], kinds[2])
            cols = [file.take(take), row.take(take), head, pa.array(size, kinds[3]), pa.array(piece, kinds[4]), pa.array(n, kinds[5])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _counted(vocabulary: str):
    def run(batches):
        model, alphabet = vocabularies.library(vocabulary).model, vocabularies.byte_alphabet()
        for batch in batches:
            n = [len(model.tokenize("".join(map(alphabet.__getitem__, p)))) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("docs"), pa.array(n, pa.int64())], names=["piece", "docs", "tokens"])

    return run


def piece_counts(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(piece, docs, tokens) of every distinct pre-token of ``rows``' texts, stored."""
    held = rows.select("text").mapInArrow(_distinct(vocabulary), "piece binary, docs long")
    return stored(held.groupBy("piece").agg(F.sum("docs").alias("docs")).mapInArrow(_counted(vocabulary), "piece binary, docs long, tokens long"), "pieces")


def token_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY,
                 most: int = BROADCAST_BYTES) -> DataFrame:
    """(_f, _r, id, n_bytes, n_tokens) per row; pre-tokens of at most ``most`` bytes in all are broadcast."""
    check_vocabulary(vocabulary)
    rows = keyed(scanned(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    pieces = piece_counts(rows, vocabulary)
    least = least_count(pieces, "docs", F.octet_length("piece") + 48, most)
    hot = F.broadcast(pieces.filter(F.col("docs") >= least).select("piece", "tokens"))
    held = rows.mapInArrow(_frequencies(vocabulary), "_f long, _r long, id long, n_bytes long, piece binary, n long").join(hot, "piece", "left")
    # a row without a piece stands for its document and counts the special tokens
    here = F.when(F.col("piece").isNull(), F.col("n")).otherwise(F.col("n") * F.col("tokens"))
    rare = F.when(F.col("tokens").isNull(), F.col("piece"))
    sums = stored(held.groupBy(*ROW, rare.alias("piece")).agg(F.sum(here).alias("n_tokens"), F.sum("n").alias("n"), F.max("id").alias("id"),
                                                             F.max("n_bytes").alias("n_bytes")), "sums")
    none = F.lit(None).cast("long")
    others = sums.filter("piece IS NOT NULL").join(pieces.filter(F.col("docs") < least), "piece").select(
        *ROW, none.alias("id"), none.alias("n_bytes"), (F.col("n") * F.col("tokens")).alias("n_tokens"))
    both = sums.filter("piece IS NULL").select(*ROW, "id", "n_bytes", "n_tokens").unionByName(others)
    return both.groupBy(*ROW).agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
