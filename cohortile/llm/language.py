"""Language identification by compression.

For each learned language a bounded sample of text becomes a raw-content zstandard dictionary.
A text is encoded with every dictionary, block by block, and the language with the fewest bytes
wins; a margin that is narrow against the second best rejects the document.

The sample is the only bounded part: about SAMPLE_ROWS rows of each language, drawn row by row over the
whole table, SNIPPET_CHARS from the middle of each, DICTIONARY_BYTES in all. Every text is encoded whole,
in blocks of BLOCK_BYTES. A table may name at most MAX_LANGUAGES languages; more raise an error.

Defined results: a null text, or one without a letter (Unicode category L), is `und` with score 0 and is
rejected; so is every text if no language was learned, as from an empty table, which itself gives an empty
result. Equal sizes go to the language with more training rows, then to the first by name, and count as a margin
of 0. A null id is an empty string in the split; rows with one id, null or not, are rows of their own. Columns
named like the added ones keep their names, the added ones get an underscore.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortile.llm.common import keyed, scanned, table, tidy

SAMPLE_ROWS, SNIPPET_CHARS, DICTIONARY_BYTES = 1500, 400, 400_000
BLOCK_BYTES, SHORT_BYTES, LEVEL, SHORT_LEVEL = 16_384, 1024, 3, 12
MAX_LANGUAGES = 1000
#: Least share of the second best size by which the best must be smaller.
NARROW = 0.002
NOISE = bytes(range(33, 65)) + b"[\\]^_`{|}~"


def split_of(id_col, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def reduced(raw: bytes) -> bytes:
    """ASCII letters in lower case, without digits and ASCII punctuation, single spaces."""
    return b" ".join(raw.lower().translate(None, NOISE).split())


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", mod: int = 4, held: int = 2,
          sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the most frequent language first."""
    # a draw of its own for every row, however often its id or text occurs, and the same by whatever path the table is read
    rows = keyed(docs, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    train = rows.select("lang", "text", split_of("id", mod).alias("part"), F.xxhash64("id", "text", "_r").alias("h")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("part") != held))
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_rows / r["n"])) for r in counts], "lang string, share double")
    start = F.greatest(F.lit(1), ((F.length("text") - SNIPPET_CHARS) / 2).cast("int"))
    picked = (train.join(F.broadcast(share), "lang").filter((F.col("h") / 2.0**64 + 0.5) <= F.col("share"))
              .select("lang", "h", F.substring("text", start, F.lit(SNIPPET_CHARS)).alias("s")).collect())
    order = {r["lang"]: (-r["n"], r["lang"]) for r in counts}
    texts: dict[str, list[tuple]] = {k: [] for k in order}
    for r in picked:
        texts[r["lang"]].append((r["h"], r["s"]))
    return [(k, b" ".join(reduced(s.encode()) for _, s in sorted(texts[k]))[:DICTIONARY_BYTES]) for k in sorted(order, key=order.get)]


def _coder(content: bytes, level: int):
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    """The dictionaries of one worker."""

    def __init__(self, model: list[tuple[str, bytes]]):
        self.names = [k for k, _ in model]
        self.coders = [(_coder(d, LEVEL), _coder(d, SHORT_LEVEL)) for _, d in model]

    def __call__(self, raw: bytes | None) -> tuple[str, float, bool]:
        """Language, score, whether it is rejected."""
        if not raw or not self.names or not any(map(str.isalpha, raw.decode("utf-8", "replace"))):
            return "und", 0.0, True
        text = reduced(raw)
        short = len(text) <= SHORT_BYTES
        blocks = [text[i:i + BLOCK_BYTES] for i in range(0, max(1, len(text)), BLOCK_BYTES)]
        sizes = [sum(len(c[short].compress(b)) for b in blocks) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best] + 1)
        margin = (second - sizes[best]) / second
        # the share that the best language has when every byte saved in a hundred doubles its odds twice
        weight = sum(math.exp(-140.0 * (s - sizes[best]) / second) for s in sizes)
        return self.names[best], 1.0 / weight, margin < NARROW


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def classify(docs: DataFrame, model: list[tuple[str, bytes]], text_col: str = "text",
             out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with three columns added: language, score, rejected."""
    names = [_fresh(docs, n) for n in out]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        of = Classifier(shared.value)
        for batch in batches:
            found = [of(t) for t in batch.column(place).cast(pa.binary()).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    added = [T.StructField(name, kind) for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def drop_rejected(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those whose language is not told apart, with the same columns."""
    flag = _fresh(docs, "_rejected")
    docs = scanned(docs)
    found = classify(docs, learn(docs, text_col, lang_col, id_col), text_col, (_fresh(docs, "_lang"), _fresh(docs, "_score"), flag))
    return found.filter(~F.col(flag)).select(*docs.columns)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select("doc_id", (split_of("doc_id", 4) == 2).alias("held_out"), "text")
    return classify(held, learn(docs)).drop("text")
