"""From raw documents to packed sequences: language, exact and near duplicates, personal data, packing.

Every stage but the last returns the columns of its documents, whatever their names, and works on all that
the stage before it kept. Rows are known by their place in the stored table, so repeated rows and repeated or null ids
are documents of their own until a stage finds them equal. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortile.llm import exact_dedup, language, near_dedup, packing, pii
from cohortile.llm.common import prepare, stored, table


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; the others go, null and empty texts and those without a letter among them.

    Ties between languages are rejected. Without a labelled row nothing is learned and every document goes.
    """
    prepare(spark)
    return language.drop_rejected(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal when A-Z are lower-cased: that with the largest id, null ids last."""
    prepare(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that with the least id, null ids last.

    Texts without words link with nothing and stay.
    """
    prepare(spark)
    return near_dedup.drop_near_duplicates(docs, k=5, threshold=0.8)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and revealing terms; null texts stay null, and ``n_chars`` follows the new text."""
    prepare(spark)
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, placed in sequences of at most 1,024 tokens; a null or empty text is its end token alone."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language", tell_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", sanitise), ("packing", pack)]

#: Compression, sketches and tokens have no SQL form; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
