"""Named queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortile.llm import alignment, embedding_dedup, exact_dedup, language, lexical_search, near_dedup, packing, pii
from cohortile.llm import sentencepiece_lattice, sharding, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_packing": packing.op2_packing,
    "op3_warc": warc.op3_warc,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sentencepiece": sentencepiece_lattice.op5_sentencepiece,
    "op6_sharding": sharding.op6_sharding,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_language": language.op9_language,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op11_lexical_search": lexical_search.OP11_SQL}
