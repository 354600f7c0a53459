"""The queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cotejo.llm import brown, codes, embedding_graph, licenses, merkle, mixing, quality, secrets, sentencepiece_codec, simhash, toxicity, variants, warc

_OPERATORS = {
    "op1_toxicity": toxicity,
    "op2_embedding_near_dedup": embedding_graph,
    "op3_merkle": merkle,
    "op4_mixing": mixing,
    "op5_warc": warc,
    "op6_sentencepiece": sentencepiece_codec,
    "op7_simhash_near_dedup": simhash,
    "op8_licenses": licenses,
    "op9_secrets": secrets,
    "op10_brown_lm": brown,
    "op11_spelling_variants": variants,
    "op12_vector_codes": codes,
    "op13_quality_rules": quality,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _OPERATORS.items() if hasattr(module, "ORACLE_SQL")}
