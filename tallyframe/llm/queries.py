"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, fingerprints, lm_scoring, mixing, ngram_join, pii, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, vector_codes, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format.query,
    "op2_pii": pii.query,
    "op3_lm_scoring": lm_scoring.query,
    "op4_ngram_join": ngram_join.query,
    "op5_mixing": mixing.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_quality_rules": quality_rules.query,
    "op8_fingerprints": fingerprints.query,
    "op9_sentencepiece": sentencepiece_codec.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_vector_codes": vector_codes.query,
    "op12_whitening": whitening.query,
    "op13_byte_bpe": byte_bpe.query,
}

#: The others learn, draw by key, or search: their tests hold them against brute force, a round trip or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op7_quality_rules": quality_rules.oracle(),
    "op11_vector_codes": vector_codes.oracle(),
}
