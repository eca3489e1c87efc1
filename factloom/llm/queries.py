"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe_trie, exact_dedup, language, lm_score, packing, quality, secrets, simhash_dedup, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_power_of_two_packing": packing.op1_power_of_two_packing,
    "op2_rule_ensemble_quality": quality.op2_rule_ensemble_quality,
    "op3_stupid_backoff_score": lm_score.op3_stupid_backoff_score,
    "op4_trigram_secret_scan": secrets.op4_trigram_secret_scan,
    "op5_mixture_language": language.op5_mixture_language,
    "op6_lsm_exact_dedup": exact_dedup.op6_lsm_exact_dedup,
    "op7_trie_bpe_round_trip": bpe_trie.op7_trie_bpe_round_trip,
    "op8_bit_packed_tokens": token_files.op8_bit_packed_tokens,
    "op9_additive_quantisation_search": ann.op9_additive_quantisation_search,
    "op10_simhash_components": simhash_dedup.op10_simhash_components,
}

ORACLE_SQL: dict[str, str] = {**exact_dedup.SQL, **lm_score.SQL}
