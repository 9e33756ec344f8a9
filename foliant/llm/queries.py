"""The queries opN_<name> and pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from foliant.llm import chat, counts, fim, mixing, neighbours, ngrams, packing, quality, repeats, simhash, tokens, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.query,
    "op2_chat_windows": chat.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_token_files": tokens.query,
    "op5_substring_dedup": repeats.query,
    "op6_lm_scoring": ngrams.query,
    "op7_best_fit_packing": packing.query,
    "op8_mixing": mixing.query,
    "op9_toxicity": toxicity.query,
    "op10_neighbours": neighbours.query,
    "op11_token_counts": counts.query,
    "op12_fill_in_middle": fim.query,
    "op13_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.SQL,
    "op5_substring_dedup": repeats.SQL,
    "op12_fill_in_middle": fim.SQL,
}
