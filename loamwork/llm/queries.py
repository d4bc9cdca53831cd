"""The training-data queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamwork.llm import fingerprint, jaccard_join, language, media, mixing, packing, secrets, suffix_dedup, token_count, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_count.query,
        "op2_mixing": mixing.query,
        "op3_toxicity": toxicity.query,
        "op4_media": media.query,
        "op5_packing": packing.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_fingerprints": fingerprint.query,
        "op8_language_id": language.query,
        "op9_secrets": secrets.query,
        "op10_ngram_jaccard_join": jaccard_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE_SQL}
