"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.bpe_codec import op12_bpe
from foliospark.llm.language_id import op4_language_id
from foliospark.llm.lm_scoring import op9_lm_scoring
from foliospark.llm.merkle import op11_merkle_manifest, op11_sql
from foliospark.llm.mixing import op2_mixing
from foliospark.llm.nearest import op6_nearest
from foliospark.llm.quality_rules import op10_quality_rules
from foliospark.llm.sentencepiece_codec import op1_sentencepiece
from foliospark.llm.simhash import op3_simhash
from foliospark.llm.spelling import op13_spelling, op13_sql
from foliospark.llm.suffix_dedup import op8_suffix_array_dedup
from foliospark.llm.toxicity import op5_toxicity
from foliospark.llm.url_filters import op7_sql, op7_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_mixing": op2_mixing,
        "op3_simhash": op3_simhash,
        "op4_language_id": op4_language_id,
        "op5_toxicity": op5_toxicity,
        "op6_nearest": op6_nearest,
        "op7_url_filters": op7_url_filters,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_quality_rules": op10_quality_rules,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_bpe": op12_bpe,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_url_filters": op7_sql(),
        "op11_merkle_manifest": op11_sql(),
        "op13_spelling": op13_sql(),
    }
