"""The queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.bpe import op10_byte_bpe
from weftgraph.llm.chat_format import op7_chat_format
from weftgraph.llm.factorization import op1_quality_classifier, op5_toxicity
from weftgraph.llm.minhash import op6_minhash_dedup
from weftgraph.llm.mixing import op9_mix_sources
from weftgraph.llm.oracles import oracle_sql
from weftgraph.llm.quality_rules import op2_quality_rules
from weftgraph.llm.token_count import op8_token_counts
from weftgraph.llm.url_templates import op4_url_templates
from weftgraph.llm.vector_dedup import op3_vector_dedup

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_quality_rules": op2_quality_rules,
        "op3_vector_dedup": op3_vector_dedup,
        "op4_url_templates": op4_url_templates,
        "op5_toxicity": op5_toxicity,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_chat_format": op7_chat_format,
        "op8_token_counts": op8_token_counts,
        "op9_mix_sources": op9_mix_sources,
        "op10_byte_bpe": op10_byte_bpe,
    }
