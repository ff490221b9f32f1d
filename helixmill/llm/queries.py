"""The queries of this package, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import (
    ball_codes, benchmark_leaks, exact_dedup, html_text, jaccard_join, line_dedup, packing, quality, source_divergence, suffix_dedup, toxicity, training_order, vector_topk,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html_text.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_line_dedup": line_dedup.query,
        "op4_training_order": training_order.query,
        "op5_quality": quality.query,
        "op6_toxicity": toxicity.query,
        "op7_vector_topk": vector_topk.query,
        "op8_benchmark_leaks": benchmark_leaks.query,
        "op9_packing": packing.query,
        "op10_jaccard_join": jaccard_join.query,
        "op11_exact_dedup": exact_dedup.query,
        "op12_source_divergence": source_divergence.query,
        "op13_ball_codes": ball_codes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_vector_topk": vector_topk.ORACLE_SQL,
        "op8_benchmark_leaks": benchmark_leaks.ORACLE_SQL,
        "op10_jaccard_join": jaccard_join.ORACLE_SQL,
        "op11_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_source_divergence": source_divergence.ORACLE_SQL,
        "op13_ball_codes": ball_codes.ORACLE_SQL,
    }
