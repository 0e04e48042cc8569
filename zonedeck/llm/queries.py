"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, extraction, fingerprints, importance, mixing, packing, simhash_dedup, substring_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": importance.op1_importance_resampling,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_html_extraction": extraction.op4_html_extraction,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_adaptive_scan": ann.op6_adaptive_scan,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES: dict[str, str] = {"op8_pareto_mix": mixing.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE}
