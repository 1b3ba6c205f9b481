"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, fingerprints, hard_negatives, near_dedup, packing, periodic_runs, quality, secret_scan, substring_dedup, token_files, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_packing": packing.op3,
    "op4_chat_format": chat_format.op4,
    "op5_quality": quality.op5,
    "op6_toxicity": toxicity.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_token_files": token_files.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_fingerprints": fingerprints.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_url_filter": url_filter.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
