"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import classify, conversation_repair, decontaminate, dedup_exact, html_extract, mixing, ngram_join, periodic_runs, secret_scan, syncmers, token_count, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1,
    "op2_toxicity": classify.op2,
    "op3_mixing": mixing.op3,
    "op4_url_filter": url_filter.op4,
    "op5_token_count": token_count.op5,
    "op6_quality": classify.op6,
    "op7_exact_dedup": dedup_exact.op7,
    "op8_ngram_join": ngram_join.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_html_extract": html_extract.op10,
    "op11_document_fingerprints": syncmers.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_periodic_runs": periodic_runs.op13,
}

SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_exact_dedup": dedup_exact.OP7_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op10_html_extract": html_extract.OP10_SQL,
    "op11_document_fingerprints": syncmers.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
