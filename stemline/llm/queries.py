"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemline.llm import bpe, context_mixing, embedding_dedup, exact_dedup, html_extract, langid, mixing, simhash, substring_dedup, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_lm_score": context_mixing.op3_lm_score,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_simhash": simhash.op6_simhash,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_html": html_extract.op9_html,
    "op10_mixing": mixing.op10_mixing,
}

SQL: dict[str, str] = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
