"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import (
    ctw, decontamination, lines, mixing, neardups, prefix_trie, privacy, quality, repair, secret_scan, substrings, vectors, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_warc": warc.op2_warc,
        "op3_personal_data": privacy.op3_personal_data,
        "op4_secret_scans": secret_scan.op4_secret_scans,
        "op5_order_minhash": neardups.op5_order_minhash,
        "op6_mixing": mixing.op6_mixing,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_vector_graph": vectors.op10_vector_graph,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_context_tree": ctw.op13_context_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op9_line_dedup": lines.SQL, "op11_prefix_trie": prefix_trie.SQL,
            "op12_conversation_repair": repair.SQL}
