"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe_transducer import op10_bpe_transducer
from textloom.llm.chat_windows import op13_chat_windows
from textloom.llm.embedding_dedup import op5_pca_tiles
from textloom.llm.embedding_dedup import oracle as vector_sql
from textloom.llm.html_wrapper import op1_wrapper_inference
from textloom.llm.huffman_store import op3_huffman_store
from textloom.llm.lexical_search import op11_lexical_search
from textloom.llm.lexical_search import oracle as lexical_sql
from textloom.llm.license_scan import op6_license_join
from textloom.llm.license_scan import oracle as license_sql
from textloom.llm.merkle_manifest import op12_merkle_manifest
from textloom.llm.merkle_manifest import oracle as merkle_sql
from textloom.llm.near_dedup import op2_minhash_forest
from textloom.llm.near_dedup import oracle as near_sql
from textloom.llm.packing import op8_vector_packing
from textloom.llm.quality_classifier import op7_factorisation_machine
from textloom.llm.quality_rules import op4_robust_outliers
from textloom.llm.toxicity import op9_lexicon_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_wrapper_inference": op1_wrapper_inference,
        "op2_minhash_forest": op2_minhash_forest,
        "op3_huffman_store": op3_huffman_store,
        "op4_robust_outliers": op4_robust_outliers,
        "op5_pca_tiles": op5_pca_tiles,
        "op6_license_join": op6_license_join,
        "op7_factorisation_machine": op7_factorisation_machine,
        "op8_vector_packing": op8_vector_packing,
        "op9_lexicon_toxicity": op9_lexicon_toxicity,
        "op10_bpe_transducer": op10_bpe_transducer,
        "op11_lexical_search": op11_lexical_search,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_chat_windows": op13_chat_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_forest": near_sql(), "op5_pca_tiles": vector_sql(), "op6_license_join": license_sql(), "op11_lexical_search": lexical_sql(), "op12_merkle_manifest": merkle_sql()}
