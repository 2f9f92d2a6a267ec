"""Registered queries of this subpackage and the SQL that recomputes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import bm25_index, dart_minhash, exact_blocks, language_tree, license_paragraphs, mixing, prefix_tokens
from ebbtide.llm import merkle_manifest, part_enum, quality_neighbours, relative_parse, spectral_whitening, subword_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_duplicates": dart_minhash.op1_near_duplicates,
        "op2_relative_parse": relative_parse.op2_relative_parse,
        "op3_quality": quality_neighbours.op3_quality,
        "op4_decontamination": bm25_index.op4_decontamination,
        "op5_mixing": mixing.op5_mixing,
        "op6_toxicity": subword_toxicity.op6_toxicity,
        "op7_licenses": license_paragraphs.op7_licenses,
        "op8_language": language_tree.op8_language,
        "op9_exact_dedup": exact_blocks.op9_exact_dedup,
        "op10_token_counts": prefix_tokens.op10_token_counts,
        "op11_whitening": spectral_whitening.op11_whitening,
        "op12_ngram_join": part_enum.op12_ngram_join,
        "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": dart_minhash.OP1_SQL,
        "op2_relative_parse": relative_parse.OP2_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op9_exact_dedup": exact_blocks.OP9_SQL,
        "op12_ngram_join": part_enum.OP12_SQL,
    }
