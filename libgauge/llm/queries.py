"""The queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, filter_audit, licenses, minhash, mixing, mpeg_audio, ngram_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup, turn_repair


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mpeg_audio": mpeg_audio.op1_mpeg_audio,
        "op2_slot_sharding": sharding.op2_slot_sharding,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_chat_formatting": chat.op6_chat_formatting,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_compression_classifier": quality_classifier.op8_compression_classifier,
        "op9_temperature_mixing": mixing.op9_temperature_mixing,
        "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
        "op11_minhash_dedup": minhash.op11_minhash_dedup,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_turn_repair": turn_repair.op13_turn_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_license_scan": licenses.OP5_SQL, "op6_chat_formatting": chat.OP6_SQL, "op10_ngram_jaccard_join": ngram_join.OP10_SQL,
        "op11_minhash_dedup": minhash.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_turn_repair": turn_repair.OP13_SQL,
    }
