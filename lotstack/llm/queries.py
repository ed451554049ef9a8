"""The corpus operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotstack.llm import chat, collocations, decontaminate, hnsw, html_text, katz, licenses, neardup, packing, quality, repair, sharding, topk

_OPERATORS = (
    chat.op1_prefix_target_chat,
    html_text.op2_html_layout,
    topk.op3_threshold_topk,
    licenses.op4_license_scan,
    neardup.op5_bottomk_dedup,
    katz.op6_katz_backoff,
    decontaminate.op7_spaced_seed_decontamination,
    packing.op8_best_fit_packing,
    quality.op9_quality_gbdt,
    sharding.op10_slot_sharding,
    hnsw.op11_hnsw_dedup,
    repair.op12_minplus_repair,
    collocations.op13_pcy_collocations,
    licenses.license_base_places,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_prefix_target_chat": chat.CHAT_SQL,
        "license_base_places": licenses.BASE_PLACES_SQL,
        "op3_threshold_topk": topk.TOPK_SQL,
        "op5_bottomk_dedup": neardup.NEARDUP_SQL,
        "op11_hnsw_dedup": hnsw.HNSW_SQL,
        "op12_minplus_repair": repair.REPAIR_SQL,
        "op13_pcy_collocations": collocations.COLLOCATIONS_SQL,
    }
