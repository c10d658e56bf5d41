"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import ann, best_fit, bpe, chat, clustering, jaccard, langid, line_dedup, packing, quality, secrets, sharding, spelling
from .common import ship_package

_MODULES = {
    "op1_langid": langid,
    "op2_bpe": bpe,
    "op3_secrets": secrets,
    "op4_jaccard": jaccard,
    "op5_sharding": sharding,
    "op6_quality": quality,
    "op7_packing": packing,
    "op8_ann": ann,
    "op9_chat": chat,
    "op10_line_dedup": line_dedup,
    "op11_spelling": spelling,
    "op12_best_fit": best_fit,
    "op13_clustering": clustering,
}


def _shipped(run: Callable) -> Callable:
    def query(spark, sf_dir: str):
        ship_package(spark)
        return run(spark, sf_dir)

    return query


def llm_queries() -> dict[str, Callable]:
    return {name: _shipped(module.query) for name, module in _MODULES.items()}


def llm_oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
