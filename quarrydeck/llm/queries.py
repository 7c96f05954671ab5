"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import oracles

#: Query name, and the module that holds the function of that name.
_MODULES = {
    "op1_fingerprints": "fingerprints",
    "op4_near_dedup": "near_dedup",
    "op2_mixing": "mixing",
    "op3_topk": "topk_search",
    "op5_sharding": "sharding",
    "op6_language": "lang_id",
    "op7_secrets": "secret_scan",
    "op8_packing": "packing",
    "op9_token_counts": "token_counts",
    "op10_html_text": "html_text",
    "op11_filter_audit": "filter_audit",
    "op12_whitening": "whitening",
    "op13_decontamination": "decontamination",
}

ORACLE_SQL: dict[str, str] = oracles.SQL


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return getattr(import_module(f"{__package__}.{_MODULES[name]}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _MODULES}
