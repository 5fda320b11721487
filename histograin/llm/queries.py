"""The queries of the training-data operators, and their SQL where there is some."""

from __future__ import annotations

import importlib

#: query, module, name of its SQL
_ALL = (
    ("op1_decontamination", "decontaminate", "ORACLE"),
    ("op2_lm_scoring", "lm_score", "ORACLE"),
    ("op3_language_id", "language_id", None),
    ("op4_sharding", "sharding", None),
    ("op5_token_counts", "token_counts", None),
    ("op6_quality_rules", "quality", None),
    ("op7_jaccard_join", "jaccard_join", "ORACLE"),
    ("op8_mixing", "mixing", "ORACLE"),
    ("op9_warc", "warc", "ORACLE"),
    ("op10_token_ids", "token_ids", None),
)


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f".{module}", __package__), sql) for name, module, sql in _ALL if sql}
