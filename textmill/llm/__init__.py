"""Operators for preparing training data, and their registered queries."""

from importlib import import_module

MODULES = (
    "mixing",
    "sentencepiece_codec",
    "lattice_dedup",
    "jaccard_join",
    "substring_dedup",
    "html_text",
    "personal_data",
    "line_dedup",
    "language_id",
    "topk",
    "secret_scan",
    "lexical_scan",
    "infilling",
)


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"textmill.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"textmill.llm.{name}"), "ORACLE", {})
    return found
