"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

import importlib

MODULES = [
    "op01_language",
    "op02_mixing",
    "op03_html",
    "op04_tokens",
    "op05_decontamination",
    "op06_jaccard",
    "op07_substring",
    "op08_media",
    "op09_scoring",
    "op10_warc",
]


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"siltstone.llm.{name}"), what, {})
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
