"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exact_dedup", "line_dedup", "packing", "simhash", "url_filter", "byte_bpe", "piecewise_hash", "language_id", "lm_scoring", "chat_format")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"leadweave.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in MODULES for k, f in getattr(import_module(f"leadweave.llm.{m}"), "SQL", {}).items()}
