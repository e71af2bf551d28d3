"""Queries of the ``llm`` problems with production parameters, over whole tables."""

from __future__ import annotations

import importlib

MODULES = ["q_vectors", "q_spans", "q_packing", "q_mixing", "q_code", "q_secrets"]


def _loaded():
    return [importlib.import_module(f"graphmill.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _loaded() for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _loaded() for k, v in getattr(m, "oracle_sql", dict)().items()}
