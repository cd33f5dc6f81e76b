"""The queries on training data by name, with SQL where SQL can say the same."""

from __future__ import annotations

import importlib

MODULES = [importlib.import_module(f"veilspan.llm.{m}") for m in ("p2_queries", "p3_queries", "p4_queries", "p5_queries", "p7_queries", "p8_queries", "p9_queries", "p10_queries")]
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
