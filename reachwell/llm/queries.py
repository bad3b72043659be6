"""The operators' queries over the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Modules that hold a query: each has QUERIES and, where SQL can express it, ORACLE.
MODULES = ["neardup", "html", "lines", "embeddings", "packing", "substrings", "toxicity", "language", "sharding", "decontamination", "mixing", "resampling", "infilling"]

QUERIES = {}
ORACLE = {}
for _name in MODULES:
    _module = importlib.import_module(f"reachwell.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= getattr(_module, "ORACLE", {})
