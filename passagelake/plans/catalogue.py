"""The query catalogue: name -> Spark callable, and name -> DuckDB SQL of the same rows."""

from __future__ import annotations

import importlib

_MODULES = ("retrieval", "chunks", "maintenance", "layouts", "booklets", "seams", "artifacts", "indexes")

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "hybrid_retrieve"

for _name in _MODULES:
    _module = importlib.import_module(f".{_name}", __package__)
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
