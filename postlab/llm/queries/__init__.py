"""Registered queries of the operators: name -> query, name -> check SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

_MODULES = ("quality", "private", "mixing", "huffman", "packing", "near", "main_text", "scoring", "repeats", "neighbours", "bestfit", "dialogues", "alignment")

for _name in _MODULES:
    _module = importlib.import_module(f"{__name__}.{_name}")
    QUERIES[_module.NAME] = _module.query
    if getattr(_module, "SQL", None):
        ORACLES[_module.NAME] = _module.SQL
