"""The registry of this package: ``QUERIES`` and, where SQL can say it, ``ORACLES``.

Every operator module registers its query on import.
"""

from __future__ import annotations

import importlib

from topicloom.llm.base import ORACLES, QUERIES

MODULES = ("rules", "mixing", "pieces", "warc", "jaccard", "embeddings", "toxicity", "lines", "quality", "chat", "licenses", "tries", "phrases")

for _name in MODULES:
    importlib.import_module(f"topicloom.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
