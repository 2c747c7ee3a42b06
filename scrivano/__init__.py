"""A PySpark-native stylometry and corpus-analytics engine.

The names below are the library's public functions; each is imported when it is first asked for.
"""

from __future__ import annotations

import importlib

_PUBLIC = {
    "scrivano.operators.rules": "RULES Rule enforce load_rules rules_table selftest",
    "scrivano.operators.score": "ProfileNotFound fidelity infer metrics registers_info score",
    "scrivano.operators.rewrite": "blind_candidates blind_rate blind_sample feedback_counts feedback_rows generated_snippets inject_typos judge prompt rewrite",
    "scrivano.operators.extract": "extract",
    "scrivano.operators.curate": "curate salvage",
    "scrivano.operators.registers": "tag",
    "scrivano.operators.fingerprint": "fingerprint rhythm corpus_buckets",
    "scrivano.operators.typos": "catalog",
    "scrivano.server": "serve",
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_WHERE[name]), name)
