"""The named queries of the library and their oracle SQL."""

from __future__ import annotations

import importlib

QUERIES = {}
ORACLES = {}


def register(oracle: str | None = None):
    """Name a query function (spark, sf_dir) after itself, with DuckDB SQL that gives the same rows where there is one; a name is given once."""

    def keep(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"a query named {f.__name__} is already registered")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def load_all() -> None:
    for name in ("reports", "tokens", "statistics", "alignment", "documents", "corpus", "formats", "whole", "errors", "philology", "rules", "runs", "normalised"):
        importlib.import_module(f"{__package__}.{name}")
