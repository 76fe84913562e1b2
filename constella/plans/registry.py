"""Registered queries: name -> (spark callable, DuckDB oracle SQL or None).

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole of
the given tables (or tables Spark derives from them). The oracle, when
present, is an SQL statement DuckDB runs over the same parquet views; it
computes the same columns under the same names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            # intermediates cached by the previous query are not reused;
            # dropping them keeps plan analysis from slowing down as cache
            # entries pile up in a long-lived session
            spark.catalog.clearCache()
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MODULES = ["q_profile", "q_clean", "q_reduce", "q_cluster", "q_anomaly", "q_assemble",
           "q_catalogue", "q_points", "q_streaming", "q_sources", "q_tune", "q_neighbors", "q_embed"]


def load_all() -> None:
    """Importing the query modules fills the registry."""
    import importlib
    import importlib.util

    for m in MODULES:
        name = f"constella.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
