"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, base_dir) and returns a lazy DataFrame; every
one reads the driver tables whole. Oracle SQL runs on the same parquet
files, registered as views under their table names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def half_even_sql(num: str, den: str, digits: int) -> str:
    """SQL twin of functions.columns.round_ratio (integer half-even)."""
    scale = 10 ** digits
    x = f"(CAST({num} AS BIGINT) * {scale})"
    d = f"CAST({den} AS BIGINT)"
    q = f"({x} // {d})"
    r = f"({x} % {d})"
    return (f"(CASE WHEN {d} <> 0 THEN CAST({q} + CASE WHEN 2 * {r} > {d} THEN 1 "
            f"WHEN 2 * {r} = {d} THEN {q} % 2 ELSE 0 END AS DOUBLE) / {scale} END)")


def load_all() -> None:
    # importing the modules fills the registry
    import importlib
    for m in ("q_history", "q_evidence", "q_judgments", "q_ingest"):
        try:
            importlib.import_module(f"viewlens.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"viewlens.plans.{m}":
                raise
