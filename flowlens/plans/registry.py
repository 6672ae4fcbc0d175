"""Registry of named queries: Spark callable + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    import importlib

    for mod in ("q_decision", "q_sources", "q_features", "q_stats", "q_models", "q_streaming"):
        importlib.import_module(f"{__package__}.{mod}")


def stable_round(col, digits: int):
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE operations in Spark and in
    the SQL oracle (``sql_round``), so equal inputs round to equal bits."""
    from pyspark.sql import functions as F
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def sql_round(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * {float(10 ** digits)!r} + 0.5) / {float(10 ** digits)!r})"
