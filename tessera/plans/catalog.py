"""All registered queries, by name, with their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("estimator_queries", "loss_queries", "row_queries", "judgment_queries", "sequence_queries", "state_queries")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs on the same tables."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
