"""Every registered query of the security-telemetry part, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _whole_counts(sql: str) -> str:
    """count_if(c) as count(*) FILTER (WHERE c): a BIGINT, and 0 where c is null throughout."""
    at = sql.find("count_if(")
    while at >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
        at = sql.find("count_if(")
    return sql


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under `name`, with the SQL that gives the same rows where there is one."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = _whole_counts(oracle)
        return f

    return register


def _load() -> None:
    """Imports the modules that register queries."""
    import brackwater.plans.intelligence
    import brackwater.plans.modelling
    import brackwater.plans.telemetry  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
