"""The registered queries of the analytics library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its DuckDB SQL, if it has one."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


from tidemark.plans import bar_queries  # noqa: E402, F401
from tidemark.plans import trade_queries  # noqa: E402, F401
from tidemark.plans import metric_queries  # noqa: E402, F401
from tidemark.plans import stream_queries  # noqa: E402, F401
from tidemark.plans import upkeep_queries  # noqa: E402, F401
from tidemark.plans import report_queries  # noqa: E402, F401
from tidemark.plans import analysis_queries  # noqa: E402, F401
from tidemark.plans import keyed_queries  # noqa: E402, F401
from tidemark.plans import store_queries  # noqa: E402, F401
