"""Registered queries, each over whole tables and next to its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from . import diagnosis, nodes, star, streams, telemetry

    out: dict[str, Query] = {}
    for module in (star, telemetry, nodes, diagnosis, streams):
        for name, query in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = query
    return out
