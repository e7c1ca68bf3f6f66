"""All queries of the research operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), and its SQL where there is any."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


from tidemark.plans import (  # noqa: E402, F401  they register their queries
    calendar_plans,
    chart_plans,
    control_plans,
    dataset_plans,
    decision_plans,
    factor_plans,
    gate_plans,
    label_plans,
    outlook_plans,
    panel_plans,
    source_plans,
    statistics_plans,
    study_plans,
    text_plans,
    timeline_plans,
)
