"""Operators by name, and stages of a retrieval chained over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from millrace.operators import tabular
from millrace.plans.predicates import filtered, selected

Operator = Callable[..., DataFrame]
Query = Callable[..., DataFrame]
OPERATORS: dict[str, Operator] = {}


def operator(name: str) -> Callable[[Operator], Operator]:
    """Register an operator; it is called with its input frames and keyword parameters."""

    def register(run: Operator) -> Operator:
        OPERATORS[name] = run
        return run

    return register


def run(name: str, *frames: DataFrame, **params: Any) -> DataFrame:
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}; there are {', '.join(sorted(OPERATORS))}")
    return OPERATORS[name](*frames, **params)


def registrar(queries: dict[str, Query], oracles: dict[str, str]) -> Callable[..., Callable[[Query], Query]]:
    """A decorator that keeps a query, and the SQL that gives the same rows if there is one, by the query's name."""

    def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def register(run: Query) -> Query:
            queries[name or run.__name__] = run
            if sql:
                oracles[name or run.__name__] = sql
            return run

        return register

    return query


class Pipeline:
    """Stages of the form ``stage(frame) -> frame``, each in its turn; a stage that is None is left out."""

    def __init__(self, stages: Sequence[Callable[[DataFrame], DataFrame] | None]) -> None:
        self.stages = [s for s in stages if s is not None]

    def run(self, frame: DataFrame) -> DataFrame:
        for stage in self.stages:
            frame = frame.transform(stage)
        return frame


@operator("query")
def _query(first: DataFrame, *others: DataFrame, filters=(), select=(), group_by=None, fn="count", join_field=None, limit=500) -> DataFrame:
    """Filter, join and group or select in one declarative plan."""
    frame = tabular.join_tables(first, *others, on=join_field) if join_field else first
    frame = filtered(frame, filters)
    if group_by in frame.columns:
        return tabular.group_query(frame, group_by, select[0] if select and select[0] in frame.columns else None, fn)
    return selected(frame, select, limit)


@operator("group-by")
def _group_by(frame: DataFrame, group_field: str, value_field: str, fn: str = "mean") -> DataFrame:
    return tabular.group_values(frame, group_field, value_field, fn)


@operator("pivot-table")
def _pivot(frame: DataFrame, row_field: str, col_field: str, value_field: str | None = None, fn: str = "count") -> DataFrame:
    return tabular.pivot_cells(frame, row_field, col_field, value_field, fn)


@operator("time-series")
def _time_series(frame: DataFrame, date_field: str, value_field: str, period: str = "ME") -> DataFrame:
    return tabular.time_series(frame, date_field, value_field, period)


@operator("summary")
def _summary(frame: DataFrame) -> DataFrame:
    return tabular.summary(frame)


@operator("distribution")
def _distribution(frame: DataFrame, field: str, bins: int | str = "auto") -> DataFrame:
    return tabular.histogram(frame, field, bins) if tabular.kind_of(frame, field) == "number" else tabular.value_counts(frame, field)


@operator("outliers")
def _outliers(frame: DataFrame, field: str, key: str = "_id") -> DataFrame:
    return tabular.outliers(frame, field, key)


@operator("correlation")
def _correlation(frame: DataFrame, field1: str, field2: str) -> DataFrame:
    return tabular.with_p_value(tabular.correlation(frame, field1, field2))


@operator("correlation-matrix")
def _matrix(frame: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    return tabular.with_p_value(tabular.correlation_matrix(frame, list(fields) or None))


@operator("chart")
def _chart(frame: DataFrame, x_field: str, y_field: str | None = None, chart_type: str = "bar", aggregation: str = "count", sort_by: str = "value", sort_order: str = "desc", limit: int = 20, filters=()) -> DataFrame:
    if chart_type == "scatter":
        if not y_field:
            raise ValueError("a scatter chart needs a y field")
        return tabular.scatter(filtered(frame, filters), x_field, y_field)
    return tabular.chart_values(frame, x_field, y_field, aggregation, sort_by, sort_order != "asc", limit, filters)
