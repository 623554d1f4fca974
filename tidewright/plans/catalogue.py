"""Queries of the reference operators over the test tables, with their DuckDB statements.

``entry(name, sql, doubles)`` registers a query. The named double columns are
rounded to six places on both sides, so that the order of additions in the two
engines doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLACES = 6
#: Keeps exact halves of the last place, which are common among means of few labels, from depending on the last bit.
NUDGE = 1e-10


def bigint_counts(sql: str) -> str:
    """count_if as a count, which DuckDB gives as a bigint like Spark."""
    while (at := sql.find("count_if(")) >= 0:
        start = at + len("count_if(")
        end, depth = start, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(case when {sql[start : end - 1]} then 1 end){sql[end:]}"
    return sql


def entry(sql: str | None = None, doubles: str = "", name: str | None = None) -> Callable[[Query], Query]:
    names = doubles.split()

    def register(f: Query) -> Query:
        key = name or f.__name__

        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = f(spark, sf)
            return df.withColumns({c: F.round(F.col(c) + NUDGE, PLACES) + F.lit(0.0) for c in names}) if names else df

        QUERIES[key] = run
        if sql is not None:
            text = bigint_counts(sql)
            SQL[key] = f"select * replace ({', '.join(f'round(cast({c} as double) + {NUDGE:.10f}, {PLACES}) + 0.0 as {c}' for c in names)}) from (\n{text}\n)" if names else text
        return f

    return register


def _load() -> None:
    from tidewright.plans import queries_cells, queries_inference, queries_items, queries_metrics, queries_summary  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
