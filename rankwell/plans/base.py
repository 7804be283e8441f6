"""The registry of queries: each a function of (spark, sf_dir), with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.columns import draw_key, relu
from rankwell.operators.order import draw_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: SQL of the scored events; of their draw order within groups or over all.
SCORED = "SELECT event_id AS element_id, greatest(0.0, value) AS score, event_type, md5('42:' || event_id) AS draw FROM events"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (element_id, score, event_type) of the events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("element_id"), relu(F.col("value")).alias("score"), "event_type")


def drawn(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """The events with their place in the draw order, within groups if asked for."""
    return draw_order(events(spark, sf_dir), "element_id", by)


__all__ = ["QUERIES", "SCORED", "SQL", "draw_key", "drawn", "events", "query", "table"]
