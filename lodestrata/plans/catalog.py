"""The named queries: each an operator applied to the tables of a folder, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "agg2_decayed_need"


def query(sql: str | None = None):
    """Registers a function under its name, with its DuckDB SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Imports the modules that register queries."""
    from . import aggregates, flows, joins, ledgers, rest, rows, texts  # noqa: F401


load()
