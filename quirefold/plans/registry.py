"""Queries of the engine's own operators, by name, with the DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "marker_classify"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"a query named {fn.__name__} is registered already")
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that heavy expressions follow: its rows are dealt to all cores where it has fewer files than those, as a small file is read by one task. A large table is read as it lies."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < 4 * cores and len(df.inputFiles()) < cores
    return df.repartition(cores) if few else df


from quirefold.plans import boxes, decisions, documents, evaluation, extraction, forms, reports, state, texts  # noqa: E402, F401
