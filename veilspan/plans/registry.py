"""Where queries and their equivalent SQL are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files. The path is a pattern, as a stream's path can't name a file otherwise."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def ran(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source is used up, as a table in the shared folder (removed when the driver ends)."""
    path = new_folder(stream.sparkSession)
    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows", format="parquet", outputMode="append")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def exploded(df: DataFrame, matches, *keep) -> DataFrame:
    """A row (keep..., m) for each match.

    The outer form, then a filter: for the inner one Catalyst infers a filter on the array's size, which would run
    the detectors twice.
    """
    return df.select(*keep, F.explode_outer(matches).alias("m")).where("m is not null")


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def digits(n: int, step: int = 7919, key: str = "k") -> str:
    """SQL for n digits made from the key, which Spark and others read alike."""
    return f"lpad(CAST({key} * {step} % {10**n} AS STRING), {n}, '0')"


def pick(*values: str, key: str = "k") -> str:
    """SQL for one of some texts, by the key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def in_turn(parts: list[str], key: str = "k") -> str:
    """SQL for one of some expressions, by the key."""
    return f"CASE {key} % {len(parts)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"
