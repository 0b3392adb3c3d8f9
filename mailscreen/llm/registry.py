"""Registration of this subpackage's queries, and how they read their tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen.session import plain_unions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long_array(values: Iterable[int]) -> Column:
    """A constant array<bigint>; one call to the JVM however many values."""
    text = ",".join(map(str, values))
    return F.split(F.lit(text), ",").cast("array<bigint>") if text else F.array().cast("array<bigint>")


def bin_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending `bounds` are not above `value` (binary search)."""
    known = long_array(bounds)
    steps = long_array(1 << i for i in reversed(range(len(bounds).bit_length())))
    none = F.lit(0).cast("bigint")
    return F.aggregate(steps, none, lambda at, step: F.when(F.get(known, (at + step - 1).cast("int")) <= value, at + step).otherwise(at))
