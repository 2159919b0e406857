"""What the operators of this package share: the registry, tables, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without an argument cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")
