"""Row numbers and ordered lists without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.session import discard, materialize

ROW_BITS = 33


def dense_index(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order.

    Write, range-partition, sort each part, write; then each part starts where the ones
    before it end. The bounds of the ranges come from a sample, which is a pass of its own over
    the rows: they are written first so that their plan runs once. The starts are one row per part, from one running sum over the
    parts, so their join is broadcast with a bound that does not depend on the data.
    """
    stored = materialize(rows, "unranked")
    sorted_parts = stored.repartitionByRange(*order).sortWithinPartitions(*order)
    seq = F.monotonically_increasing_id()
    placed = materialize(
        sorted_parts.withColumn("_seq", seq)
        .withColumn("_part", F.shiftright("_seq", ROW_BITS))
        .withColumn("_row", F.col("_seq").bitwiseAND((1 << ROW_BITS) - 1)),
        "ranked",
    )
    discard(stored)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_seq", "_part", "_row", "_start")
    )


def numbered_lists(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Sorted lists as rows: (keys, pos, item), ``pos`` from 0 within the keys.

    The shape of a list does not change with its length, and no task holds a whole one.
    """
    ranked = dense_index(rows.select(*keys, item), [*keys, item], "_n")
    first = ranked.groupBy(*keys).agg(F.min("_n").alias("_first"))
    return ranked.join(first, keys).select(*keys, (F.col("_n") - F.col("_first")).alias("pos"), item)
