"""A bounded bitmap of ids, to leave rows out of a shuffle that surely have no partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  # 2 MB, however many ids
PAGE = 32_768  # bits of one bitmap of Spark's


def id_bitmap(ids: DataFrame) -> DataFrame:
    """Hashes of the ids (the first column) in at most BITS / PAGE rows of PAGE bits."""
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(BITS))
    return ids.select((place / PAGE).cast("bigint").alias("__page"), F.pmod(place, F.lit(PAGE)).alias("p")).groupBy("__page").agg(
        F.bitmap_construct_agg("p").alias("__bits")
    )


def with_maybe(rows: DataFrame, id_col: str, pages: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``: false only if the id is not among those of the bitmap.

    The broadcast holds BITS bits at most. With more ids than bits it filters nothing and
    the result stays right.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(BITS))
    byte = F.expr("cast(conv(hex(substring(__bits, cast(__place div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(shiftleft(1, cast(__place % 8 as int)) as int)")
    return (
        rows.withColumn("__page", (place / PAGE).cast("bigint")).withColumn("__place", F.pmod(place, F.lit(PAGE)))
        .join(F.broadcast(pages), "__page", "left")
        .withColumn("__maybe", F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False)))
        .drop("__page", "__place", "__bits")
    )
