"""Joins that stay even when one key owns a third of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import materialize, stored_bytes

SALTS = 8
ROWS_PER_SALT = 100_000
TASK_BYTES = 4 << 20  # compressed columns; rows being sorted take many times that


def shuffled(lookup: DataFrame) -> DataFrame:
    """A ``lookup`` that grows with the input: joined by shuffle and merge, so that neither the
    driver nor a task ever holds it whole.

    Spark estimates a table by the size of its files. One of short compressed keys from which long
    texts or several rows are made looks small enough for a broadcast when it is not.
    """
    return lookup.hint("merge")


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    spread: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join many ``rows`` to a narrow ``lookup`` side.

    Each row takes one of ``salts`` sub-keys and the lookup side is repeated
    once per sub-key, so a hot key is spread over ``salts`` tasks. Right for
    inner, left, semi and anti joins: a row meets every lookup row exactly once.
    The repeated lookup side is never broadcast: its estimate does not know of the repeats.
    ``spread`` names the columns that tell rows of a key apart (default: all). ``tasks`` cuts
    both sides into so many parts, so that what a task sorts does not grow with the tables.
    """
    salt = F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", salt)
    right = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    if tasks:
        left, right = (side.repartition(tasks, *on, "_salt") for side in (left, right))
    return left.join(shuffled(right), [*on, "_salt"], how).drop("_salt")


def stored_tasks(stored: DataFrame) -> int:
    """Tasks for the rows of a table that ``materialize`` wrote: one per ``TASK_BYTES`` in its files, and no fewer
    than the session's shuffles have."""
    known = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(known, math.ceil(stored_bytes(stored) / TASK_BYTES))


def measured_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner equi-join of stored ``rows`` and a ``lookup`` of which both may have hot keys.

    A key takes a sub-key per ``per_salt`` of its rows, so only the lookup rows of
    hot keys are repeated, and as often as the measured count asks for.
    """
    salts = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / per_salt).cast("int").alias("_salts")).where("_salts > 1")
    salts = materialize(salts, "salts")
    number = F.coalesce("_salts", F.lit(1))
    left = rows.join(salts, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), number).cast("int"))
    right = lookup.join(salts, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), number - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [*on, "_salt"]).drop("_salt")
