"""Joins that stay even when one key holds a large part of all rows.

The rows of a key that is heavy in `rows` never travel: their counterparts, at most MAX_HEAVY rows, are broadcast.
All other keys go through an ordinary shuffle join.

Loops need no such split: they read and write tables, so both sides of their joins are plain shuffles of scans, and
adaptive execution splits a hot partition of such a join by itself. What it cannot split, a join whose other side comes
out of an aggregation, goes through this module or is written first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.plans.shared import cut

#: Most keys that are treated as heavy: the bound of what is broadcast. Beyond it a key has less than 1/MAX_HEAVY of all rows.
MAX_HEAVY = 1000
#: Rows from which a key may be heavy.
HEAVY_ROWS = 50_000


def heavy_keys(rows: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The keys with at least heavy_rows rows, the largest max_heavy of them, as a written table of one column.

    Counted with map-side combination. A key outside the table has fewer than heavy_rows rows or less than one part in
    max_heavy of all. Null keys are left out.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    top = counts.filter(F.col("__n") >= heavy_rows).orderBy(F.desc("__n"), key).limit(max_heavy)
    return cut(top.select(key), "heavy")


def split_by(rows: DataFrame, heavy: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows of the heavy keys, and all other rows (null keys too)."""
    few = F.broadcast(heavy)  # at most MAX_HEAVY rows
    return rows.join(few, key, "left_semi"), rows.join(few, key, "left_anti")


def anti_join(rows: DataFrame, known: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """rows whose key isn't in `known` (unique keys). Rows without a key have no counterpart and stay."""
    known_heavy = F.broadcast(known.join(F.broadcast(heavy), key, "left_semi"))
    hot, cold = split_by(rows, heavy, key)
    return hot.join(known_heavy, key, "left_anti").unionByName(cold.join(known, key, "left_anti"))


def lookup_join(rows: DataFrame, unique: DataFrame, key: str, heavy: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of `unique` (one row a key) by a left or inner join."""
    unique_heavy = F.broadcast(unique.join(F.broadcast(heavy), key, "left_semi"))
    hot, cold = split_by(rows, heavy, key)
    return hot.join(unique_heavy, key, how).unionByName(cold.join(unique, key, how))
