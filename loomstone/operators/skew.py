"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is heavy when it holds more than one part in HEAVY_PARTS of the rows, so at most HEAVY_PARTS keys are heavy.
HEAVY_PARTS = 200
#: Below this many rows a key is never worth splitting.
HEAVY_FLOOR = 20_000


def heavy_keys(left: DataFrame, key: str, rows: int) -> DataFrame:
    """Keys above the heavy threshold; at most ``HEAVY_PARTS`` of them whatever the input size."""
    limit = max(HEAVY_FLOOR, rows // HEAVY_PARTS)
    return left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key)


def lookup(left: DataFrame, key: str, right: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (unique by ``key``), splitting heavy keys off the shuffle.

    Heavy keys are counted with map-side partial sums; their (at most
    ``HEAVY_PARTS``) right-hand rows are broadcast, all other rows take the
    shuffle join. ``rows`` is the row count of ``left``. ``how`` is ``inner``
    or ``left``. Null keys match nothing. Empty inputs give an empty result.
    """
    if rows <= HEAVY_FLOOR:
        return left.join(right, key, how)
    hot = heavy_keys(left, key, rows)
    hot_right = right.join(F.broadcast(hot), key, "left_semi")
    head = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_right), key, how)
    tail = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return head.unionByName(tail)
