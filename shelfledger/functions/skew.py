"""Joins against tables that were grouped by the join key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def splittable(lookup: DataFrame) -> DataFrame:
    """``lookup`` with its partitioning given up, for the small side of a join.

    The adaptive skew join splits a hot key only if both sides of the join come
    straight from a shuffle.  A lookup grouped or joined by the same key already
    has the right partitioning, so no shuffle would stand between it and the
    join, and a key with a third of all facts would stay in one task.  One more
    shuffle of the lookup, which holds a row per key, lifts that.
    """
    return lookup.hint("rebalance")
