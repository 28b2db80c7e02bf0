"""Joins that hold when a few keys own most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 64  # so many keys are looked up by broadcast; any other has less than one row in so many


def hottest_keys(df: DataFrame, key: str, most: int = HOT_KEYS) -> list:
    """The ``most`` most frequent non-null values of a column, counted over all rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.orderBy(F.desc("_n"), key).limit(most).collect()]


def skew_left_join(left: DataFrame, right: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """``left`` left-joined to ``right`` on the column ``key``, of which ``right`` has each value once.

    The rows of ``right`` for the keys ``hot`` (at most :data:`HOT_KEYS` rows, whatever the size; by default the most
    frequent keys of ``left``) are broadcast; all other rows meet in a shuffle, in which no key is hot. Null keys match
    nothing. Column names other than ``key`` must not clash.
    """
    hot = hottest_keys(left, key) if hot is None else hot
    if not hot:  # given as empty: no key is frequent enough to matter, or the right side is small enough to be broadcast
        return left.join(right, key, "left")
    if len(hot) > HOT_KEYS:
        raise ValueError(f"more than {HOT_KEYS} hot keys")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, "left")
    cold = left.where(~is_hot).join(right.where(~F.col(key).isin(hot)), key, "left")
    return warm.unionByName(cold)
