"""A join with a table of distinct keys, of which one may belong to a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of all rows from which a key is hot, so that there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``table`` on ``key``; the column ``weight`` of ``table`` is dropped.

    ``table`` holds each key of ``rows`` once, and in ``weight`` the number of rows that have it. Keys of at
    least ``HOT_SHARE`` of the rows, 1,000 at most, are broadcast and join where the rows are; the rows of
    all other keys are shuffled, none of which can fill a task. ``rows`` and ``table`` are read twice, so
    both should be written tables. Rows with a null key go, as in any inner join; of an empty table nothing is hot.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) >= total * HOT_SHARE
    hot = F.broadcast(table.where(is_hot).drop(weight))
    light = table.where(~is_hot).drop(weight)
    settled = rows.join(hot, key)
    others = rows.join(F.broadcast(table.where(is_hot).select(key)), key, "left_anti")
    return settled.unionByName(others.join(light, key))
