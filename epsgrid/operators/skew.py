"""Equi-joins in which a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than HOT_ROWS rows and more than one of HOT_KEYS equal shares of all rows.
HOT_ROWS, HOT_KEYS = 1000, 1000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt by the key, never broadcast.

    The planner takes a table for as large as its files, which after compression, and before
    ``explode``, say little of the rows that a broadcast would hold in the driver.
    """
    return df.hint("merge")


def join_unique(many: DataFrame, one: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row a key and in ``rows`` how many rows of ``many`` have it.

    Rows of hot keys stay where they are and meet a broadcast of at most HOT_KEYS rows; only the
    others are dealt by their key. Both tables are read twice, so they should be staged.
    """
    total = one.agg(F.sum(rows).alias("n")).first()["n"] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    one = one.withColumn("_hot", F.col(rows) > limit).drop(rows)
    hot, cold = one.where("_hot").drop("_hot"), one.where("not _hot").drop("_hot")
    if not total or one.where("_hot").isEmpty():
        return many.join(cold, on)
    ids = F.broadcast(hot.select(*on))
    return many.join(F.broadcast(hot), on).unionByName(many.join(ids, on, "left_anti").join(cold, on))
