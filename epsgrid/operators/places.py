"""Places: all points of one coordinate pair as one row.

Points of a place have the same neighbours but for themselves. What is counted, linked or labelled
by place costs pairs of places, however many points share one; copies are met again only where
the rows of a result are those of points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgrid.operators.skew import dealt
from epsgrid.staging import stage

#: Ids of one place in one row; a place with more has several rows, which a skewed join can part.
MEMBERS = 1000


def places(points: DataFrame) -> DataFrame:
    """``(id, x, y, n)``, staged: the smallest id and the number of the points of each place."""
    return stage(points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "x", "y", "n"), "places")


def members(points: DataFrame, a: str, *fields: str) -> DataFrame:
    """``(a, ax, ay)``: the ids of each place in ``a``, at most MEMBERS a row; with ``fields``, structs of those columns."""
    lists = points.groupBy("x", "y").agg(F.collect_list(F.struct(*fields) if fields else F.col("id")).alias("ids"))
    start = F.explode(F.sequence(F.lit(1), F.size("ids"), F.lit(MEMBERS)))
    return lists.select("x", "y", "ids", start.alias("_from")).select(F.slice("ids", F.col("_from"), MEMBERS).alias(a), F.col("x").alias(f"{a}x"), F.col("y").alias(f"{a}y"))


def at_points(points: DataFrame, of_places: DataFrame, how: str = "inner") -> DataFrame:
    """``points`` with what ``of_places (x, y, ..)`` says of their places."""
    return points.join(dealt(of_places), ["x", "y"], how)
