"""Text sinks and the layers of a scatter plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgrid.functions.scalars import fixed


def point_lines(points: DataFrame) -> DataFrame:
    """``(id, value)`` with the point's line in a point file, six decimals."""
    return points.select("id", F.concat_ws(" ", F.col("id").cast("string"), fixed(F.col("x"), 6), fixed(F.col("y"), 6)).alias("value"))


def write_points(points: DataFrame, path: str) -> None:
    """A point file: the count, then the points in id order; the parts of the folder ``path`` follow each other."""
    head = points.agg(F.count("*").cast("string").alias("value")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), "value")
    body = point_lines(points).select(F.lit(1).alias("part"), "id", "value")
    head.union(body).repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("value").write.text(path)


def label_lines(labels: DataFrame) -> DataFrame:
    """``(id, value)`` with each point's label as text."""
    return labels.select("id", F.col("cluster_id").cast("string").alias("value"))


def write_labels(labels: DataFrame, path: str) -> None:
    """One label a line; the parts of the folder in turn are in id order."""
    label_lines(labels).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def scatter_layers(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, x, y, cluster_id, layer)``: core points large, border points small, noise black."""
    layer = F.when(F.col("membership") == "Core", "large").when(F.col("membership") == "Border", "small").otherwise("black")
    return points.join(labels, "id").select("id", "x", "y", "cluster_id", layer.alias("layer"))
