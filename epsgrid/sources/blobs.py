"""Synthetic clusters: Gaussian blobs around a five by four lattice, standardised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.functions.scalars import standardised

#: Columns, rows and spacing of the centres.
COLUMNS, ROWS, SPACING = 5, 4, 10.0


def standardise(points: DataFrame, double_precision: bool = True) -> DataFrame:
    """Points with both coordinates as z-scores over the table (one row of sums is joined to all)."""
    sums = points.agg(F.avg(F.col("x").cast("double")).alias("mx"), F.stddev_pop(F.col("x").cast("double")).alias("sx"), F.avg(F.col("y").cast("double")).alias("my"), F.stddev_pop(F.col("y").cast("double")).alias("sy"))
    kind = "double" if double_precision else "float"
    z = lambda v: standardised(F.col(v).cast("double"), F.col(f"m{v}"), F.col(f"s{v}")).cast(kind).alias(v)
    return points.crossJoin(F.broadcast(sums)).select("id", z("x"), z("y"))


def blobs(spark: SparkSession, n_samples: int = 500, cluster_std: float = 2.0, seed: int = 42) -> DataFrame:
    """``n_samples`` points, dealt evenly to the centres, as ``(id, x float, y float)``."""
    centre = F.col("id") % (COLUMNS * ROWS)
    raw = spark.range(n_samples).select(
        "id",
        (centre % COLUMNS * SPACING + F.randn(seed) * cluster_std).alias("x"),
        (F.floor(centre / COLUMNS) * SPACING + F.randn(seed + 1) * cluster_std).alias("y"),
    )
    return standardise(raw, double_precision=False)
