"""Point tables: scans of text files and of any DataFrame, and the checks they pass.

A point table is ``(id bigint, x float, y float)``, or double coordinates on request. Ids are any
distinct integers; no row is ever invented for a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.operators.prefix import prefix_sums

FINITE = "x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')"


#: The one predicate by which a line is a point; its columns are those of ``_read``.
POINT = f"n = 3 and id is not null and {FINITE}"
#: A line's place in the file or folder, of ``_lines``.
_ORDER = ["file", "split", "at"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, split, at)``. Tasks are given splits by size, so row numbers follow the lines only inside a split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))


def _read(lines: DataFrame, value: str, double_precision: bool) -> DataFrame:
    """``(n, number, id, x, y)``: tokens of each line, its number if it is one, and the first three tokens as a point."""
    kind = "double" if double_precision else "float"
    rows = lines.select(F.split(F.trim(F.col(value)), r"\s+").alias("p"))
    token = lambda i, t, c: F.expr(f"try_cast(get(p, {i}) as {t})").alias(c)
    return rows.select(F.size("p").alias("n"), F.when(F.size("p") == 1, F.expr("try_cast(p[0] as bigint)")).alias("number"), token(0, "bigint", "id"), token(1, kind, "x"), token(2, kind, "y"))


def parse_lines(lines: DataFrame, value: str = "value", double_precision: bool = False) -> DataFrame:
    """Points of lines ``id x y``; lines of another form (the count in the first line too) are left out."""
    return _read(lines, value, double_precision).where(POINT).select("id", "x", "y")


def rejected_lines(lines: DataFrame, value: str = "value", double_precision: bool = False) -> DataFrame:
    """How many lines are the count line, points as ``parse_lines`` has them, and neither: ``(kind, n)``."""
    kind = F.when(F.expr(POINT), "point").when(F.col("number").isNotNull(), "header").otherwise("rejected")
    return _read(lines, value, double_precision).select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def read_points(spark: SparkSession, path: str, double_precision: bool = False, strict_count: bool = False, by_row: bool = False) -> DataFrame:
    """Scan of a point file; with ``strict_count`` the count in its first line must be that of the rows.

    With ``by_row`` the ids in the file are ignored: a point's id is its place among the points, from 0.
    """
    lines = _lines(spark, path)
    points = parse_lines(lines, double_precision=double_precision)
    if by_row:
        rows = lines.select(*_ORDER, F.expr("split(trim(value), '\\\\s+')").alias("p")).where(F.size("p") == 3)
        kind = "double" if double_precision else "float"
        rows = rows.select(*_ORDER, F.expr(f"try_cast(p[1] as {kind})").alias("x"), F.expr(f"try_cast(p[2] as {kind})").alias("y")).where(FINITE)
        points = prefix_sums(rows.withColumn("one", F.lit(1).cast("long")), _ORDER, "one", "id").select("id", "x", "y")
    if strict_count:
        said = lines.where(F.size(F.split(F.trim("value"), r"\s+")) == 1).select(F.expr("try_cast(trim(value) as bigint)").alias("n")).where("n is not null").first()
        found = points.count()
        if said is None or said["n"] != found:
            raise ValueError(f"the file says {said and said['n']} points and holds {found}")
    return points


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One label a line, in id order: ``(line, cluster_id)``."""
    rows = _lines(spark, path).select(*_ORDER, F.trim("value").cast("bigint").alias("cluster_id"))
    rows = rows.where("cluster_id is not null").withColumn("one", F.lit(1).cast("long"))
    return prefix_sums(rows, _ORDER, "one", "line").select("line", "cluster_id")


def from_dataframe(df: DataFrame, id_col: str | Column, x: str | Column, y: str | Column, double_precision: bool = False, on_bad: str = "drop", on_duplicate: str = "ignore") -> DataFrame:
    """A point table from columns or expressions of ``df``.

    Rows without an id or with a coordinate that is null, NaN or infinite are dropped, or raise
    with ``on_bad='raise'``. ``on_duplicate``: 'ignore' trusts the ids, 'raise' counts them first,
    'first' keeps the least ``(x, y)`` of each id.
    """
    kind = "double" if double_precision else "float"
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(id_col).cast("bigint").alias("id"), col(x).cast(kind).alias("x"), col(y).cast(kind).alias("y"))
    good = rows.where("id is not null").where(FINITE)
    if on_bad == "raise" and rows.count() != good.count():
        raise ValueError("points with a null id or a coordinate that is not finite")
    if on_duplicate == "raise":
        twice = good.groupBy("id").count().where("count > 1").first()
        if twice:
            raise ValueError(f"id {twice['id']} comes {twice['count']} times")
    elif on_duplicate == "first":
        good = good.groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y")
    return good
