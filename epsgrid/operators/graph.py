"""Views of the neighbour graph and of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgrid.functions.scalars import cell
from epsgrid.operators.neighbors import grid_pairs, grid_width, near_lists, pairs_between
from epsgrid.operators.places import at_points, places
from epsgrid.operators.prefix import prefix_sums
from epsgrid.operators.skew import dealt


def degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, num_nbs)``, zeros included."""
    counts = edges.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"))
    return points.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("num_nbs"))


def place_degrees(at: DataFrame, eps: float) -> DataFrame:
    """``(x, y, n, num_nbs)`` of places ``(id, x, y, n)``; each of a place's n points has ``num_nbs`` neighbours.

    The edges of the radius graph are counted as they arise, by place, and never written.
    """
    u, v = (at.select(F.col("id").alias(a), F.col("x").alias(f"{a}x"), F.col("y").alias(f"{a}y"), *more) for a, more in (("u", []), ("v", ["n"])))
    counts = grid_pairs(u, v, eps).groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("_others"))
    return at.join(dealt(counts), "id", "left").select("x", "y", "n", (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).cast("long").alias("num_nbs"))


def radius_degrees(points: DataFrame, eps: float) -> DataFrame:
    """As ``degrees`` of the radius graph, none of whose edges is written."""
    return at_points(points, place_degrees(places(points), eps)).select("id", "num_nbs")


def radius_edge_total(points: DataFrame, eps: float) -> DataFrame:
    """As ``edge_total`` of the radius graph."""
    return place_degrees(places(points), eps).agg(F.coalesce(F.sum(F.col("n") * F.col("num_nbs")), F.lit(0)).cast("long").alias("edges"))


def radius_start_positions(points: DataFrame, eps: float) -> DataFrame:
    """As ``start_positions`` of the radius graph."""
    return prefix_sums(radius_degrees(points, eps), ["id"], "num_nbs", "start_pos")


#: Ids in a piece of a list's text.
PIECE = 64


def _at_each(lists: DataFrame, text: bool) -> DataFrame:
    """The points of ``near_lists`` with their other columns, ``num_nbs`` and ``neighbours``, which leave out the point.

    As ``text`` a list is ids joined by commas: written once a place, in pieces, of which a point rewrites the one that it is in.
    """
    if not text:
        each = lists.select(F.explode("u").alias("u"), "near").select("u.*", "near")
        each = each.withColumn("neighbours", F.array_remove("near", F.col("id"))).drop("near")
        return each.withColumn("num_nbs", F.size("neighbours").cast("long"))
    join = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    part = lambda i: F.slice("near", i, PIECE)
    pieces = F.transform(F.sequence(F.lit(1), F.size("near"), F.lit(PIECE)), lambda i: F.struct(F.element_at(part(i), 1).alias("low"), F.element_at(part(i), -1).alias("high"), join(part(i)).alias("text")))
    each = lists.select("u", F.size("near").alias("n"), pieces.alias("pieces")).select(F.explode("u").alias("u"), "n", "pieces").select("u.*", "n", "pieces")
    rest = lambda p: F.array_remove(F.split(p["text"], ","), F.col("id").cast("string"))
    own = lambda p: F.when((p["low"] > F.col("id")) | (p["high"] < F.col("id")), p["text"]).when(F.size(rest(p)) > 0, F.array_join(rest(p), ","))
    each = each.withColumn("neighbours", F.array_join(F.transform("pieces", own), ",")).drop("pieces")
    return each.withColumn("num_nbs", (F.col("n") - 1).cast("long")).drop("n")


def radius_adjacency(points: DataFrame, eps: float, text: bool = False) -> DataFrame:
    """As ``adjacency`` of the radius graph: each place's list is built once, and a point leaves itself out."""
    return _at_each(near_lists(points, eps), text).select("id", "num_nbs", "neighbours")


def radius_csr(points: DataFrame, eps: float, text: bool = False) -> DataFrame:
    """As ``csr`` of the radius graph; positions come first, so that no point's list is moved for them."""
    counted = at_points(points, place_degrees(places(points), eps)).select("id", "x", "y", "num_nbs")
    placed = prefix_sums(counted, ["id"], "num_nbs", "start_pos")
    return _at_each(near_lists(placed, eps, "start_pos"), text).select("id", "num_nbs", "start_pos", "neighbours")


def radius_foreign_ends(points: DataFrame, known: DataFrame, eps: float) -> DataFrame:
    """As ``foreign_ends`` for the radius graph of ``points``, of which only ``known`` count as points.

    Pairs of two known points are never made.
    """
    ids = dealt(known.select("id"))
    unknown = points.join(ids, "id", "left_anti")
    return pairs_between(unknown, points, eps).union(pairs_between(points.join(ids, "id", "left_semi"), unknown, eps))


def edge_total(edges: DataFrame) -> DataFrame:
    """Directed edges, twice the pairs."""
    return edges.agg(F.count("*").alias("edges"))


def adjacency(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, num_nbs, neighbours)`` with ascending neighbours, empty where there are none."""
    lists = edges.groupBy(F.col("u").alias("id")).agg(F.sort_array(F.collect_list("v")).alias("n"))
    out = points.select("id").join(lists, "id", "left").select("id", F.coalesce("n", F.array().cast("array<bigint>")).alias("neighbours"))
    return out.select("id", F.size("neighbours").cast("long").alias("num_nbs"), "neighbours")


def csr(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, num_nbs, start_pos, neighbours)`` of the compressed rows in id order."""
    return prefix_sums(adjacency(points, edges), ["id"], "num_nbs", "start_pos").select("id", "num_nbs", "start_pos", "neighbours")


def start_positions(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, num_nbs, start_pos)``; lists are never built."""
    return prefix_sums(degrees(points, edges), ["id"], "num_nbs", "start_pos")


def foreign_ends(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no point; a valid graph has none."""
    ids = points.select("id")
    bad = edges.join(ids, edges["u"] == ids["id"], "left_anti").union(edges.join(ids, edges["v"] == ids["id"], "left_anti"))
    return bad.distinct()


def check_edges(points: DataFrame, edges: DataFrame) -> None:
    if row := foreign_ends(points, edges).first():
        raise ValueError(f"edge {row['u']} to {row['v']} leaves the point table")


def cells(points: DataFrame, eps: float) -> DataFrame:
    """``(cx, cy, n)``: occupied cells only."""
    w = grid_width(eps)
    return points.select(cell(F.col("x"), w).alias("cx"), cell(F.col("y"), w).alias("cy")).groupBy("cx", "cy").agg(F.count("*").alias("n"))


def cell_starts(points: DataFrame, eps: float) -> DataFrame:
    """``(cx, cy, n, start_pos)`` with cells in row-major order."""
    return prefix_sums(cells(points, eps), ["cy", "cx"], "n", "start_pos")


def grid_extent(points: DataFrame, eps: float) -> DataFrame:
    """The bounds moved out by half of ``eps``, and the rows and columns of a dense grid over them with a margin."""
    half, wide = F.lit(eps).cast("float") / 2, F.lit(eps).cast("float").cast("double")
    low = lambda c: (F.col(f"min_{c}") - half.cast("float")).alias(f"low_{c}")
    high = lambda c: (F.col(f"max_{c}") + half.cast("float")).alias(f"high_{c}")
    size = lambda c: (F.ceil(((F.col(f"high_{c}") - F.col(f"low_{c}")).cast("double") / wide).cast("float")) + 2).cast("long")
    moved = bounds(points).select(low("x"), high("x"), low("y"), high("y"))
    return moved.select("*", size("y").alias("grid_rows"), size("x").alias("grid_cols"))


def bounds(points: DataFrame) -> DataFrame:
    """Least and largest coordinates and the number of points."""
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count("*").alias("n"))
