"""Connected components of an undirected edge table, labelled by the smallest vertex id.

Every partition first shrinks its own edges to a spanning forest. What is left is merged in one
task when its counted size is at most ``merge_limit`` rows, and otherwise by alternating
large-star and small-star rounds (Kiveris et al., SoCC 2014), each of which is two aggregations
and two equi-joins over a table that is written and read again between rounds. The edges of a
vertex with a large share of them are not gathered for these joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgrid.operators.skew import join_unique
from epsgrid.staging import stage, unstage

#: Rows of forest that one task may merge (16 bytes a row).
MERGE_LIMIT = 4_000_000
_BUFFER = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and, for each, the smallest vertex of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return nodes, nodes[label]


def _shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    limit = _BUFFER
    for pdf in batches:
        held.append((pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)))
        rows += len(pdf)
        if rows >= limit:
            held = [merged()]
            rows = len(held[0][0])
            limit = rows + _BUFFER
    if held:
        nodes, roots = merged()
        yield pd.DataFrame({"u": nodes, "v": roots})


def shrink(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars ``(u vertex, v smallest vertex)``; memory follows its vertices."""
    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInPandas(_shrink, "u long, v long")


def _star_rounds(edges: DataFrame) -> DataFrame:
    """Stars ``(u, v)`` with v the smallest vertex, roots left out, by large-star and small-star."""
    now = stage(edges.where("u > v").distinct(), "stars")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            return now
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "lows")
        large = stage(join_unique(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "stars")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lows")
        hung = join_unique(large, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, stage(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        unstage(old, low, large, least)


def connected_components(edges: DataFrame, merge_limit: int = MERGE_LIMIT) -> DataFrame:
    """``(id, root)`` for every vertex of ``edges(u, v)``; self-loops name isolated vertices.

    Rows with a null end are ignored; repeated and reversed edges are harmless; no edges, no rows.
    """
    local = stage(shrink(edges.where("u is not null and v is not null")), "forest")
    if merge_limit and local.count() <= merge_limit:
        return shrink(local.coalesce(1)).select(F.col("u").alias("id"), F.col("v").alias("root"))
    stars = _star_rounds(local)
    roots = local.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return roots.join(stars.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
