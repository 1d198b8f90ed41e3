import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epsgrid.functions import scalars as S
from epsgrid.operators import clusters as C
from epsgrid.operators import graph as G
from epsgrid.operators import neighbors as N
from epsgrid.operators.components import connected_components, forest

#: F1 to F3 and what they give below.
PLANS = ["cells", "grid", "l1_band", "brute"]
F1 = [(1, 2), (2, 2), (2, 3), (8, 7), (8, 8), (25, 80)]
F2 = [(1, 2), (2, 2), (2, 3), (5, 2), (5, 6), (5, 9), (8, 7), (8, 8), (8, 9), (25, 80)]
F3 = [(1, 2), (2, 2), (2, 3), (1, 3), (5, 2), (5, 5), (5, 8), (8, 8), (9, 8), (9, 9), (8, 9)]
F4 = [(0, 0), (0, 1), (0, 2), (3, 1), (6, 0), (6, 1), (6, 2)]


def points(spark, rows, ids=None):
    ids = range(len(rows)) if ids is None else ids
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, rows, strict=True)], "id long, x float, y float")


def labels(df):
    rows = sorted(df.collect())
    return "".join(r["membership"][0] for r in rows), [r["cluster_id"] for r in rows]


def brute(rows, eps, min_pts, rule="first"):
    """The definition, over float32 arrays."""
    a = np.asarray(rows, np.float32).reshape(-1, 2)
    d = (a[:, None, 0] - a[None, :, 0]) ** 2 + (a[:, None, 1] - a[None, :, 1]) ** 2
    near = d <= np.float32(eps) * np.float32(eps)
    np.fill_diagonal(near, False)
    core = near.sum(1) >= min_pts
    label, cluster = [-1] * len(a), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], cluster
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if label[j] < 0:
                        label[j] = cluster
                        todo.append(j)
            cluster += 1
    kind = ""
    for i in range(len(a)):
        found = [label[j] for j in np.flatnonzero(near[i] & core)]
        if core[i]:
            kind += "C"
        elif found:
            kind, label[i] = kind + "B", min(found) if rule == "first" else max(found)
        else:
            kind += "N"
    return kind, label


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize(
    ("rows", "min_pts", "rule", "kinds", "clusters"),
    [
        (F1, 2, "first", "CCCNNN", [0, 0, 0, -1, -1, -1]),
        (F2, 2, "first", "CCCBBCCCCN", [0, 0, 0, 0, 1, 1, 1, 1, 1, -1]),
        (F3, 3, "first", "CCCCBNBCCCC", [0, 0, 0, 0, 0, -1, 1, 1, 1, 1, 1]),
        (F4, 3, "first", "BCBBBCB", [0, 0, 0, 0, 1, 1, 1]),
        (F4, 3, "last", "BCBBBCB", [0, 0, 0, 1, 1, 1, 1]),
    ],
)
def test_golden_inputs(spark, plan, rows, min_pts, rule, kinds, clusters):
    assert labels(C.density_clusters(points(spark, rows), 3.0, min_pts, rule, plan)) == (kinds, clusters)


@pytest.mark.parametrize("seed", range(3))
def test_plans_agree_with_the_definition(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.gauss(c % 3, 0.3), 2), round(rng.gauss(-c, 0.3), 2)) for c in range(5) for _ in range(60)]
    rows += [(rng.uniform(-4, 4), rng.uniform(-6, 2)) for _ in range(40)] + [(1.0, -1.0)] * 25
    rng.shuffle(rows)
    eps, min_pts = [(0.15, 6), (0.25, 9), (0.5, 30)][seed]
    df = points(spark, rows)
    for rule in ("first", "last"):
        want = brute(rows, eps, min_pts, rule)
        for plan in PLANS if rule == "first" else ["cells", "grid"]:
            assert labels(C.density_clusters(df, eps, min_pts, rule, plan)) == want, plan


def test_lattice_at_the_very_bound(spark):
    rows = [(i * 0.1, j * 0.1) for i in range(-8, 8) for j in range(-8, 8)]
    for eps in (0.1, 0.1 * 2**0.5, 0.2):
        assert labels(C.density_clusters(points(spark, rows), eps, 3, strategy="cells")) == brute(rows, eps, 3)


def test_edges_are_symmetric_and_equal_by_every_plan(spark):
    rng = random.Random(9)
    df = points(spark, [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(300)])
    found = {k: {tuple(r) for r in N.neighbors(df, 0.11, k).collect()} for k in N.STRATEGIES}
    assert len(set(map(frozenset, found.values()))) == 1
    assert all((v, u) in found["grid"] and u != v for u, v in found["grid"])


def test_row_order_ids_and_numbering(spark):
    rows = F3
    ids = [90, 7, 55, 3, 1000, -4, 12, 8, 2**40, 6, 13]
    got = {r["id"]: (r["membership"], r["cluster_id"]) for r in C.density_clusters(points(spark, rows[::-1], ids[::-1]), 3.0, 3).collect()}
    kinds, _ = brute(rows, 3.0, 3)
    assert "".join(got[i][0][0] for i in ids) == kinds
    assert got[6][1] == 1 and got[3][1] == 0  # the cluster of the smallest core id is 0
    assert got[-4] == ("Noise", -1)


@pytest.mark.parametrize("plan", ["cells", "grid", "auto"])
def test_edge_cases(spark, plan):
    run = lambda rows, eps, m: labels(C.density_clusters(points(spark, rows), eps, m, strategy=plan))
    assert run([], 1.0, 2) == ("", [])
    assert run([(5, 5)], 1.0, 1) == ("N", [-1])
    assert run([(5, 5)], 1.0, 0) == ("C", [0])
    assert run([(0, 0), (9, 9), (0, 0)], 1.0, 0) == ("CCC", [0, 1, 0])
    assert run([(1, 1)] * 4, 0.5, 3) == ("CCCC", [0] * 4)
    assert run([(1, 1), (1, 1), (1, 1.0001)], 0.0, 1) == ("CCN", [0, 0, -1])
    assert run([(-100, -3), (-100.5, -3), (-99.5, -3)], 0.6, 2) == ("CBB", [0, 0, 0])


def test_parameters_are_checked(spark):
    df = points(spark, F1)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="eps"):
            C.density_clusters(df, bad, 2)
    with pytest.raises(ValueError, match="min_pts"):
        C.density_clusters(df, 1.0, -1)
    with pytest.raises(ValueError, match="border_rule"):
        C.density_clusters(df, 1.0, 1, "middle")
    with pytest.raises(ValueError, match="strategy"):
        C.density_clusters(df, 1.0, 1, strategy="ball_tree")


def test_compressed_rows(spark):
    df = points(spark, F2)
    rows = sorted(G.csr(df, N.neighbors(df, 3.0)).collect())
    assert [r["num_nbs"] for r in rows] == [2, 3, 2, 1, 1, 2, 2, 2, 3, 0]
    assert [r["start_pos"] for r in rows] == [0, 2, 5, 7, 8, 9, 11, 13, 15, 18]
    assert rows[1]["neighbours"] == [0, 2, 3] and rows[9]["neighbours"] == []


def test_compressed_rows_of_given_graphs(spark):
    def run(pairs):
        edges = spark.createDataFrame(pairs, "u long, v long")
        rows = sorted(G.csr(spark.range(5), edges).collect())
        return [r["num_nbs"] for r in rows], [r["start_pos"] for r in rows], [v for r in rows for v in r["neighbours"]]

    assert run([(2, 1), (2, 4), (2, 0), (1, 2), (4, 2), (0, 2), (0, 3), (3, 0)]) == ([2, 1, 3, 1, 1], [0, 2, 3, 6, 7], [2, 3, 2, 0, 1, 4, 0, 2])
    assert run([(0, 2), (1, 2), (2, 0), (2, 1), (2, 4), (4, 2)]) == ([1, 1, 3, 0, 1], [0, 1, 2, 5, 5], [2, 2, 0, 1, 4, 2])
    assert run([]) == ([0] * 5, [0] * 5, [])


def test_foreign_ends_are_refused(spark):
    edges = spark.createDataFrame([(0, 1), (1, 7)], "u long, v long")
    with pytest.raises(ValueError, match="edge 1 to 7"):
        G.check_edges(spark.range(5), edges)


def test_squared_distance(spark):
    rows = [(1, 2, 3, 4), (-1, -4, 4, 1), (0, 0, 4, 1), (1, 2, 2.5, 3.4)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a float, b float, c float, d float")
    got = [r[0] for r in df.select(S.squared_distance(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[:3] == [8.0, 50.0, 17.0] and abs(got[3] - 4.21) < 1e-5


def test_components_by_merge_and_by_stars(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(7, 7), (1000, 1001), (1001, 1002)] + [(500, i) for i in range(501, 560)]
    nodes, roots = forest(np.asarray([a for a, _ in pairs]), np.asarray([b for _, b in pairs]))
    want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(7)
    for limit in (0, 10**6):
        assert {r["id"]: r["root"] for r in connected_components(edges, limit).collect()} == want
    assert connected_components(edges.limit(0), 0).count() == 0


def test_components_around_hot_vertices(spark, monkeypatch):
    from epsgrid.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_KEYS", 9)
    pairs = [(5, i) for i in range(10, 300)] + [(400 + i, 299 + i % 2) for i in range(90)] + [(900, 901), (7, 900)]
    nodes, roots = forest(np.asarray([a for a, _ in pairs]), np.asarray([b for _, b in pairs]))
    found = connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(9), 0).collect()
    assert {r["id"]: r["root"] for r in found} == dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    many = spark.range(200).selectExpr("id % 3 * (id % 2) as k", "id as v")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = sorted(map(tuple, many.join(one.drop("n"), ["k"]).collect()))
    assert sorted(map(tuple, skew.join_unique(many, one, ["k"], "n").collect())) == want and len(want) == 200


def test_report(spark):
    row = C.report(C.density_clusters(points(spark, F2), 3.0, 2)).first()
    assert (row["n"], row["clusters"], row["core"], row["border"], row["noise"]) == (10, 2, 7, 2, 1)
    assert (row["core_ratio"], row["border_ratio"], row["noise_ratio"]) == ("0.700", "0.200", "0.100")
    empty = C.report(C.density_clusters(points(spark, []), 3.0, 2)).first()
    assert empty["n"] == 0 and empty["core_ratio"] == "0.000"


def test_joins_are_equi_joins(spark):
    plan = N.neighbors(points(spark, F2), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_staged_tables_can_be_deleted(spark):
    from epsgrid import staging

    kept, gone = staging.stage(spark.range(5).toDF("id"), "kept"), staging.stage(spark.range(5).toDF("id"), "gone")
    staging.unstage(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        gone.collect()
    staging.clear(spark)
    assert not staging._STAGED
