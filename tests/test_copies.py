"""Tables of copies: what a query writes on its way follows the places, or the points, and never their pairs."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__  # noqa: F401
from epsgrid import staging
from epsgrid.operators import graph as G
from epsgrid.operators import neighbors as N
from epsgrid.operators import places as P
from epsgrid.plans.catalogue import QUERIES, SQL
from epsgrid.sources.points import read_labels, read_points
from tests.test_entry import rows

SF, TIMES = "/root/testdata/sf0.001", 12
#: By query: the most rows a staged table may have, as a multiple of the table's rows.
STAGED = {"degree": 0.5, "border_last": 0.5, "clusters_last_rule": 0.9, "clusters_part_grid": 0.9, "clusters_part_brute": 0.9, "clusters_part_cells": 0.5, "clusters_part": 0.5, "clusters_part_l1_band": 0.9, "components": 0.5, "core_points": 0.5, "foreign_ends": 0, "components_by_stars": 0.5, "csr_offsets": 1, "border_first": 0.5, "cluster_numbering": 0.5, "edge_total": 0.5, "csr_view": 1, "core_edges": 0.5, "adjacency_lists": 0.5}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The point tables TIMES over, with shifted keys, and a connection that has them."""
    folder, db = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for table, key in (("events", "event_id"), ("customer", "c_custkey"), ("part", "p_partkey")):
        db.sql(f"COPY (SELECT t.* REPLACE (CAST({key} + i * 1000000 AS BIGINT) AS {key}) FROM range({TIMES}) r(i), '{SF}/{table}.parquet' t) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", STAGED)
def test_no_pair_of_points_is_written(spark, copies, name):
    folder, db = copies
    staging.clear(spark)
    got = rows(QUERIES[name](spark, folder).toPandas())
    table, n = max(((t, db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0]) for t in ("events", "customer", "part")), key=lambda x: x[0] in SQL[name] and x[1])
    most = max([spark.read.parquet(path).count() for path in staging._STAGED], default=0)
    assert got == rows(db.sql(SQL[name]).df())
    assert most <= STAGED[name] * n, table


@pytest.mark.parametrize("strategy", ["grid", "kd_tree", "l1_band", "brute"])
def test_neighbors_of_copies_by_lists(spark, monkeypatch, strategy):
    monkeypatch.setattr(P, "MEMBERS", 2)
    table = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(60)], "id long, x float, y float")
    at = {r["id"]: (r["x"], r["y"]) for r in table.collect()}
    want = sorted((u, v) for u, (a, b) in at.items() for v, (c, d) in at.items() if u != v and (a - c) ** 2 + (b - d) ** 2 <= 1)
    edges = N.neighbors(table, 1.0, strategy)
    assert sorted(map(tuple, edges.collect())) == want
    assert strategy == "brute" or "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()  # of what explode has made nine of


CODEC = "spark.sql.parquet.compression.codec"
#: By query: points, of one place or of 40 near ones, and the most bytes of the written result.
WRITTEN = {"csr_view": (2000, 1_000_000), "adjacency_lists": (2000, 1_000_000), "neighbors_grid": (2000, 500_000), "neighbors_l1_band": (2000, 500_000), "core_edges": (2000, 500_000)}


@pytest.mark.parametrize("name", WRITTEN)
def test_written_results_follow_the_places(spark, tmp_path, name):
    n, most = WRITTEN[name]
    db = duckdb.connect()
    for table, row in (("customer", f"SELECT CAST(i AS BIGINT) AS c_custkey, 1.5::DOUBLE AS c_acctbal, 3 AS c_nationkey FROM range({n}) t(i)"), ("events", f"SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-02 03:04:05' + INTERVAL (i % 40) SECOND AS ts, 1.5::DOUBLE AS value FROM range({n}) t(i)")):
        db.sql(f"COPY ({row}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    before = spark.conf.get(CODEC, None)
    spark.conf.unset(CODEC)
    try:
        QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
        assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) <= most
        spark.conf.set(CODEC, "snappy")  # a codec that the session names stays
        QUERIES[name](spark, SF)
        assert spark.conf.get(CODEC) == "snappy"
    finally:
        spark.conf.unset(CODEC) if before is None else spark.conf.set(CODEC, before)
    files = [f for f in (tmp_path / "out").glob("*.parquet") if pq.read_metadata(f).num_rows]
    assert sum(pq.read_metadata(f).num_rows for f in files) in (n, n * (n - 1))


@pytest.mark.parametrize("eps", [0.0, 1.0])
def test_lists_as_text_and_as_arrays(spark, monkeypatch, eps):
    """Pieces and rows of members that end inside a list, a point with no neighbour, negative ids and ids of other lengths."""
    monkeypatch.setattr(P, "MEMBERS", 2)
    monkeypatch.setattr(G, "PIECE", 3)
    data = [(i * 7 - 100, float(i % 4), float(i % 3)) for i in range(60)] + [(10**12, 50.0, 50.0)]
    table = spark.createDataFrame(data, "id long, x float, y float")
    near = {u: sorted(v for v, c, d in data if u != v and (a - c) ** 2 + (b - d) ** 2 <= eps * eps) for u, a, b in data}
    starts, total = {}, 0
    for u in sorted(near):
        starts[u], total = total, total + len(near[u])
    want = {u: (len(v), starts[u], ",".join(map(str, v))) for u, v in near.items()}
    assert {r["id"]: (r["num_nbs"], r["start_pos"], r["neighbours"]) for r in G.radius_csr(table, eps, text=True).collect()} == want
    assert {r["id"]: (r["num_nbs"], r["start_pos"], r["neighbours"]) for r in G.radius_csr(table, eps).collect()} == {u: (len(v), starts[u], v) for u, v in near.items()}
    assert {r["id"]: (r["num_nbs"], r["neighbours"]) for r in G.radius_adjacency(table, eps, text=True).collect()} == {u: (len(v), ",".join(map(str, v))) for u, v in near.items()}


def test_brute_beyond_its_limit_gives_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BRUTE_POINTS", 5)
    table = spark.createDataFrame([(i, i * 0.5, 0.0) for i in range(30)], "id long, x float, y float")
    assert sorted(map(tuple, N.neighbors(table, 1.0, "brute").collect())) == sorted(map(tuple, N.neighbors(table, 1.0).collect()))


def test_lines_follow_the_parts_of_a_folder(spark, tmp_path):
    at = 0
    for part, n in enumerate((1, 40, 3, 200)):
        (tmp_path / f"part-0000{part}").write_text("".join(f"{i} {i} 0\n" for i in range(at, at + n)))
        (tmp_path / "labels").mkdir(exist_ok=True)
        (tmp_path / "labels" / f"part-0000{part}").write_text("".join(f"{i}\n" for i in range(at, at + n)))
        at += n
    assert all(r["id"] == r["x"] for r in read_points(spark, f"{tmp_path}/part-*", by_row=True).collect())
    assert all(r["line"] == r["cluster_id"] for r in read_labels(spark, f"{tmp_path}/labels").collect())
