"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up the JVM and its code, then ``REPEATS`` times; the median counts.
A point table is read and held before its clustering is timed, as published timings of this
problem leave out loading; ``scan_events`` times the load itself.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epsgrid.operators import clusters as C
from epsgrid.operators import graph as G
from epsgrid.operators import neighbors as N
from epsgrid.plans.catalogue import CUSTOMER, EMBEDDINGS, EVENTS, PART
from epsgrid.sources.blobs import blobs

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("epsgrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    held = {s.table: s.points(spark, SF).cache() for s in (EVENTS, CUSTOMER, PART, EMBEDDINGS)}
    sized = {"20k": (20_000, 0.15, 180), "50k": (50_000, 0.09, 110), "100k": (100_000, 0.07, 100), "200k": (200_000, 0.05, 100)}
    held |= {f"blobs_{k}": blobs(spark, n, 2.2).cache() for k, (n, _, _) in sized.items()}
    for p in held.values():
        p.count()
    ev = held["events"]
    work: dict[str, Callable[[], DataFrame]] = {
        "scan_events": lambda: EVENTS.points(spark, SF),
        "neighbors_grid_events": lambda: N.neighbors(ev, 0.1),
        "neighbors_l1_band_events": lambda: N.neighbors(ev, 0.1, "l1_band"),
        "degree_events": lambda: G.degrees(ev, N.neighbors(ev, 0.1)),
        "cell_histogram_events": lambda: G.cells(ev, 0.1),
        "clusters_events_eps0.1": lambda: C.density_clusters(ev, 0.1, 10),
        "clusters_events_eps0.1_cells": lambda: C.density_clusters(ev, 0.1, 10, strategy="cells"),
        "clusters_customer": lambda: C.density_clusters(held["customer"], 0.1, 10),
        "clusters_part": lambda: C.density_clusters(held["part"], 2.0, 7),
        "clusters_embeddings": lambda: C.density_clusters(held["embeddings"], 0.03, 8),
    }
    for k, (_, eps, least) in sized.items():
        work[f"clusters_blobs_{k}_eps{eps}"] = lambda k=k, eps=eps, least=least: C.density_clusters(held[f"blobs_{k}"], eps, least)
    took: dict[str, float] = {}
    for name, build in work.items():
        times = []
        for _ in range(REPEATS + 1):
            began = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
