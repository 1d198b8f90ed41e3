"""Command line: cluster a point file, or generate one."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from epsgrid.operators.clusters import density_clusters, report
from epsgrid.sources.blobs import blobs
from epsgrid.sources.points import read_points
from epsgrid.sources.sinks import write_labels, write_points


#: Option names and defaults below.
def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="epsgrid")
    does = top.add_subparsers(dest="command", required=True)
    run = does.add_parser("cluster", help="label the points of a file")
    run.add_argument("-i", "--input", "--input-name", required=True)
    run.add_argument("-r", "--eps", type=float, default=0.3)
    run.add_argument("-n", "--min-pts", type=int, default=9)
    run.add_argument("-p", "--print", action="store_true", help="print the labels in id order")
    run.add_argument("-o", "--output", help="write the labels to this folder")
    run.add_argument("--algorithm", default="auto", choices=["auto", "cells", "grid", "kd_tree", "l1_band", "brute"])
    run.add_argument("--border-rule", default="first", choices=["first", "last"])
    run.add_argument("-t", "--num-threads", type=int, help="threads of a local master; a cluster's parallelism is its own")
    run.add_argument("--row-ids", action="store_true", help="number the points by their rows and ignore the ids in the file")
    run.add_argument("--double", action="store_true", help="keep coordinates in double precision")
    make = does.add_parser("generate", help="write synthetic points")
    make.add_argument("--output-name", required=True)
    make.add_argument("--n-samples", type=int, default=500)
    make.add_argument("--cluster-std", type=float, default=2.0)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("epsgrid")
    if getattr(args, "num_threads", None):
        builder = builder.master(f"local[{args.num_threads}]")
    spark = spark or builder.getOrCreate()
    if args.command == "generate":
        write_points(blobs(spark, args.n_samples, args.cluster_std), args.output_name)
        return
    began = time.perf_counter()
    points = read_points(spark, args.input, args.double, by_row=args.row_ids).cache()
    points.count()
    read = time.perf_counter()
    labels = density_clusters(points, args.eps, args.min_pts, args.border_rule, args.algorithm).cache()
    row = report(labels).first()
    print(f"{row['n']} points, {row['clusters']} clusters, core {row['core_ratio']}, border {row['border_ratio']}, noise {row['noise_ratio']}, read {read - began:.1f} s, clustered {time.perf_counter() - read:.1f} s")
    if args.output:
        write_labels(labels, args.output)
    if args.print:
        for r in labels.select("id", "cluster_id").orderBy("id").toLocalIterator():
            print(r["cluster_id"])


if __name__ == "__main__":
    main()
