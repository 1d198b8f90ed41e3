import pytest
from pyspark.sql import functions as F

from epsgrid.sources import sinks
from epsgrid.sources.blobs import blobs, standardise
from epsgrid.sources.points import from_dataframe, parse_lines, read_labels, read_points, rejected_lines


def lines(spark, *text):
    return spark.createDataFrame([(x,) for x in text], "value string")


def test_point_file_is_read(spark, tmp_path):
    (tmp_path / "p.txt").write_text("3\n0 1.0 2.0\n1 2.5 -3\n2 1e2 .5\n")
    rows = sorted(read_points(spark, str(tmp_path / "p.txt"), strict_count=True).collect())
    assert [tuple(r) for r in rows] == [(0, 1.0, 2.0), (1, 2.5, -3.0), (2, 100.0, 0.5)]


def test_count_that_differs_is_told_only_on_request(spark, tmp_path):
    (tmp_path / "p.txt").write_text("5\n0 1 2\n")
    assert read_points(spark, str(tmp_path / "p.txt")).count() == 1
    with pytest.raises(ValueError, match="5 points and holds 1"):
        read_points(spark, str(tmp_path / "p.txt"), strict_count=True)


def test_malformed_lines_are_left_out_and_counted(spark):
    df = lines(spark, "4", "0 1 2", "1 x 2", "2 3", "  3   4  5  ", "", "a 1 2", "4 nan 1", "5 Infinity 1")
    assert sorted(r["id"] for r in parse_lines(df).collect()) == [0, 3]
    assert {r["kind"]: r["n"] for r in rejected_lines(df).collect()} == {"header": 1, "point": 2, "rejected": 6}


def test_double_precision_keeps_digits(spark):
    df = lines(spark, "0 0.123456789 1")
    assert parse_lines(df, double_precision=True).first()["x"] == 0.123456789
    assert parse_lines(df).first()["x"] != 0.123456789


def test_bad_coordinates_and_duplicate_ids(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (None, 1.0, 1.0), (1, 0.5, 2.0)], "a long, b double, c double")
    assert sorted(r["id"] for r in from_dataframe(df, "a", "b", "c").collect()) == [1, 1]
    assert [tuple(r) for r in from_dataframe(df, "a", "b", "c", on_duplicate="first").collect()] == [(1, 0.5, 2.0)]
    with pytest.raises(ValueError, match="not finite"):
        from_dataframe(df, "a", "b", "c", on_bad="raise")
    with pytest.raises(ValueError, match="id 1 comes 2 times"):
        from_dataframe(df, "a", "b", "c", on_duplicate="raise")


def test_point_and_label_files_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(2, 1.5, 2.0), (0, -1.0, 0.25), (1, 3.0, 4.0)], "id long, x float, y float")
    sinks.write_points(points, str(tmp_path / "points"))
    assert sorted(map(tuple, read_points(spark, str(tmp_path / "points"), strict_count=True).collect())) == [(0, -1.0, 0.25), (1, 3.0, 4.0), (2, 1.5, 2.0)]
    labels = spark.createDataFrame([(2, 1), (0, -1), (1, 0)], "id long, cluster_id long")
    sinks.write_labels(labels, str(tmp_path / "labels"))
    assert [r["cluster_id"] for r in sorted(read_labels(spark, str(tmp_path / "labels")).collect())] == [-1, 0, 1]


def test_blobs_are_standardised(spark):
    df = blobs(spark, 4000, 2.2)
    m = df.agg(F.avg("x"), F.stddev_pop("x"), F.avg("y"), F.stddev_pop("y"), F.count("*")).first()
    assert m[4] == 4000
    assert abs(m[0]) < 1e-5 and abs(m[2]) < 1e-5 and abs(m[1] - 1) < 1e-5 and abs(m[3] - 1) < 1e-5
    flat = spark.createDataFrame([(0, 3.0, 1.0), (1, 3.0, 2.0)], "id long, x float, y float")
    assert sorted(tuple(r) for r in standardise(flat).collect()) == [(0, 0.0, -1.0), (1, 0.0, 1.0)]


def test_command_line(spark, tmp_path, capsys):
    from epsgrid.plans.cli import main

    main(["generate", "--output-name", str(tmp_path / "p"), "--n-samples", "300"], spark)
    main(["cluster", "-i", str(tmp_path / "p"), "-r", "0.2", "-n", "5", "--print", "-o", str(tmp_path / "l"), "--algorithm", "kd_tree"], spark)
    told, *labels = capsys.readouterr().out.strip().split("\n")
    assert told.startswith("300 points") and len(labels) == 300
    assert [r["cluster_id"] for r in read_labels(spark, str(tmp_path / "l")).orderBy("line").collect()] == [int(x) for x in labels]
