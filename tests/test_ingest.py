import json

import pytest
from pyspark.sql import functions as F

from scarpline.functions import scalars
from scarpline.operators import polygons
from scarpline.sources import classes, stations, tables, vectors, workspace
from scarpline.streaming import alerts


def test_classes(spark):
    own = classes.standard_classes(spark)
    assert own.count() == 35 and own.filter("class_id = 'tsl12'").first()["class_name"] == "Sand"
    parameters = classes.parameter_classes(spark)
    assert parameters.count() == 13 and parameters.filter("class_id = 'slp05'").first()["gd"] == 15.0 and parameters.filter("class_id = 'vgp03'").first()["cr"] == 10.0


def test_columns_are_found_by_name_and_values(spark):
    own = spark.createDataFrame([("A", "9.1", "45.2", "120"), ("B", "9.3", "45.4", "310")], "Gauge string, Long string, Lat string, Quota string")
    got = stations.read_stations(own).orderBy("station").collect()
    assert [tuple(r) for r in got] == [("A", 9.1, 45.2, 120.0), ("B", 9.3, 45.4, 310.0)]
    with pytest.raises(ValueError):
        stations.read_stations(own.select("Gauge", "Long"))
    swapped = spark.createDataFrame([(5, 1), (6, 2), (1, 3)], "a int, b int")
    assert [tuple(r) for r in stations.ordered_columns(swapped, "a", "b").collect()] == [(1, 5), (2, 6), (3, 1)]


def test_dates_in_any_form(spark):
    own = spark.createDataFrame([("13/02/2024 10:30", "20240213"), ("01/03/2024 00:00", "20240301"), (None, "x")], "a string, b string")
    got = stations.parsed_dates(own, ["a", "b"]).collect()
    assert (got[0]["a"].day, got[0]["a"].minute, got[1]["a"].month, got[0]["b"].day, got[2]["a"], got[2]["b"]) == (13, 30, 3, 13, None, None)


def test_series_are_cleaned_and_filled(spark):
    own = spark.createDataFrame([("2024-01-01 00:00:20", "1"), ("2024-01-01 01:00", "-9999"), ("2024-01-01 02:00", "5000"), ("2024-01-01 03:00", "4"), ("bad", "1")], "Date string, `Rain tot` string")
    got = stations.read_series(own, "cumulative_rain", no_data=[-9999.0], low=0, high=1000, fill="linear").orderBy("ts").collect()
    assert [r["value"] for r in got] == [1.0, 2.0, 3.0, 4.0] and got[0]["ts"].second == 0


def test_stacked_files_give_the_longest_block_of_each_station(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Net;x\nAlpha;\ndate;mm\n2024-01-01;1\n\n2024-02-01;2\n2024-02-02;3\nBeta;\ndate;mm\n2024-01-05;7\n")
    got = stations.read_stacked(spark, str(tmp_path / "s.csv"), ["Alpha", "Beta"]).orderBy("station", "ts").collect()
    assert [(r["station"], r["ts"].month, r["value"]) for r in got] == [("Alpha", 2, 2.0), ("Alpha", 2, 3.0), ("Beta", 1, 7.0)]


def test_files_and_stations(spark):
    files = spark.createDataFrame([("/x/alpha.csv",), ("/x/alpha_beta.csv",), ("/x/none.csv",)], "file string")
    names = spark.createDataFrame([("Alpha",), ("Beta",)], "station string")
    assert {r["file"]: r["station"] for r in stations.match_files(files, names).collect()} == {"/x/alpha.csv": "Alpha", "/x/alpha_beta.csv": "Beta", "/x/none.csv": None}


def test_geojson_round_trip(spark, tmp_path):
    feature = lambda kind, at, name: {"type": "Feature", "properties": {"cls": name, "n": 3}, "geometry": {"type": kind, "coordinates": at}}
    box = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [box, hole], "a"), feature("MultiPolygon", [[box], [[[9, 9], [10, 9], [10, 10], [9, 9]]]], "b"), feature("Point", [1, 2], "p"), feature("LineString", [[0, 0], [1, 1]], "l"), feature("Polygon", [], "e")]}))
    layer = vectors.read_geojson(spark, str(tmp_path / "l.geojson"), "cls")
    got = {r["poly_id"]: r["area"] for r in polygons.measures(vectors.polygon_rings(layer, "class_name")).collect()}
    assert got == {"a": 15.0, "b": 16.5}
    assert vectors.read_geojson(spark, str(tmp_path / "l.geojson"), "cls", only_polygons=False).count() == 4
    assert [r[0] for r in vectors.field_values(layer).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        vectors.read_geojson(spark, str(tmp_path / "l.geojson"), "cls", ["zz"])
    again = vectors.to_geojson(vectors.polygon_rings(layer, "class_name")).collect()
    assert {r["poly_id"]: len(json.loads(r["value"])["geometry"]["coordinates"]) for r in again} == {"a": 1, "b": 2}


def test_workspace(spark, tmp_path):
    root = str(tmp_path / "w")
    workspace.save(spark.range(3), root, "cells", "first")
    workspace.save(spark.range(5), root, "cells", "second")
    assert workspace.load(spark, root, "cells").count() == 5
    assert [(r["dataset"], r["label"]) for r in workspace.catalog(spark, root).collect()] == [("cells", "second")]
    with pytest.raises(KeyError):
        workspace.load(spark, root, "none")
    empty = spark.createDataFrame([], workspace.REGISTRY)
    one = workspace.add_input(workspace.add_input(empty, "/a", "rain", "recordings"), "/b", "rain", "forecast")
    assert sorted(r["custom_id"] for r in one.collect()) == ["RAI001", "RAI002"]
    with pytest.raises(ValueError):
        workspace.add_input(one, "/c", "rain", "forecast")
    assert [tuple(r) for r in workspace.input_paths(workspace.add_input(one, "/c", "rain", "forecast", replace=True), "rain", "forecast").collect()] == [("RAI002", "/c")]
    workspace.export_csv(spark.sql("SELECT 1 AS k, array(1, 2) AS v"), root + "/csv", ["k"])
    assert spark.read.csv(root + "/csv", header=True).first()["v"] == "[1,2]"


def test_lookups(spark):
    own = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert [tuple(r) for r in tables.looked_up(own, keys("a"), "k", "v").collect()] == [("a", 1)]
    for wrong in ("b", "c"):
        with pytest.raises(Exception, match="exactly one"):
            tables.looked_up(own, keys(wrong), "k", "v").collect()
    met = {r["k"]: (r["found"], r["same_v"]) for r in tables.column_containment(own.filter("v < 3"), spark.createDataFrame([("a", 9)], "k string, v int"), ["k", "v"]).collect()}
    assert met == {"a": (True, False), "b": (False, False)}
    assert tables.selected("1, 3:4;z", ["p", "q", "r", "s", "z"]) == ["p", "r", "s", "z"]
    got = spark.createDataFrame([(10.0, 45.0), (190.0, 0.0)], "lon double, lat double").agg(scalars.are_geographic(F.col("lon"), F.col("lat")), scalars.is_ordered(F.col("lat"))).first()
    assert tuple(got) == (False, True)


def test_streams_give_what_the_same_rows_give_at_once(spark, tmp_path):
    rows = [("S", f"2024-01-01 {h:02d}:10:00", float(h)) for h in range(12)] + [("S", "2024-01-20 00:00:00", 9.0), ("T", "2024-01-01 03:00:00", 50.0), ("S", "2024-01-01 03:10:00", 3.0), ("T", "2024-03-01 00:00:00", 0.0)]
    table = spark.createDataFrame(rows, "station string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    limits = spark.createDataFrame([("S", 5.0), ("T", 10.0)], "station string, threshold double")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    stream = lambda: alerts.clean(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    sums = {(r["station"], r["start_ts"].day, r["start_ts"].hour): (r["n"], r["total"]) for r in run(alerts.window_sums(stream(), "6 hours"), "sums") if r["start_ts"].month == 1}
    assert sums == {("S", 1, 0): (6, 15.0), ("S", 1, 6): (6, 51.0), ("S", 20, 0): (1, 9.0), ("T", 1, 0): (1, 50.0)}
    found = {(r["station"], r["start_ts"].day, r["start_ts"].hour): (r["end_ts"].hour, r["n"], r["peak"]) for r in run(alerts.events(alerts.exceedances(stream(), limits)), "events")}
    assert found == {("S", 1, 5): (11, 7, 11.0), ("S", 20, 0): (0, 1, 9.0), ("T", 1, 3): (3, 1, 50.0)}
