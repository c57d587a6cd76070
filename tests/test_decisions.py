"""Joins, gates and composites on small hand-made tables."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ridgeline.conf import Thresholds
from ridgeline.functions import geometry as G
from ridgeline.functions import overlay, projection, scalars
from ridgeline.operators import decision, evidence, footprints, lidar, matching, planes, points, roof
from ridgeline.plans import measurement
from ridgeline.sources import readers, sinks
from ridgeline.streaming import requests


def value(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_box_pairs_come_once_and_all(spark):
    rng = [(i, float(i * 37 % 50), float(i * 53 % 40), i % 9 + 0.5, i % 7 + 0.5) for i in range(60)]
    boxes = spark.createDataFrame([(i, x, y, x + w, y + h) for i, x, y, w, h in rng], "a long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in matching.box_pairs(boxes, boxes.withColumnRenamed("a", "b"), 6.0).select("a", "b").collect())
    meet = lambda p, q: p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3] and p[2] <= q[2] + q[4] and q[2] <= p[2] + p[4]
    assert got == sorted((p[0], q[0]) for p in rng for q in rng if meet(p, q))


def test_equal_outlines_keep_the_first(spark):
    square, other = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(4.0, 4.0), (4.0, 0.0), (0.0, 0.0), (0.0, 4.0)]
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
    rows = spark.createDataFrame([("r", 9, square), ("r", 3, other), ("r", 1, bow)], "request_id string, candidate_id int, ring array<struct<x:double,y:double>>")
    assert [r["candidate_id"] for r in footprints.usable(rows).collect()] == [3]


def test_small_areas_far_from_the_origin(spark):
    ring = F.array(*[G.point(-81.5 + dx, 26.5 + dy) for dx, dy in ((0, 0), (1e-4, 0), (1e-4, 1e-4), (0, 1e-4))])
    assert value(spark, G.ring_area(ring))[0] == pytest.approx(1e-8, rel=1e-9)
    assert value(spark, overlay.coverage_ratio(ring, ring, G.ring_area(ring)))[0] == pytest.approx(1, abs=1e-9)


def test_clip_hausdorff_and_edge_parameter(spark):
    u = F.array(*[G.point(x, y) for x, y in ((0, 0), (9, 0), (9, 8), (6, 8), (6, 3), (3, 3), (3, 8), (0, 8))])
    clipped = G.clip_convex(u, F.lit(1.0), F.lit(1.0), F.lit(8.0), F.lit(6.0))
    moved = F.transform(u, lambda p: G.named(x=p["x"] + 0.5, y=p["y"]))
    end = lambda x: G.point(x, 0, 0)
    got = value(spark, G.ring_area(clipped), G.hausdorff(u, moved), G.edge_parameter(G.point(2.5, 0.05, 0), end(0), end(10), 0.1), G.edge_parameter(G.point(2.5, 0.5, 0), end(0), end(10), 0.1))
    assert got[0] == pytest.approx(7 * 5 - 3 * 3) and got[1] == pytest.approx(0.5) and got[2] == pytest.approx(0.25) and got[3] is None


def test_scalars_nobody_else_calls(spark):
    box = projection.search_box(F.lit(-82.0), F.lit(0.0), 111_320.0)
    got = value(spark, scalars.county_name(F.lit(" De Soto  county ")), scalars.serial_date(F.lit(45000.7)), scalars.content_id(F.lit("{}")), scalars.gps_dates(F.lit(86400.0))[0], box)
    assert got[0] == "DeSoto" and got[1] == date(2023, 3, 15) and got[2].startswith("geometry-") and len(got[2]) == 33 and got[3] == date(1980, 1, 7)
    assert got[4]["x1"] == pytest.approx(-81) and got[4]["y0"] == pytest.approx(-1)


def test_sources_are_judged_by_county(spark):
    asked = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "request_id int, county string")
    day = date(2020, 1, 1)
    registry = spark.createDataFrame(
        [(1, "A", True, "CC0", day, 1.0, 8.0, 1), (2, "A", True, "CC0", date(2021, 1, 1), 0.99, 8.0, 1), (3, "A", False, "CC0", day, 1.0, 8.0, 1), (4, "B", True, " pending", day, 1.0, 8.0, 1), (5, "B", True, "CC0", day, None, 8.0, 1)],
        "source_id int, county string, enabled boolean, license string, acquired_end date, coverage double, density double, priority int",
    )
    audit = {(r["request_id"], r["source_id"]): r["decision"] for r in lidar.decide(asked, registry).collect()}
    assert len(audit) == 15 and audit[1, 2] == "CANDIDATE" and audit[2, 4] == "REJECTED_LICENSE_UNVERIFIED" and audit[2, 5] == "SOURCE_UNAVAILABLE" and {audit[3, s] for s in range(1, 6)} == {"SKIPPED_DISABLED_OR_COUNTY"}
    assert [(r["request_id"], r["source_id"], r["rank"]) for r in lidar.candidates(asked, registry).orderBy("rank").collect()] == [(1, 2, 1), (1, 1, 2)]
    got = {r["request_id"]: r for r in measurement.selections(asked, registry).collect()}
    assert got[1]["first_source"] == 2 and got[2]["code"] == "LIDAR_SOURCES_TEMPORARILY_UNAVAILABLE" and got[3]["code"] == "NO_LIDAR_COVERAGE"
    assert measurement.waves(asked.withColumn("code", F.lit(None).cast("string")), registry).count() == 2


def test_winner_stops_the_log(spark):
    rows = [("a", 1, 7, "LIDAR_CROP_EMPTY"), ("a", 2, 8, None), ("a", 3, 9, "GEOMETRY_COMMAND_TIMEOUT"), ("b", 1, 7, "LIDAR_CROP_EMPTY"), ("b", 2, 8, "NO_USABLE_ROOF_RETURNS"), ("c", 1, 7, "LIDAR_DENSITY_TOO_LOW"), ("d", 1, 7, "LIDAR_CROP_EMPTY"), ("d", 2, 8, "PROVIDER_HTTP_ERROR")]
    got = {r["request_id"]: r for r in measurement.winners(spark.createDataFrame(rows, "request_id string, rank int, source_id int, final_code string")).collect()}
    assert got["a"]["winner"] == 2 and got["a"]["code"] is None and [x["decision"] for x in got["a"]["log"]] == ["REJECTED_PROPERTY_CROP", "SELECTED_VALID_CROP"]
    assert got["b"]["code"] == "NO_USABLE_ROOF_RETURNS" and got["c"]["code"] == "NO_RELIABLE_LIDAR_GEOMETRY" and got["d"]["code"] == "LIDAR_CANDIDATES_TEMPORARILY_UNAVAILABLE"


def test_planes_hold_for_good_points_and_fail_for_tilted_ones(spark):
    def grid(building, slope):
        return [(building, i * 100 + j, i * 0.5, j * 0.5, slope * i * 0.5) for i in range(12) for j in range(12)]

    pts = spark.createDataFrame(grid("flat", 0.0) + grid("tilted", 0.05) + grid("bare", 0.0)[:5], "building_id string, pid long, x double, y double, z double")
    ring = F.array(*[G.point(x, y, 0) for x, y in ((0, 0), (6, 0), (6, 6), (0, 6))])
    facets = spark.createDataFrame([("flat",), ("tilted",), ("bare",)], "building_id string").select("building_id", F.lit(1).alias("pos"), ring.alias("ring"), G.point(0, 0, 1).alias("normal"))
    got = {r["building_id"]: r for r in planes.validate(pts, facets, Thresholds(plane_normal_degrees=2.0)).collect()}
    assert got["flat"]["codes"] == [] and got["flat"]["normal_angle"] == pytest.approx(0, abs=1e-6) and got["bare"]["codes"] == ["OPEN3D_FACET_SUPPORT_INSUFFICIENT"]
    assert got["tilted"]["codes"] == ["PLANE_NORMAL_DISAGREEMENT"] and got["tilted"]["normal_angle"] == pytest.approx(2.862, abs=0.01)


def test_outliers_of_some_classes(spark):
    rows = [("g", i, float(i % 6), float(i // 6), 0.0, 1) for i in range(36)] + [("g", 90, 60.0, 60.0, 0.0, 6), ("g", 91, 900.0, 0.0, 0.0, 2)]
    got = {r["pid"]: r["outlier"] for r in points.outliers(spark.createDataFrame(rows, "g string, pid long, x double, y double, z double, cls int"), "g", classes=(1, 6)).collect()}
    assert len(got) == 38 and [p for p, out in got.items() if out] == [90]


def test_planar_points(spark):
    rows = spark.createDataFrame([(1, 6, 0.9, 0.01), (2, 6, 0.1, 0.01), (3, 2, 0.1, 0.5), (4, 6, 0.9, 0.5)], "pid int, cls int, normal_z double, curvature double")
    assert sorted(r["pid"] for r in points.planar(rows).collect()) == [1, 3]


def test_request_text(spark):
    good = {
        "schemaVersion": "1.0", "requestId": "abc-123", "location": {"latitude": 26.0, "longitude": -82.0}, "selectedRoofType": {"name": "n", "family": "f", "material": "m", "flat": False, "x": 1},
        "solarReference": {"roofAreaSqFt": 10, "averagePitchDegrees": 1, "maximumPitchDegrees": 2, "imageryDate": "", "facets": [{"areaSqFt": 1, "pitchDegrees": 3}]}, "requiredOutputs": list(decision.OUTPUTS),
    }
    bad = [good, good | {"more": 1}, good | {"requestId": "a b"}, good | {"requiredOutputs": [*decision.OUTPUTS] * 4}, {k: v for k, v in good.items() if k != "location"}]
    lines = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(bad)] + [(8, "[1]"), (9, None)], "i int, value string")
    got = {r["i"]: r["problems"] for r in decision.parse_requests(lines).collect()}
    assert got == {0: [], 1: ["UNKNOWN_FIELD"], 2: ["REQUEST_ID"], 3: ["REQUIRED_OUTPUTS"], 4: ["LATITUDE", "LONGITUDE"], 8: ["JSON"], 9: ["JSON"]}


def test_every_calibration_metric_speaks(spark):
    names = [name for name, _, _ in evidence.CALIBRATION]
    metrics = F.create_map(*[F.lit(x) for name, bound, way in evidence.CALIBRATION for x in (name, bound - 0.01 if way == "min" else bound + 0.01)])
    yes = F.lit(True)
    codes = value(spark, evidence.calibration_failures(F.lit("m"), F.lit("1"), F.lit("d"), yes, yes, yes, metrics))[0]
    assert len(codes) == len(names) and all(c.startswith(f"CALIBRATION_{n.upper()}_") for c, n in zip(codes, names))


def test_files_by_name(spark, tmp_path):
    for name in ("1234567_a.txt", "12_b.txt", "7654321.txt"):
        (tmp_path / name).write_text(name)
    assert sorted(r["report_id"] for r in readers.reports(spark, str(tmp_path), "*.txt").collect()) == ["1234567", "7654321"]
    (tmp_path / "evidence.json").write_text(json.dumps({"records": {"f1": {"good": True}, "f2": {"good": False}}}))
    assert sorted(r["footprint_id"] for r in readers.evidence_records(spark, str(tmp_path / "evidence.json")).collect()) == ["f1", "f2"]
    assert readers.pinned_release("2024-05-01.0", "2024-05-01.0", "pinned") == "2024-05-01.0"
    with pytest.raises(ValueError):
        readers.pinned_release("2024-05-02.0", "2024-05-01.0", "pinned")


def test_outline_sink_and_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("r", [(0.0, 0.0)])], "request_id string, ring array<struct<x:double,y:double>>")
    sinks.outlines(rows, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).collect() == rows.collect()
    seen = spark.createDataFrame([("2024-01-01 00:01:00", []), ("2024-01-01 00:02:00", ["LATITUDE"]), ("2024-01-01 00:03:00", [])], "received string, problems array<string>").withColumn("received", F.to_timestamp("received"))
    assert sorted((r["code"], r["count"]) for r in requests.arrivals(seen).collect()) == [("LATITUDE", 1), ("OK", 2)]


def test_diagnostics_show_no_vertices(spark):
    rows = spark.range(1).select(F.lit("r").alias("request_id"), *[F.lit(1.0).alias(c) for c in measurement.SHOWN], F.lit(2).alias("facets"), F.array_repeat(F.lit("s"), 30).alias("source_records"), F.lit("x").alias("ring"))
    got = measurement.diagnostics(rows)
    assert got.columns == ["request_id", "geometry", "source_records"] and len(got.first()["source_records"]) == 20 and got.first()["geometry"]["facet_count"] == 2


def test_perimeter_must_be_known(spark):
    rows = spark.createDataFrame([(None, 100.0), (0.0, 100.0), (95.0, 100.0), (80.0, 100.0)], "external_plan_perimeter_feet double, o double")
    assert [r["perimeter_code"] for r in roof.perimeter_gate(rows, "o").collect()] == ["ROOF_TOPOLOGY_PERIMETER_MISSING"] * 2 + [None, "ROOF_TOPOLOGY_PERIMETER_MISMATCH"]
