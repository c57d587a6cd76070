import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geometry as G
from ridgeline.functions import overlay, projection, scalars
from ridgeline.operators import calibration, cascade, evidence, footprints, planes, points, pricing


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring(*xy):
    return F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in xy])


def test_year_age_on_leap_day(spark):
    d = lambda s: F.lit(s).cast("date")
    row = one(spark, scalars.year_age(d("2020-02-29"), d("2021-02-28")), scalars.year_age(d("2020-02-29"), d("2021-03-01")), scalars.year_age(d("2030-01-01"), d("2021-03-01")))
    assert tuple(row) == (0, 1, 0)


def test_projection_round_trip(spark):
    x, y = one(spark, projection.to_utm(F.lit(-81.87), F.lit(26.64)).alias("p"))["p"]
    a, b = one(spark, projection.from_utm(F.lit(x), F.lit(y), F.lit(17), F.lit(False)).alias("p"))["p"]
    assert a == pytest.approx(-81.87, abs=1e-9) and b == pytest.approx(26.64, abs=1e-9)
    assert one(spark, projection.to_utm(F.lit(-81.0), F.lit(10.0))["x"])[0] == pytest.approx(500_000, abs=1e-6)


def test_quadkey(spark):
    key = one(spark, projection.quadkey(F.lit(-81.8723), F.lit(26.6406)), projection.utm_epsg(F.lit(-81.8), F.lit(26.6)))
    assert len(key[0]) == 9 and set(key[0]) <= set("0123") and key[1] == 32617


def test_rings(spark):
    u = ring((0, 0), (9, 0), (9, 8), (6, 8), (6, 3), (3, 3), (3, 8), (0, 8))
    at = lambda x, y: (F.lit(float(x)), F.lit(float(y)), u)
    row = one(spark, G.ring_area(u), G.contains(*at(1, 7)), G.contains(*at(4.5, 6)), G.covers(*at(9, 4)), G.contains(*at(9, 4)), G.distance_to_polygon(*at(4.5, 6)), G.simple_ring(u), G.simple_ring(ring((0, 0), (1, 1), (1, 0), (0, 1))))
    assert tuple(row) == (57.0, True, False, True, False, 1.5, True, False)
    same = one(spark, G.normal_ring(ring((0, 0), (2, 0), (2, 1))) == G.normal_ring(ring((2, 0), (0, 0), (2, 1))))
    assert same[0] is True


def test_overlay_invariants():
    r = random.Random(5)

    def star(cx, cy):
        return np.array([[cx + d * math.cos(2 * math.pi * i / 9), cy + d * math.sin(2 * math.pi * i / 9)] for i in range(9) for d in [r.uniform(1, 4)]])

    def area(p):
        q = np.roll(p, -1, axis=0)
        return abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2

    for _ in range(40):
        a, b = star(0, 0), star(r.uniform(-3, 3), r.uniform(-3, 3))
        c = overlay.common_area(a, b)
        assert c == pytest.approx(overlay.common_area(b, a)) and -1e-9 <= c <= min(area(a), area(b)) + 1e-9
        assert overlay.common_area(a, a) == pytest.approx(area(a))
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], dtype=float)
    assert overlay.common_area(square, square + 2) == pytest.approx(4)
    assert len(overlay.simplify_ring(np.array([[0, 0], [2, 0.01], [4, 0], [4, 4], [0, 4]], dtype=float), 0.25)) == 4


def test_mask_outline():
    import pandas as pd

    cells = pd.DataFrame([(r, c) for r in range(3) for c in range(4)] + [(3, 4)], columns=["row", "col"])
    rings = overlay.polygonise(cells)
    q = [abs((p[:, 0] * np.roll(p, -1, 0)[:, 1] - np.roll(p, -1, 0)[:, 0] * p[:, 1]).sum()) / 2 for p in rings]
    assert sum(q) == 13


def test_select_footprint(spark):
    square = lambda x, y, s=10.0: [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]
    rows = [
        ("in", 1, 5.0, 5.0, square(0.0, 0.0)),
        ("in", 2, 5.0, 5.0, square(11.0, 0.0)),
        ("rival", 1, 0.0, 0.0, square(1.0, 1.0)),
        ("rival", 2, 0.0, 0.0, square(-12.0, 0.0)),
        ("far", 1, 0.0, 0.0, square(40.0, 0.0)),
        ("again", 1, 5.0, 5.0, square(0.0, 0.0)),
        ("again", 2, 5.0, 5.0, square(0.0, 0.0)[1:] + square(0.0, 0.0)[:1]),
    ]
    df = spark.createDataFrame(rows, "request_id string, candidate_id int, px double, py double, ring array<struct<x:double,y:double>>")
    got = {r["request_id"]: (r["candidate_id"], r["code"]) for r in footprints.select_footprint(df).collect()}
    assert got["in"] == (1, None) and got["rival"] == (1, "BUILDING_FOOTPRINT_AMBIGUOUS") and got["far"] == (1, "BUILDING_FOOTPRINT_NOT_FOUND") and got["again"][1] is None


def test_cascade(spark):
    rows = [("a", 0, "NO_COVERAGE"), ("a", 1, "OK"), ("a", 2, "TRANSIENT"), ("b", 0, "UNRELIABLE"), ("b", 1, "OK"), ("c", 0, "NO_COVERAGE"), ("c", 1, "TRANSIENT")]
    df = spark.createDataFrame(rows, "k string, rank int, outcome string")
    got = {r["k"]: tuple(r)[1:] for r in cascade.first_decisive(df, "k").collect()}
    assert got == {"a": (1, "OK", 2, False), "b": (0, "UNRELIABLE", 1, False), "c": (None, "BUILDING_FOOTPRINT_NOT_FOUND", 2, True)}


def test_planes_disagree_and_agree(spark):
    r = np.random.default_rng(3)
    xy = r.uniform(0, 10, (200, 2))
    good = [("g", float(x), float(y), 5 + 0.5 * float(x) + float(e)) for (x, y), e in zip(xy + 450_000, r.normal(0, 0.02, 200))]
    df = spark.createDataFrame(good, "b string, x double, y double, z double")
    row = planes.fit_planes(df, ["b"]).first()
    assert row["n"] == 200 and row["inlier_ratio"] > 0.95 and row["rmse"] < 0.05 and row["pitch"] == pytest.approx(26.565, abs=0.3)
    m = planes.moments(df, "b").first()
    assert m["pitch"] == pytest.approx(26.565, abs=0.3)
    codes = one(spark, planes.plane_gates(F.lit(25), F.lit(0.5), F.lit(9.0), F.lit(0.2)), planes.plane_gates(F.lit(5), F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    assert codes[0] == ["PLANE_INLIER_RATIO_TOO_LOW", "PLANE_NORMAL_DISAGREEMENT", "PLANE_RMSE_TOO_HIGH"] and codes[1] == ["OPEN3D_FACET_SUPPORT_INSUFFICIENT"]


def test_clusters_heights_and_normals(spark):
    pts = [("b", i, 0.5 * i, 0.0, 3.0, 6) for i in range(25)] + [("b", 100 + i, 50.0 + i, 0.0, 0.0, 2) for i in range(4)]
    df = spark.createDataFrame(pts, "b string, pid long, x double, y double, z double, cls int")
    found = {r["pid"]: r["cluster"] for r in points.clusters(df, "b").collect()}
    assert found[0] == found[24] == 1 and found[100] == 0
    h = {r["pid"]: r["height"] for r in points.heights(df, "b").collect()}
    assert h[24] == pytest.approx(3.0) and h[100] == pytest.approx(0.0)
    assert points.normals(df, "b").count() == 29
    near = points.neighbours_within(df, "b", 1.0).groupBy("pid").count().where("pid = 10").first()["count"]
    assert near == 4


def test_packages_and_order(spark):
    row = one(spark, scalars.packages(F.lit(900.0), F.lit(33.3333333333)), scalars.packages(F.lit(60.0), F.lit(20.0)), scalars.packages(F.lit(0.0), F.lit(20.0)))
    assert tuple(row) == (27, 3, 0)  # exact up to rounding: no package more


HEADER = ["Profile ID", "Version", "Active", "County", "Roof Material", "Effective From", "Effective Through", "Pricing Readiness", "Material Rate Per Square", "Labor Rate Per Square", "Min Roof Squares", "Max Roof Squares"]


def test_pricebook(spark):
    rows = [
        ["P1", "1", "yes", "Lee", "Tile", "2024-01-01", "", "READY", "100", "50", "0", ""],
        ["P1", "1", "TRUE", "Lee", "Metal", "2024-01-01", "2024-06-30", "READY", "100", "50", "0", "40"],
        ["P2", "1", "yes", "Lee", "Metal", "45292", "2024-06-30", "READY", "100", "50", "0", "40"],
        ["P3", "", "no", "Lee", "Metal", "", "", "", "", "", "", ""],
        ["P4", "1", "yes", "Mars", "Metal", "2024-01-01", "2023-01-01", "DRAFT", "true", "-5", "9", "9"],
    ]
    df = spark.createDataFrame([[*r, i] for i, r in enumerate(rows, 2)], HEADER + ["row"])
    got = {r["row"]: r for r in pricing.audited(df, F.lit("2024-06-30").cast("date")).collect()}
    assert sorted(got) == [2, 3, 4, 6]
    assert got[2]["effective"] and got[4]["effective"] and not got[3]["effective"]
    assert got[3]["issues"] == ["Missing or duplicate profile ID"]
    assert len(got[6]["issues"]) == 6
    cover = pricing.coverage(spark.createDataFrame([("Lee",)], "county string"), spark.createDataFrame([("Tile",), ("Metal",)], "material string"), spark.createDataFrame([("Lee", "Metal")] * 2, "county string, material string"))
    assert {tuple(r) for r in cover.collect()} == {("Lee", "Tile", 0, "MISSING_APPROVED_PRICE"), ("Lee", "Metal", 2, "REVIEW_PROFILE_OVERLAP")}
    with pytest.raises(ValueError, match="Missing pricebook column: Version"):
        pricing.audited(df.drop("Version"), F.lit("2024-06-30"))


def test_report_text_and_mesh(spark):
    text = "Report: 12345678\nTotal Roof Area = 2,345.5 sq ft\nTotal Roof Facets = 7\nPredominant Pitch = 6/12\nRidges = 30 ft\nEaves/Starter = 1,020 ft"
    r = calibration.report_from_text(spark.createDataFrame([(text,), ("nothing",)], "text string")).collect()
    assert (r[0]["report_id"], r[0]["area"], r[0]["facets"], r[0]["rise"], r[0]["ridges"], r[0]["eaves"]) == ("12345678", 2345.5, 7, 6.0, 30.0, 1020.0)
    assert r[1]["code"] == "REPORT_INCOMPLETE"
    mesh = ["v 0 0 0", "v 10 0 0", "v 10 10 5", "v 0 10 5", "o Roof.A", "f 1 2 3 4", "o Wall", "f 1 2 3", "o Roof.A.Label", "f 1 2 3"]
    lines = spark.createDataFrame([("m", i, s) for i, s in enumerate(mesh)], "k string, line_no int, value string")
    m = calibration.mesh_summary(calibration.mesh_triangles(lines, "k"), "k").first()
    assert m["triangles"] == 2 and m["facets"] == 1 and m["rise_class"] == 6 and m["area"] == pytest.approx(100 * math.sqrt(1.25)) and m["max_error"] < 1e-6


def test_evidence(spark):
    metrics = F.create_map(*[F.lit(x) for name, bound, _ in evidence.CALIBRATION for x in (name, bound)])
    yes = F.lit(True)
    good = evidence.calibration_failures(F.lit("m"), F.lit("1"), F.lit("d"), yes, yes, yes, metrics)
    bad = evidence.calibration_failures(F.lit(" "), F.lit("1"), F.lit("d"), yes, F.lit(None).cast("boolean"), yes, F.lit(None).cast("map<string,double>"))
    row = one(spark, good, bad, evidence.outcome(F.array().cast("array<string>"), F.lit(1)), evidence.outcome(F.array().cast("array<string>"), F.lit(4)), evidence.outcome(F.array(F.lit("ROOF_PITCH_CHANGED")), F.lit(1)))
    assert row[0] == [] and row[1] == ["CALIBRATION_MODEL_NAME_MISSING", "CALIBRATION_COREGISTRATION_FAILED", "CALIBRATION_METRICS_MISSING"]
    assert row[2]["status"] == "GEOMETRY_VERIFIED" and row[3]["status"] == "HISTORICAL_PRICING_CALIBRATION_HOLD" and row[4]["status"] == "STRUCTURE_CHANGED_AFTER_LIDAR"
