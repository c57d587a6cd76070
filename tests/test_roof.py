import json
import math

import pytest
from pyspark.sql import functions as F

from ridgeline.conf import METRES_TO_FEET, SQUARE_METRES_TO_SQUARE_FEET, Thresholds
from ridgeline.operators import roof
from ridgeline.plans.catalogue import saltbox


def city(vertices, faces, **attributes):
    found = {"rf_success": True, "rf_extrusion_mode": "standard", "rf_pt_density": 18, "rf_nodata_frac": 0.02, "rf_rmse_lod22": 0.06} | attributes
    geometry = {"type": "MultiSurface", "lod": "2.2", "boundaries": faces, "semantics": {"surfaces": [{"type": "RoofSurface"}], "values": [0] * len(faces)}}
    return json.dumps({"type": "CityJSONFeature", "id": "h", "vertices": vertices, "CityObjects": {"h": {"type": "Building", "attributes": found}, "r": {"type": "BuildingPart", "geometry": [geometry]}}})


#: A pyramid over a square of 8 m, 3 m high.
PYRAMID = city([[0, 0, 2], [8, 0, 2], [8, 8, 2], [0, 8, 2], [4, 4, 5]], [[[0, 1, 4]], [[1, 2, 4]], [[2, 3, 4]], [[3, 0, 4]]])
#: Two slopes that fall towards a gutter of 9 m between them.
BUTTERFLY = city([[0, 0, 5], [0, 9, 5], [6, 0, 2], [6, 9, 2], [14, 0, 6], [14, 9, 6]], [[[0, 2, 3, 1]], [[2, 4, 5, 3]]])
#: The same, its second slope in two pieces with corners of their own, one of them within a decimetre.
PIECES = city(
    [[0, 0, 5], [0, 9, 5], [6, 0, 2], [6, 9, 2], [6, 0, 2], [14, 0, 6], [14, 4, 6], [6, 4, 2], [6.03, 4.02, 2], [14, 4, 6], [14, 9, 6], [6, 9, 2]],
    [[[0, 2, 3, 1]], [[4, 5, 6, 7]], [[8, 9, 10, 11]]],
)
#: One slope, low along 12 m.
LEANTO = [[0, 0, 2], [12, 0, 2], [12, 5, 4], [0, 5, 4]], [[[0, 1, 2, 3]]]
#: A flat roof with a light well of 3 m by 1.5 m.
WELL = city([[0, 0, 4], [12, 0, 4], [12, 7, 4], [0, 7, 4], [2, 2, 4], [5, 2, 4], [5, 3.5, 4], [2, 3.5, 4]], [[[0, 1, 2, 3], [4, 5, 6, 7]]])


@pytest.fixture(scope="module")
def measured(spark):
    lines = {
        "saltbox": saltbox(4.0),
        "pyramid": PYRAMID,
        "butterfly": BUTTERFLY,
        "pieces": PIECES,
        "leanto": city(*LEANTO),
        "well": WELL,
        "sparse": city(*LEANTO, rf_pt_density=1.5),
        "holey": city(*LEANTO, rf_nodata_frac=0.4),
        "boolean": city(*LEANTO, rf_rmse_lod22=False),
        "empty": json.dumps({"type": "CityJSON"}),
    }
    df = spark.createDataFrame(list(lines.items()), "building_id string, value string")
    return {r["building_id"]: r for r in roof.measure(df).collect()}


def feet(metres):
    return pytest.approx(metres * METRES_TO_FEET, abs=0.06)


def test_saltbox(measured):
    r = measured["saltbox"]
    areas, pitches = (11 * 5, 11 * 6.5), (math.degrees(math.atan(3 / 4)), math.degrees(math.atan(2.5 / 6)))
    assert r["code"] is None and r["facets"] == 2 and r["roof_area_sqft"] == pytest.approx(sum(areas) * SQUARE_METRES_TO_SQUARE_FEET, abs=0.01)
    assert r["average_pitch"] == pytest.approx(sum(a * p for a, p in zip(areas, pitches)) / sum(areas), abs=0.01) and r["maximum_pitch"] == pytest.approx(pitches[0], abs=0.01)
    assert (r["ridges"], r["eaves"], r["rakes"]) == (feet(11), feet(22), feet(2 * (5 + 6.5)))
    assert r["external_plan_perimeter_feet"] == feet(2 * (11 + 10)) and r["valleys"] == r["hips"] == 0


def test_pyramid_has_four_hips(measured):
    r = measured["pyramid"]
    assert (r["facets"], r["hips"], r["eaves"], r["ridges"]) == (4, feet(4 * math.sqrt(16 + 16 + 9)), feet(32), 0)
    assert r["roof_area_sqft"] == pytest.approx(80 * SQUARE_METRES_TO_SQUARE_FEET, abs=0.01) and r["average_pitch"] == pytest.approx(36.87, abs=0.01)
    assert (r["shared_edges"], r["exterior_edges"]) == (4, 4) and r["internal_edge_feet"] == r["hips"]


def test_butterfly_has_a_valley(measured):
    r = measured["butterfly"]
    assert (r["valleys"], r["ridges"], r["eaves"], r["highPerimeters"]) == (feet(9), 0, 0, feet(18))
    assert r["rakes"] == feet(2 * (math.sqrt(45) + math.sqrt(80)))


def test_pieces_meet_where_their_corners_do_not(measured):
    r = measured["pieces"]
    assert r["facets"] == 3 and r["valleys"] == feet(9) and r["highPerimeters"] == feet(18)


def test_lean_to(measured):
    r = measured["leanto"]
    assert (r["eaves"], r["highPerimeters"], r["rakes"]) == (feet(12), feet(12), feet(2 * math.sqrt(29)))
    assert r["external_perimeter_feet"] == pytest.approx(r["eaves"] + r["rakes"], abs=0.01)


def test_light_well_is_taken_off(measured):
    r = measured["well"]
    assert r["roof_area_sqft"] == r["flat_area_sqft"] == pytest.approx(79.5 * SQUARE_METRES_TO_SQUARE_FEET, abs=0.01)
    assert r["openings"] == 1 and r["opening_perimeter_feet"] == feet(9) and r["eaves"] == feet(38)


def test_perimeter_and_edge_numbers(spark):
    lines = spark.createDataFrame([("p", PYRAMID)], "building_id string, value string")
    m = roof.measure(lines)
    gated = [roof.perimeter_gate(m.withColumn("outline", F.lit(x)), "outline").first() for x in (32 * METRES_TO_FEET, 40 * METRES_TO_FEET)]
    assert gated[0]["perimeter_code"] is None and gated[1]["perimeter_code"] == "ROOF_TOPOLOGY_PERIMETER_MISMATCH" and gated[1]["perimeter_variance"] == pytest.approx(20, abs=0.05)
    buildings = roof.features(lines)
    found = roof.facets(roof.surfaces(buildings))
    ids = [r["edge_id"] for r in roof.numbered(roof.edges(roof.edge_uses(found), found)).collect()]
    assert sorted(ids) == ["EA1", "EA2", "EA3", "EA4", "HI1", "HI2", "HI3", "HI4"]


def test_codes(measured):
    assert measured["sparse"]["code"] == "LIDAR_DENSITY_TOO_LOW"
    assert measured["holey"]["code"] == "LIDAR_COVERAGE_INCOMPLETE"
    assert measured["boolean"]["code"] == "ROOFER_QUALITY_METADATA_INVALID"
    assert measured["empty"]["code"] == "CITYJSON_FEATURE_COUNT_INVALID"


def test_nodes_within_a_decimetre_are_shared():
    import numpy as np

    one = np.array([[1, 1, 2], [8, 1, 2], [8, 4, 3.5], [1, 4, 3.5]], dtype=float)
    two = np.array([[1.05, 3.98, 3.5], [8, 4.03, 3.48], [8, 9, 1], [1, 9, 1]], dtype=float)
    pairs = [u[1:3] for u in roof.node_edges([(1, one), (2, two)], 0.10)]
    assert len(pairs) - len(set(pairs)) == 1


def test_settings():
    assert Thresholds().validate() == []
    assert Thresholds(consensus_iou=0.5).validate() == ["consensus_iou", "correlated_iou"]
    assert Thresholds.from_environment({"RIDGELINE_MIN_DENSITY": "9.5"}).min_density == 9.5
    with pytest.raises(ValueError, match="min_density"):
        Thresholds.from_environment({"RIDGELINE_MIN_DENSITY": "many"})


@pytest.mark.parametrize("raw,good", [("0", 0.0), ('"0"', 0.0), ("0.5", 0.5), ("null", None), ('""', None), ('" "', None), ("true", None), ("false", None), ("-1", None), ("NaN", None), ("Infinity", None), ('"garbage"', None), ("[]", None)])
def test_quality_numbers(spark, raw, good):
    from ridgeline.functions.scalars import quality_number

    assert spark.range(1).select(quality_number(F.lit(raw), 1.0)).first()[0] == good


def test_envelope(spark):
    from ridgeline.operators import decision

    codes = [*decision.TRANSIENT, *decision.MISSING, *decision.SETTINGS, "INTERNAL_GEOMETRY_ERROR", "FOOTPRINT_PROVIDER_CONFLICT", "BUILDING_FOOTPRINT_AMBIGUOUS", None]
    got = {r["code"]: r for r in decision.envelope(spark.createDataFrame([(c,) for c in codes], "code string")).collect()}
    assert len(set(codes)) == len(codes) and all(got[c]["http_status"] == 503 and got[c]["retryable"] for c in decision.TRANSIENT)
    assert all(got[c]["http_status"] == 404 and not got[c]["retryable"] for c in decision.MISSING) and all(got[c]["http_status"] == 503 and not got[c]["retryable"] for c in decision.SETTINGS)
    assert got["INTERNAL_GEOMETRY_ERROR"]["http_status"] == 500 and got["FOOTPRINT_PROVIDER_CONFLICT"]["http_status"] == 422
    assert got[None]["available"] and got[None]["http_status"] == 200 and got[None]["error_code"] is None
    assert all(not r["available"] and r["verification_status"] == "INSPECTION_REQUIRED" and r["pricing_allowed"] is False and r["error_code"] == r["status"] == c for c, r in got.items() if c)


def test_gates_of_a_decision(spark):
    from ridgeline.operators import decision

    row = spark.range(1)
    at = lambda lon, lat: row.select(decision.service_area(F.lit(lon), F.lit(lat))).first()[0]
    t = Thresholds()
    assert at((t.min_longitude + t.max_longitude) / 2, (t.min_latitude + t.max_latitude) / 2) is None and at(0.0, 0.0) == "OUTSIDE_SERVICE_AREA"
    kind = lambda flat, area, said, family: row.select(decision.roof_type_code(F.lit(flat), F.lit(area), F.lit(said), F.lit(family))).first()[0]
    assert kind(1.0, 10.0, True, "FLAT") == "SELECTED_FLAT_ROOF_MISMATCH" and kind(6.0, 10.0, False, "STEEP_SLOPE") == "SELECTED_STEEP_ROOF_MISMATCH" and kind(9.0, 10.0, True, "FLAT") is None
