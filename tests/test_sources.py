import gzip
import json

from ridgeline.sources import readers, sinks
from ridgeline.streaming import requests

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}


def test_features_and_tiles(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"id": " x ", "geometry": SQUARE, "properties": {}}, {"geometry": SQUARE, "properties": {"id": "y"}}, {"geometry": SQUARE}]}))
    (tmp_path / "b.geojson").write_text("{broken")
    rows = readers.features(spark, str(tmp_path / "*.geojson")).orderBy("file", "pos").collect()
    assert [r["id"] for r in rows[:2]] == ["x", "y"] and rows[2]["id"].startswith("geometry-") and len(rows[0]["ring"]) == 4
    assert rows[3]["code"] == "PROVIDER_JSON_INVALID"
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(json.dumps({"geometry": SQUARE}) + "\n\n" + json.dumps({"features": [{"id": "q", "geometry": SQUARE}]}) + "\n")
    tile = readers.tile_lines(spark, str(tmp_path / "t.csv.gz"), "0123").orderBy("line").collect()
    assert [r["id"] for r in tile] == ["0123:1", "q"]


def test_ways_catalogue_and_index(spark, tmp_path):
    line = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]
    (tmp_path / "w.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "geometry": line}, {"type": "way", "id": 6, "geometry": line[:3]}, {"type": "node", "id": 7}]}))
    way = readers.map_ways(spark, str(tmp_path / "w.json")).collect()
    assert len(way) == 1 and way[0]["id"] == "way/5" and len(way[0]["ring"]) == 3
    (tmp_path / "c.csv").write_text("Location, QuadKey ,Url\nUnitedStates,01,a\nUnited States,01,b\nMars,01,c\n")
    assert [r["url"] for r in readers.tile_catalogue(spark, str(tmp_path / "c.csv")).collect()] == ["a"]
    (tmp_path / "ept.json").write_text(json.dumps({"bounds": [0, 0, 0, 9, 9, 9], "srs": {"authority": "EPSG", "horizontal": "26917"}, "points": 3}))
    index = readers.tile_index(spark, str(tmp_path / "ept.json")).first()
    assert (index["x1"], index["crs"], index["points"]) == (9.0, "EPSG:26917", 3)


def test_registry_and_sheet(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("sources:\n- {id: a, density: 8.5}\n- {id: b}\n")
    rows = readers.registry(spark, str(tmp_path / "r.yaml"), "sources", "id string, density double").collect()
    assert [tuple(r) for r in rows] == [("a", 8.5), ("b", None)]
    (tmp_path / "s.csv").write_text("A,B\n1,\n,\n2,3\n")
    assert readers.sheet(spark, str(tmp_path / "s.csv")).count() == 2


def test_points_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.005, 2.0, 3.0), (50.0, 2.0, 3.0)], "x double, y double, z double")
    sinks.point_table(df, str(tmp_path / "p"))
    assert readers.point_table(spark, str(tmp_path / "p"), (0, 0, 10, 10)).count() == 1
    sinks.xyz(df, str(tmp_path / "x"))
    assert readers.xyz(spark, str(tmp_path / "x")).count() == 2
    done = spark.createDataFrame([("1", "PASS")], "report_id string, status string")
    assert sinks.manifest(done, str(tmp_path / "m")) == 0 and sinks.health(spark)["numpy"]


def test_masks(spark):
    cells = spark.createDataFrame([("m", r, c, 1) for r in range(2) for c in range(2)] + [("m", 5, 5, 0)], "k string, row int, col int, value int")
    rings = readers.mask_rings(cells, "k").collect()
    assert len(rings) == 1


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"request_id": "request-1", "schema_version": "1.0", "longitude": -81.0, "latitude": 26.0, "outputs": ["x"], "reference_area": 9.0, "reference_facets": 2, "received": "2024-01-01T00:00:00Z"}
    (tmp_path / "in/a.json").write_text(json.dumps(good) + "\n" + json.dumps(good) + "\n")
    out = requests.process(requests.stream(spark, str(tmp_path / "in")), lambda rows: rows.select("request_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    out.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["request_id"], r["code"]) for r in rows] == [("request-1", "REQUIRED_OUTPUTS")]
