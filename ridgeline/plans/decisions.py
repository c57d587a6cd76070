"""Registered queries over joins, gates and decisions: from request text to the winner among its sources.

As in ``catalogue``, each applies shipped operators to the provided tables in a role, with the SQL it must equal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..conf import DEFAULTS
from ..functions import geometry as G
from ..functions import projection, scalars
from ..operators import calibration, cascade, decision, evidence, footprints, lidar, matching, points, pricing, roof
from . import measurement, roles
from .registry import query, r
from .roles import table, with_views

#: Boxes that stand for counties, in degrees: two overlap, one is not served.
PLACES = (("Lee County", -83.005, 25.495, -82.505, 26.805), ("Collier", -82.505, 25.495, -82.005, 26.605), ("De Soto County", -82.205, 25.495, -81.505, 26.205), ("Hendry COUNTY", -81.505, 25.495, -80.805, 27.905), ("Orange County", -83.005, 26.805, -82.505, 28.305))


def places(spark):
    rows = spark.createDataFrame(list(PLACES), "name string, x0 double, y0 double, x1 double, y1 double")
    corner = lambda x, y: G.named(x=F.col(x), y=F.col(y))
    return rows.select("name", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring"))


_SERVED = {"Lee County": "Lee", "Collier": "Collier", "De Soto County": "DeSoto", "Hendry COUNTY": "Hendry"}
_PLACES_SQL = "place(county, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"('{_SERVED[n]}', {a}e0, {b}e0, {c}e0, {d}e0)" for n, a, b, c, d in PLACES if n in _SERVED) + ")"


@query(with_views("req") + f""", {_PLACES_SQL}, m AS (SELECT request_id, min(place.county) AS county, count(*) AS n FROM req JOIN place ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY request_id)
SELECT r.request_id, CASE WHEN n = 1 THEN m.county END AS county, CASE WHEN n = 1 THEN NULL ELSE 'OUTSIDE_SERVICE_AREA' END AS code FROM req r LEFT JOIN m ON r.request_id = m.request_id""")
def q38_county_of_point(spark, sf_dir):
    return matching.county_of_point(roles.requests(spark, sf_dir), places(spark))


@query(with_views("req") + f""", {_PLACES_SQL}, o AS (SELECT request_id, lon AS a0, lat AS b0, lon + (request_id % 5) * 0.004e0 + 0.001e0 AS a1, lat + (request_id % 7) * 0.003e0 + 0.001e0 AS b1 FROM req),
c AS (SELECT request_id, county, greatest(0, least(a1, x1) - greatest(a0, x0)) * greatest(0, least(b1, y1) - greatest(b0, y0)) / ((a1 - a0) * (b1 - b0)) AS ratio FROM o CROSS JOIN place),
b AS (SELECT request_id, max(round(ratio, 6)) AS ratio FROM c WHERE ratio > 0 GROUP BY request_id),
w AS (SELECT b.request_id, b.ratio, max(county) AS county FROM b JOIN c ON b.request_id = c.request_id AND round(c.ratio, 6) = b.ratio GROUP BY b.request_id, b.ratio)
SELECT r.request_id, w.county, w.ratio, CASE WHEN w.ratio >= 0.98e0 THEN NULL ELSE 'OUTSIDE_SERVICE_AREA' END AS code FROM (SELECT request_id FROM req) r LEFT JOIN (SELECT request_id, ratio, CASE WHEN ratio >= 0.98e0 THEN county END AS county FROM w) w ON r.request_id = w.request_id""")
def q39_county_of_outline(spark, sf_dir):
    k, lon, lat = F.col("request_id"), F.col("lon"), F.col("lat")
    own = roles.requests(spark, sf_dir).select("request_id", roles.ring(lon, lat, k % 5 * F.lit(0.004) + 0.001, k % 7 * F.lit(0.003) + 0.001).alias("ring"))
    return matching.county_of_outline(own, places(spark), 0.25).withColumn("ratio", r("ratio", 6))


_Q40 = """, c AS (SELECT c_custkey AS request_id, (c_custkey * 13 % 400) * 5.0e0 AS px, (c_custkey * 7 % 300) * 5.0e0 AS py FROM customer),
o AS (SELECT o_orderkey AS k, (o_orderkey * 29 % 500) * 4.0e0 AS x0, (o_custkey * 31 % 375) * 4.0e0 AS y0, 6.0e0 + o_orderkey % 5 AS w, 5.0e0 + o_custkey % 6 AS h FROM orders),
f AS (SELECT min(k) AS candidate_id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM o GROUP BY ALL),
p AS (SELECT request_id, candidate_id, (x1 - x0) * (y1 - y0) AS area, sqrt(pow(greatest(0, x0 - px, px - x1), 2) + pow(greatest(0, y0 - py, py - y1), 2)) AS distance,
 px > x0 AND px < x1 AND py > y0 AND py < y1 AS inside, px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 AS covered FROM c JOIN f ON x0 <= px + 45 AND x1 >= px - 45 AND y0 <= py + 45 AND y1 >= py - 45),
w AS (SELECT *, row_number() OVER v AS n, lead(distance) OVER v AS d2, lead(covered) OVER v AS c2 FROM p WINDOW v AS (PARTITION BY request_id ORDER BY distance, area, candidate_id))
SELECT c.request_id, w.candidate_id, round(w.distance, 6) AS distance, CASE WHEN w.candidate_id IS NULL OR distance > 20 THEN 'BUILDING_FOOTPRINT_NOT_FOUND' WHEN d2 <= 20 AND abs(d2 - distance) <= 2 AND NOT (inside AND NOT c2) THEN 'BUILDING_FOOTPRINT_AMBIGUOUS' END AS code
FROM c LEFT JOIN w ON c.request_id = w.request_id AND w.n = 1"""


@query("WITH" + _Q40[1:])
def q40_outline_search(spark, sf_dir):
    """Requests to their outline: boxes joined by grid cell, equal outlines once, the nearest, and whether a rival is as near."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    asked = table(spark, sf_dir, "customer").select(c.alias("request_id"), (c * 13 % 400 * F.lit(5.0)).alias("px"), (c * 7 % 300 * F.lit(5.0)).alias("py"), F.lit(-82.0).alias("lon"), F.lit(26.5).alias("lat"))
    ring = roles.ring(o * 29 % 500 * F.lit(4.0), F.col("o_custkey") * 31 % 375 * F.lit(4.0), F.lit(6.0) + o % 5, F.lit(5.0) + F.col("o_custkey") % 6)
    shapes = table(spark, sf_dir, "orders").select(o.alias("candidate_id"), ring.alias("ring"))
    found = measurement.located(asked, shapes)
    return found.select("request_id", "candidate_id", r("distance", 6).alias("distance"), "code")


def _tiles_sql(zoom: int = 9) -> str:
    digits = " || ".join(f"CAST(((tx >> {k}) & 1) + 2 * ((ty >> {k}) & 1) AS VARCHAR)" for k in range(zoom - 1, -1, -1))
    return f"""xy AS (SELECT request_id, CAST(floor((lon + 180) / 360 * {1 << zoom}) AS INTEGER) AS tx, CAST(floor((0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {1 << zoom}) AS INTEGER) AS ty FROM req),
q AS (SELECT request_id, {digits} AS quadkey FROM xy)"""


@query(with_views("req") + f""", {_tiles_sql()}, tile AS (SELECT DISTINCT quadkey FROM q WHERE request_id % 50 < 3)
SELECT q.request_id, q.quadkey, 'https://tiles/' || tile.quadkey AS url, CASE WHEN tile.quadkey IS NULL THEN 'MICROSOFT_FOOTPRINT_TILE_NOT_FOUND' END AS code FROM q LEFT JOIN tile ON q.quadkey = tile.quadkey""")
def q41_tile_join(spark, sf_dir):
    asked = roles.requests(spark, sf_dir).select("request_id", projection.quadkey(F.col("lon"), F.col("lat")).alias("quadkey"))
    tiles = asked.where("request_id % 50 < 3").select("quadkey").distinct().withColumn("url", F.concat(F.lit("https://tiles/"), "quadkey"))
    return matching.with_tile(asked, tiles).select("request_id", "quadkey", "url", "code")


@query("""WITH s AS (SELECT n_nationkey AS source_id, unnest(['^' || chr(CAST(97 + n_nationkey AS INTEGER)) || '.*e', chr(CAST(97 + n_nationkey AS INTEGER)) || '$']) AS pattern FROM nation),
p AS (SELECT p_name AS name, 'https://host/' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN '/other' ELSE '/ept.json' END AS url FROM part)
SELECT DISTINCT source_id, name, url FROM p JOIN s ON regexp_matches(name, pattern) WHERE regexp_matches(url, '^https://host/[0-9]+/ept\\.json$')""")
def q42_catalogue_join(spark, sf_dir):
    n, k = F.col("n_nationkey"), F.col("p_partkey").cast("string")
    letter = F.chr(n + 97)
    registry = table(spark, sf_dir, "nation").select(n.alias("source_id"), F.array(F.concat(F.lit("^"), letter, F.lit(".*e")), F.concat(letter, F.lit("$"))).alias("patterns"))
    tail = F.when(F.col("p_partkey") % 4 == 0, "/other").otherwise("/ept.json")
    listed = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("https://host/"), k, tail).alias("url"))
    return matching.catalogue_matches(registry, listed, r"https://host/[0-9]+/ept\.json").select("source_id", "name", "url")


@query(with_views("src", "req") + """, s AS (SELECT *, enabled AND license <> 'PENDING' AND acquired_end >= DATE '2018-01-01' AS usable, CASE WHEN source_id % 6 = 0 THEN NULL ELSE coverage END AS found FROM src),
d AS (SELECT r.request_id, s.*, coalesce(usable AND s.county = r.county AND found >= 0.98e0, false) AS good, usable AND s.county = r.county AND found IS NULL AS away FROM req r CROSS JOIN s),
g AS (SELECT request_id, count(*) FILTER (WHERE good) AS candidates, bool_or(away) AS away FROM d GROUP BY request_id),
w AS (SELECT request_id, source_id, row_number() OVER (PARTITION BY request_id ORDER BY acquired_end DESC, coverage DESC, density DESC, priority DESC, source_id) AS n FROM d WHERE good)
SELECT g.request_id, g.candidates, w.source_id AS first_source, CASE WHEN candidates > 0 THEN NULL WHEN away THEN 'LIDAR_SOURCES_TEMPORARILY_UNAVAILABLE' ELSE 'NO_LIDAR_COVERAGE' END AS code FROM g LEFT JOIN w ON g.request_id = w.request_id AND w.n = 1""")
def q43_source_selection(spark, sf_dir):
    """How many sources pass all gates for each request, the first of them, and why none does; some could not be asked."""
    known = F.when(F.col("source_id") % 6 != 0, F.col("coverage"))
    return measurement.selections(roles.requests(spark, sf_dir), roles.sources(spark, sf_dir).withColumn("coverage", known))


_ATTEMPTS_SQL = """a AS (SELECT o_custkey AS request_id, o_orderkey AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderkey AS k, (o_orderkey * 7919) % 1009 AS v FROM orders),
m AS (SELECT *, CASE WHEN v % 31 = 0 THEN 'GEOMETRY_COMMAND_TIMEOUT' END AS provider_code, CASE WHEN v % 29 = 0 THEN 0 ELSE 500 END AS total, CASE WHEN v % 23 < 2 THEN 0 ELSE 200 END AS roof,
 CASE WHEN v % 5 = 0 THEN NULL ELSE DATE '2017-06-01' + CAST(v * 3 AS INTEGER) END AS tile_date, DATE '2019-03-01' AS acquired_end, 9.0e0 + v % 9 AS density, CAST(4 + v % 8 AS DOUBLE) AS minimum, CASE WHEN v % 19 = 0 THEN 'ROOFER_RMSE_TOO_HIGH' END AS roof_code,
 150.0e0 + v % 21 AS plan, 160.0e0 AS outline, CASE WHEN v % 17 = 0 THEN 'PLANE_RMSE_TOO_HIGH' END AS plane_code, 2000.0e0 + v % 400 AS area, (v % 13) * 2.0e0 AS pitch, CAST((v % 7) * 200 AS DOUBLE) AS flat_area, v % 11 = 0 AS flat, 0.7e0 + (v % 30) * 0.01e0 AS quality, CAST(v % 15 AS DOUBLE) AS distance FROM a),
x AS (SELECT *, abs(area - 2100) / 2100 * 100 AS av, abs(pitch - 14) AS pv, CASE WHEN tile_date IS NULL OR v % 3 = 0 THEN 'INSPECTION_REQUIRED' ELSE 'OK' END AS seen, coalesce(tile_date, acquired_end) AS day FROM m),
y AS (SELECT *, greatest(0, 2024 - year(day) - CASE WHEN (6, 30) < (month(day), day(day)) THEN 1 ELSE 0 END) AS age, (greatest(0, 1 - av / 15) + greatest(0, 1 - pv / 10)) / 2 AS rec FROM x),
z AS (SELECT *, round(least(1, quality) * 0.55e0 + greatest(0, 1 - distance / 20) * 0.1e0 + CASE WHEN seen = 'OK' THEN 1 ELSE greatest(0, 1 - age / 10.0e0) END * 0.1e0 + rec * 0.25e0, 9) AS score FROM y),
e AS (SELECT *, CASE WHEN provider_code IS NOT NULL THEN provider_code WHEN total = 0 THEN 'LIDAR_CROP_EMPTY' WHEN roof = 0 THEN 'NO_USABLE_ROOF_RETURNS' WHEN tile_date < DATE '2018-01-01' THEN 'LIDAR_TILE_BEFORE_MINIMUM_ACQUISITION_DATE'
 WHEN density < greatest(8, minimum) THEN 'LIDAR_DENSITY_TOO_LOW' WHEN roof_code IS NOT NULL THEN roof_code WHEN abs(plan - outline) / outline * 100 > 5.5e0 THEN 'ROOF_TOPOLOGY_PERIMETER_MISMATCH' WHEN plane_code IS NOT NULL THEN plane_code
 WHEN av > 15 THEN 'SOLAR_AREA_RECONCILIATION_FAILED' WHEN pv > 10 THEN 'SOLAR_PITCH_RECONCILIATION_FAILED' WHEN flat AND flat_area / area < 0.5e0 THEN 'SELECTED_FLAT_ROOF_MISMATCH' WHEN NOT flat AND flat_area / area > 0.5e0 THEN 'SELECTED_STEEP_ROOF_MISMATCH'
 WHEN round(score, 3) < 0.8e0 THEN 'GEOMETRY_CONFIDENCE_TOO_LOW' END AS final_code FROM z)"""


def attempts(spark, sf_dir):
    from dataclasses import replace

    from pyspark.sql import Window

    k, v = F.col("o_orderkey"), F.col("v")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), k.alias("source_id"), (k * 7919 % 1009).alias("v"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("source_id")))
    text = lambda condition, code: F.when(condition, F.lit(code))
    d = lambda x: x.cast("double")
    rows = rows.withColumns({
        "provider_code": text(v % 31 == 0, "GEOMETRY_COMMAND_TIMEOUT"), "total": F.when(v % 29 == 0, 0).otherwise(500), "roof": F.when(v % 23 < 2, 0).otherwise(200),
        "tile_date": F.when(v % 5 != 0, F.date_add(F.lit("2017-06-01").cast("date"), (v * 3).cast("int"))), "acquired_end": F.lit("2019-03-01").cast("date"), "density": d(v % 9) + 9, "minimum_density": d(v % 8 + 4),
        "roof_code": text(v % 19 == 0, "ROOFER_RMSE_TOO_HIGH"), "external_plan_perimeter_feet": d(v % 21) + 150, "outline_feet": F.lit(160.0), "plane_codes": F.when(v % 17 == 0, F.array(F.lit("PLANE_RMSE_TOO_HIGH"))).otherwise(F.array().cast("array<string>")),
        "area": d(v % 400) + 2000, "pitch": v % 13 * F.lit(2.0), "reference_area": F.lit(2100.0), "reference_pitch": F.lit(14.0), "flat_area": d(v % 7 * 200), "flat": v % 11 == 0, "family": F.when(v % 11 == 0, "LOW_SLOPE").otherwise("STEEP_SLOPE"),
        "failures": F.when(v % 3 == 0, F.array(F.lit("IMAGERY_QUALITY_FAILED"))).otherwise(F.array().cast("array<string>")), "quality": v % 30 * F.lit(0.01) + 0.7, "distance": d(v % 15),
    })
    # bounds off the values that occur, so that the engines' last bits do not decide
    return measurement.evaluate(rows, F.lit("2024-06-30").cast("date"), replace(DEFAULTS, perimeter_percent=5.5))


@query(f"WITH {_ATTEMPTS_SQL} SELECT request_id, rank, final_code, round(score, 4) AS score, age FROM e")
def q44_candidate_evaluation(spark, sf_dir):
    """Every ranked source of a request through all gates, in order."""
    rows = attempts(spark, sf_dir)
    score = scalars.combined_confidence(F.col("quality"), F.col("distance"), F.col("lidar_age"), F.col("reconciliation"), F.col("validated"))
    return rows.select("request_id", F.col("rank").cast("bigint").alias("rank"), "final_code", r(score, 4).alias("score"), F.col("lidar_age").cast("bigint").alias("age"))


@query(f"""WITH {_ATTEMPTS_SQL}, w AS (SELECT request_id, min(rank) FILTER (WHERE final_code IS NULL) AS winner FROM e GROUP BY request_id)
SELECT w.request_id, w.winner, count(*) FILTER (WHERE winner IS NULL OR rank <= winner) AS attempts, string_agg(coalesce(final_code, 'SELECTED'), ',' ORDER BY rank) FILTER (WHERE winner IS NULL OR rank <= winner) AS log,
 CASE WHEN winner IS NOT NULL THEN NULL WHEN bool_or(final_code = 'GEOMETRY_COMMAND_TIMEOUT') THEN 'LIDAR_CANDIDATES_TEMPORARILY_UNAVAILABLE' WHEN bool_and(final_code IN ('LIDAR_CROP_EMPTY', 'NO_USABLE_ROOF_RETURNS')) THEN 'NO_USABLE_ROOF_RETURNS' ELSE 'NO_RELIABLE_LIDAR_GEOMETRY' END AS code
FROM w JOIN e ON w.request_id = e.request_id GROUP BY w.request_id, w.winner""")
def q45_winner_with_log(spark, sf_dir):
    won = measurement.winners(attempts(spark, sf_dir).select("request_id", "rank", "source_id", "final_code"))
    steps = F.array_join(F.transform("log", lambda x: F.coalesce(x["error_code"], F.lit("SELECTED"))), ",")
    return won.select("request_id", F.col("winner").cast("bigint").alias("winner"), F.size("log").cast("bigint").alias("attempts"), steps.alias("log"), "code")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 97 AS a, o_custkey % 89 AS b FROM orders)
SELECT id, CASE WHEN a = 13 THEN 'JSON' ELSE concat_ws(',', CASE WHEN b = 1 THEN 'UNKNOWN_FIELD' END, CASE WHEN a = 2 THEN 'SCHEMA_VERSION' END, CASE WHEN id < 100 THEN 'REQUEST_ID' END, CASE WHEN 2 * b > 90 THEN 'LATITUDE' END, CASE WHEN 2 * a > 180 THEN 'LONGITUDE' END,
 CASE WHEN a = 3 THEN 'ROOF_TYPE' END, CASE WHEN b = 0 THEN 'REFERENCE_AREA' END, CASE WHEN a > 90 THEN 'REFERENCE_PITCH' END, CASE WHEN a = 5 THEN 'IMAGERY_DATE' END, CASE WHEN b = 6 THEN 'IMAGERY_QUALITY' END, CASE WHEN a = 7 THEN 'REFERENCE_FACETS' END, CASE WHEN a <> 7 AND b > 85 THEN 'REFERENCE_FACET' END, CASE WHEN a = 11 THEN 'REQUIRED_OUTPUTS' END) END AS problems FROM o""")
def q46_request_validation(spark, sf_dir):
    """Request JSON, one text an order, some broken in one or several ways."""
    k, a, b = F.col("o_orderkey"), F.col("o_orderkey") % 97, F.col("o_custkey") % 89
    some = lambda condition, yes, no: F.when(condition, F.lit(yes)).otherwise(F.lit(no))
    outputs = ",".join(f'"{x}"' for x in decision.OUTPUTS)
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    facet = s('{"areaSqFt":', F.lit(10) + a, ',"pitchDegrees":20,"azimuthDegrees":', F.when(b > 85, 361).otherwise(b), "}")
    text = s(
        "{", some(b == 1, '"extra":1,', ""), '"schemaVersion":"', some(a == 2, "2.0", "1.0"), '","requestId":"req-', k, '","location":{"latitude":', 2 * b, ',"longitude":-', 2 * a, '},"selectedRoofType":{"name":"', some(a == 3, "", "Shingle"),
        '","family":"STEEP_SLOPE","material":"asphalt","flat":false,"more":1},"solarReference":{"roofAreaSqFt":', b, ',"averagePitchDegrees":', a, ',"maximumPitchDegrees":30,"imageryDate":"', some(a == 5, "May 2020", "2020-05-01"),
        '","imageryQuality":"', some(b == 6, "much too long a word", "HIGH"), some(b == 6, "s", ""), '","facets":[', F.when(a == 7, F.lit("")).otherwise(facet), ']},"requiredOutputs":[', some(a == 11, '"roofAreaSqFt"', outputs), "]}",
    )
    # ids under six characters: "req-" and fewer than two digits are five; the pattern wants six
    lines = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(a == 13, F.lit("no json {")).otherwise(F.when(k < 100, F.regexp_replace(text, "req-", "r")).otherwise(text)).alias("value"))
    return decision.parse_requests(lines).select("id", F.array_join("problems", ",").alias("problems"))


@query(with_views("pts") + """, h AS (SELECT *, coalesce(z, 0) / 20 AS height FROM pts)
SELECT b, count(*) FILTER (WHERE cls IN (1, 2, 6, 7)) AS total, count(*) FILTER (WHERE cls IN (1, 6)) AS roof, count(*) FILTER (WHERE cls IN (2, 6) OR cls IN (0, 1, 9) AND height BETWEEN 1.5e0 AND 25) AS kept,
 count(*) FILTER (WHERE cls IN (1, 6) AND height >= 2 OR cls = 2) AS standing, CASE WHEN count(*) FILTER (WHERE cls IN (1, 2, 6, 7)) = 0 THEN 'LIDAR_CROP_EMPTY' WHEN count(*) FILTER (WHERE cls IN (1, 6)) = 0 THEN 'NO_USABLE_ROOF_RETURNS' END AS code FROM h GROUP BY b""")
def q47_point_filters(spark, sf_dir):
    """Class lists, the height band, clusters and the building class over all returns, by building."""
    rows = roles.points(spark, sf_dir).withColumn("height", F.coalesce("z", F.lit(0.0)) / 20)
    some = points.allowed(rows, F.array(*map(F.lit, (1, 2, 6, 7))))
    crop = points.crop_gate(some, "b", [1, 6])
    kept = points.cleaned(rows).groupBy("b").agg(F.count(F.lit(1)).alias("kept"))
    tall = rows.withColumns({"cluster": F.when(F.col("height") >= 2, 1).otherwise(0), "cls": points.as_building(F.col("cls"), F.array(F.lit(1), F.lit(6)))})
    standing = points.clustered(points.allowed(tall, F.array(F.lit(2), F.lit(6)))).groupBy("b").agg(F.count(F.lit(1)).alias("standing"))
    out = rows.select("b").distinct().join(crop, "b", "left").join(kept, "b", "left").join(standing, "b", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("b", zero("total"), zero("roof"), zero("kept"), zero("standing"), points.crop_code(F.col("total"), F.col("roof")).alias("code"))


@query(with_views("pts") + """SELECT b, count(z) AS n, min(z) AS minimum, max(z) AS maximum, round(avg(z), 4) AS average, count(*) FILTER (WHERE abs(z) <= 20) AS near, count(*) AS candidates FROM pts GROUP BY b""")
def q48_time_stats(spark, sf_dir):
    rows = roles.points(spark, sf_dir)
    counts = rows.groupBy("b").agg(F.count_if(F.abs("z") <= 20).alias("near"), F.count(F.lit(1)).alias("candidates"))
    return points.time_stats(rows, "b", "z").join(counts, "b").withColumn("average", r("average"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, DATE '2023-01-01' + CAST(o_orderkey * 17 % 900 AS INTEGER) AS capture FROM orders),
e AS (SELECT *, c % 9 <> 0 AND k % 4 <> 0 AND c % 5 <> 0 AND k % 6 <> 0 AND capture > DATE '2023-06-01' AND (c % 3 = 0 OR k % 5 < 3 AND c % 4 <> 0) AS eligible FROM o)
SELECT k AS id, eligible, CASE WHEN k % 7 = 0 THEN 'LIDAR_TILE_DATE_UNAVAILABLE' WHEN NOT eligible THEN 'CURRENT_IMAGERY_UNAVAILABLE' WHEN c % 11 = 0 THEN 'CURRENT_IMAGERY_INSUFFICIENT' WHEN k % 5 <= 2 THEN 'GEOMETRY_VERIFIED' ELSE 'HISTORICAL_PRICING_CALIBRATION_HOLD' END AS status,
 k % 7 <> 0 AND eligible AND c % 11 <> 0 AND k % 5 <= 2 AS pricing_allowed FROM e""")
def q49_evidence_decision(spark, sf_dir):
    """Which evidence may be used at all, and what follows with it, without it and without an exact date."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    capture = F.date_add(F.lit("2023-01-01").cast("date"), (k * 17 % 900).cast("int"))
    license_text = F.when(k % 6 == 0, " pending ").otherwise("CC0")
    fit = evidence.eligible(c % 9 != 0, k % 4 != 0, c % 5 != 0, license_text, capture, F.lit("2023-06-01").cast("date"), c % 3 == 0, k % 5 < 3, F.when(c % 4 != 0, "https://x").otherwise(""))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), fit.alias("eligible"), k.alias("k"), c.alias("c"))
    found = F.when(F.col("eligible"), F.when(F.col("c") % 11 == 0, F.array(F.lit("IMAGERY_QUALITY_FAILED"))).otherwise(F.array().cast("array<string>")))
    o = evidence.decided(F.when(F.col("k") % 7 != 0, F.lit("2022-01-01").cast("date")), found, F.col("k") % 5)
    return rows.withColumn("o", o).select("id", "eligible", "o.status", "o.pricing_allowed")


@query("""WITH o AS (SELECT o_orderkey AS id, DATE '2021-01-01' + CAST(o_orderkey * 13 % 1400 AS INTEGER) AS capture, o_custkey % 4 AS q, CAST(o_orderkey % 9 * 100 AS DOUBLE) AS ground, CAST(o_custkey % 6 * 150 AS DOUBLE) AS reference, 600.0e0 AS foot, 500.0e0 AS roof, o_orderkey % 23 * 0.5e0 AS pitch FROM orders)
SELECT id, concat_ws(',', CASE WHEN capture <= DATE '2022-01-01' THEN 'IMAGERY_NOT_NEWER_THAN_LIDAR' END, CASE WHEN 2024 - year(capture) - CASE WHEN (6, 30) < (month(capture), day(capture)) THEN 1 ELSE 0 END > 2 THEN 'IMAGERY_TOO_OLD_FOR_CURRENT_VALIDATION' END, CASE WHEN q = 0 THEN 'IMAGERY_QUALITY_FAILED' END,
 CASE WHEN ground = 0 THEN 'SOLAR_GROUND_AREA_MISSING' END, CASE WHEN ground > 0 AND abs(ground - foot) / foot * 100 > 15 THEN 'FOOTPRINT_AREA_CHANGED' END, CASE WHEN reference = 0 THEN 'ROOF_AREA_COMPARISON_MISSING' END, CASE WHEN reference > 0 AND abs(roof - reference) / reference * 100 > 15 THEN 'ROOF_AREA_CHANGED' END, CASE WHEN pitch > 10 THEN 'ROOF_PITCH_CHANGED' END) AS solar,
 concat_ws(',', CASE WHEN capture <= DATE '2022-01-01' THEN 'IMAGERY_NOT_NEWER_THAN_LIDAR' END, CASE WHEN pitch * 0.03e0 <= 0 OR pitch * 0.03e0 > 0.15e0 THEN 'IMAGERY_GSD_INSUFFICIENT' END, CASE WHEN q = 1 THEN 'IMAGERY_CONTEXT_COVERAGE_INCOMPLETE' END, CASE WHEN q = 0 THEN 'IMAGERY_QUALITY_FAILED' END, CASE WHEN 1 - ground / 10000 < 0.955e0 THEN 'FOOTPRINT_IOU_FAILED' END,
 CASE WHEN pitch / 8 > 0.75e0 THEN 'FOOTPRINT_CENTROID_SHIFTED' END, CASE WHEN reference / 100 > 3 THEN 'FOOTPRINT_AREA_CHANGED' END, CASE WHEN q = 2 THEN 'MATERIAL_STRUCTURE_CHANGE_DETECTED' END) AS file FROM o""")
def q50_evidence_failures(spark, sf_dir):
    """All codes against a building model and against an immutable evidence record."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    capture, lidar_day = F.date_add(F.lit("2021-01-01").cast("date"), (k * 13 % 1400).cast("int")), F.lit("2022-01-01").cast("date")
    q, ground, reference, pitch = c % 4, (k % 9 * 100).cast("double"), (c % 6 * 150).cast("double"), k % 23 * F.lit(0.5)
    solar = evidence.solar_failures(capture, lidar_day, F.lit("2024-06-30").cast("date"), F.when(q == 0, "medium").otherwise("high"), ground, F.lit(600.0), reference, F.lit(500.0), pitch)
    file = evidence.file_failures(F.array().cast("array<string>"), capture, lidar_day, pitch * 0.03, F.when(q == 1, 0.99).otherwise(1.0), q != 0, 1 - ground / 10000 - 0.005, pitch / 8, reference / 100, q == 2)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(solar, ",").alias("solar"), F.array_join(file, ",").alias("file"))


@query("""WITH o AS (SELECT o_orderkey AS id, 1000.0e0 + o_orderkey % 700 AS area, CAST(o_custkey % 23 AS DOUBLE) AS waste, o_orderkey % 41 AS a, o_custkey % 37 AS b FROM orders),
c AS (SELECT *, CASE WHEN a = 1 OR a = 2 THEN 'GEOMETRY_NOT_AUTHORIZED' WHEN a = 3 THEN 'PROFILE_NOT_READY' WHEN a = 4 THEN 'FACETS_REQUIRED' WHEN a = 5 THEN 'PITCH_TOO_STEEP' WHEN a = 6 THEN 'FACET_AREA_INCONSISTENT' WHEN a = 7 THEN 'FACET_TOTAL_MISMATCH'
 WHEN b = 1 THEN 'WASTE_SELECTION_REQUIRED' WHEN b = 2 THEN 'MULTIPLIER_INVALID' WHEN b = 3 THEN 'EDGE_LENGTH_INVALID' END AS code FROM o)
SELECT id, code, CASE WHEN code IS NULL THEN round(area / 100, 6) END AS squares, CASE WHEN code IS NULL THEN waste END AS waste, CASE WHEN code IS NULL THEN round(area * (1 + waste / 100), 6) END AS order_area FROM c""")
def q51_order_quantities(spark, sf_dir):
    """Authorisation, facets that add up, one waste, a multiplier and edges; only then quantities."""
    k, a, b = F.col("o_orderkey"), F.col("o_orderkey") % 41, F.col("o_custkey") % 37
    area, waste = F.lit(1000.0) + k % 700, (F.col("o_custkey") % 23).cast("double")
    facet = lambda share, plan, pitch: F.named_struct(F.lit("area"), area * share, F.lit("plan_area"), area * share * plan, F.lit("pitch"), F.lit(pitch).cast("double"))
    good = F.array(facet(0.5, 1.0, 0.0), facet(0.5, 0.5, 60.0))
    none = F.slice(good, 1, 0)
    facets = F.when(a == 4, none).when(a == 5, F.array(facet(1.0, 1.0, 90.0))).when(a == 6, F.array(facet(1.0, 0.7, 10.0))).when(a == 7, F.array(facet(0.8, 1.0, 0.0))).otherwise(good)
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit(True).alias("available"), (a != 1).alias("pricing_allowed"), F.when(a == 2, "INSPECTION_REQUIRED").otherwise("VERIFIED_CURRENT").alias("verification"),
        F.lit("Yes").alias("active"), F.when(a == 3, "DRAFT").otherwise("READY").alias("readiness"), area.alias("area"), facets.alias("facets"),
        waste.cast("string").alias("simple_waste_percentage"), F.when(b == 1, "99").otherwise(waste.cast("string")).alias("hip_waste_percentage"),
        F.when(b == 2, "0").otherwise("1.2").alias("multiplier"), *[F.when(b == 3, "-1").otherwise("12").alias(e) for e in pricing.EDGES],
    )
    return pricing.quantities(rows).select("id", "code", r("squares", 6).alias("squares"), "waste", r("order_area", 6).alias("order_area"))


@query("""WITH o AS (SELECT o_orderkey AS id, 100.0e0 + o_custkey % 50 AS area, (o_orderkey % 10) * 1.0e0 AS cut, o_custkey % 13 AS a, o_orderkey % 5 AS n, 0.6e0 + (o_orderkey % 8) * 0.05e0 + 0.01e0 AS iou, (o_custkey % 11) * 0.45e0 AS cg, CAST(o_orderkey % 23 AS DOUBLE) AS ag FROM orders),
g AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN area / 2 + (area / 2 + a) ELSE area / 2 + 2 * (area / 2 + a) * cos(radians(60)) END AS ground FROM o)
SELECT id, round(ground, 6) AS ground, CASE WHEN a = 3 THEN 'SOLAR_ROOF_MASK_QUALITY_INSUFFICIENT' WHEN cut / area * 100 > 2.005e0 THEN 'SOLAR_ROOF_MASK_SIMPLIFICATION_CONFLICT' WHEN ground <= 0 THEN 'SOLAR_GROUND_AREA_MISSING' WHEN abs(area - cut - ground) / ground * 100 > 8 THEN 'SOLAR_ROOF_MASK_AREA_CONFLICT'
 WHEN iou < 0.65e0 OR cg > 4 OR ag > 20 THEN 'SOLAR_ROOF_MASK_BUILDING_CONFLICT' END AS code FROM g""")
def q52_mask_gates(spark, sf_dir):
    """Roof outlines from masks: ground area of the reference's facets, stated or projected, and the gates in order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    area, cut, a, n = F.lit(100.0) + c % 50, k % 10 * F.lit(1.0), c % 13, k % 5
    facet = lambda ground, slope, pitch: F.named_struct(F.lit("ground_area"), ground, F.lit("area"), slope, F.lit("pitch"), F.lit(pitch))
    half = facet(area / 2, area, 10.0)
    other = F.when(n == 1, facet(area / 2 + a, area, 0.0)).otherwise(facet(F.lit(None).cast("double"), 2 * (area / 2 + a), 60.0))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), area.alias("area"), cut.alias("cut"), a.alias("a"), k.alias("k"), c.alias("c"), F.when(n == 0, F.slice(F.array(half), 1, 0)).otherwise(F.array(half, other)).alias("facets"))
    rows = rows.withColumn("ground", matching.ground_area(F.col("facets")))
    iou, cg, ag = F.lit(0.6) + F.col("k") % 8 * F.lit(0.05) + 0.01, F.col("c") % 11 * F.lit(0.45), (F.col("k") % 23).cast("double")
    code = footprints.mask_gates(F.when(F.col("a") == 3, "MEDIUM").otherwise("high"), F.col("area") - F.col("cut"), F.col("area"), F.col("ground"), iou, cg, ag)
    return rows.select("id", r("ground", 6).alias("ground"), code.alias("code"))


@query("""WITH s AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'NOAA/x' WHEN s_suppkey % 3 = 1 THEN 'usgs noaa' ELSE 'USGS' END AS provider, s_suppkey AS k FROM supplier)
SELECT source_id, CASE WHEN k % 3 < 2 THEN 'NOAA/DigitalCoast' ELSE 'USGS/3DEP' END AS component, CASE WHEN k % 3 < 2 THEN 'NOAA-PUBLIC-DATASET' ELSE 'USGS-PUBLIC-DOMAIN' END || ' + ODbL + CDLA' AS license,
 CASE WHEN k % 4 = 0 THEN '2,6' ELSE '1,2,6' END AS classes, least(20, k % 31) AS records FROM s""")
def q53_provenance(spark, sf_dir):
    k = F.col("s_suppkey")
    provider = F.when(k % 3 == 0, "NOAA/x").when(k % 3 == 1, "usgs noaa").otherwise("USGS")
    p = matching.provenance(provider, F.lit("ODbL"), F.lit("CDLA"))
    classes = F.when(k % 4 == 0, F.array(F.lit(6), F.lit(2), F.lit(6))).otherwise(F.array(F.lit(6), F.lit(1), F.lit(2), F.lit(1)))
    records = F.slice(F.array_repeat(F.lit("r"), (k % 31).cast("int")), 1, 20)
    rows = table(spark, sf_dir, "supplier").select(k.alias("source_id"), p.alias("p"), F.array_join(lidar.class_list(classes), ",").alias("classes"), F.size(records).cast("bigint").alias("records"))
    return rows.select("source_id", "p.component", "p.license", "classes", "records")


@query("""WITH p AS (SELECT o_custkey AS request_id, o_orderkey AS feature, (o_orderkey % 5) * 0.2e0 AS iou, (o_orderkey % 3) * 1.0e0 AS shift, CAST(o_orderkey AS DOUBLE) AS area_change FROM orders)
SELECT request_id, feature, iou FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY iou DESC, shift, area_change) AS n FROM p) t WHERE n = 1""")
def q54_best_match(spark, sf_dir):
    k = F.col("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), k.alias("feature"), (k % 5 * F.lit(0.2)).alias("iou"), (k % 3 * F.lit(1.0)).alias("shift"), k.cast("double").alias("area_change"))
    return evidence.best_match(pairs, "request_id").select("request_id", "feature", "iou")


@query("""WITH e AS (SELECT l_orderkey AS b, l_linenumber AS seq, ['rakes', 'eaves', 'valleys', 'ridges', 'coplanar'][l_partkey % 5 + 1] AS kind, ['RA', 'EA', 'VA', 'RI', ''][l_partkey % 5 + 1] AS code, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS n FROM lineitem)
SELECT b, seq, kind, code || CAST(row_number() OVER (PARTITION BY b, kind ORDER BY seq) AS VARCHAR) AS edge_id FROM e WHERE n = 1 AND kind <> 'coplanar'""")
def q55_edge_numbers(spark, sf_dir):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    kind = F.element_at(F.array(*map(F.lit, ("rakes", "eaves", "valleys", "ridges", "coplanar"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").withColumn("n", first).where("n = 1").select(F.col("l_orderkey").alias("building_id"), F.col("l_linenumber").alias("seq"), kind.alias("kind"))
    return roof.numbered(rows).select(F.col("building_id").alias("b"), "seq", "kind", "edge_id")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey // 2 * 2 AS pair FROM supplier), r AS (SELECT k, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 14 < 2 THEN 'twin' || CAST(pair AS VARCHAR) ELSE 'src' || CAST(k AS VARCHAR) END AS id FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r)
SELECT k, concat_ws(',', CASE WHEN id IS NULL THEN 'ID_MISSING' END, CASE WHEN n > 1 THEN 'ID_DUPLICATE' END, CASE WHEN k % 8 = 0 THEN 'LICENSE_MISSING' END, CASE WHEN k % 9 = 0 THEN 'DATE_INVALID' END, CASE WHEN k % 9 <> 0 AND k % 7 = 0 THEN 'DATE_OUT_OF_RANGE' END, CASE WHEN k % 9 <> 0 AND (k % 7 = 0 OR k % 5 = 0) THEN 'DATES_REVERSED' END,
 CASE WHEN k % 6 = 0 THEN 'COUNTIES_MISSING' END, CASE WHEN k % 15 = 0 THEN 'CLASS_INVALID' END, CASE WHEN k % 12 = 1 THEN 'ROOF_CLASS_NOT_ALLOWED' END, CASE WHEN k % 21 = 0 THEN 'DENSITY_INVALID' END) AS problems FROM c""")
def q56_registry_audit(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 14 < 2, F.concat(F.lit("twin"), (F.floor(k / 2) * 2).cast("string"))).otherwise(F.concat(F.lit("src"), k.cast("string")))
    day = lambda text: F.lit(text).cast("date")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("k"), F.when(k % 10 != 0, name).alias("source_id"), F.when(k % 8 == 0, " ").otherwise("CC0").alias("license"),
        F.when(k % 9 == 0, F.lit(None).cast("date")).when(k % 7 == 0, day("1999-12-31")).otherwise(day("2020-05-05")).alias("acquired_end"), F.when(k % 5 == 0, day("2021-01-01")).otherwise(day("2020-01-01")).alias("acquired_start"),
        F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Lee"))).alias("counties"), F.when(k % 15 == 0, F.array(F.lit(2), F.lit(6), F.lit(256))).otherwise(F.array(F.lit(2), F.lit(6))).alias("classes"),
        F.when(k % 12 == 1, F.array(F.lit(9))).otherwise(F.array(F.lit(6))).alias("roof_classes"), F.when(k % 21 == 0, 0.0).otherwise(8.0).alias("density"),
    )
    return lidar.registry_problems(rows, day("2024-06-30")).select("k", F.array_join("problems", ",").alias("problems"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey AS BIGINT) * 86399 % 400000000 AS s FROM orders), d AS (SELECT id, DATE '1980-01-06' + CAST(floor(s / 86400.0e0) AS INTEGER) AS a, DATE '1980-01-06' + CAST(floor((s + 1000000000) / 86400.0e0) AS INTEGER) AS b FROM o),
w AS (SELECT *, CASE WHEN (a BETWEEN DATE '1985-01-01' AND DATE '2018-06-30') AND NOT (b BETWEEN DATE '1985-01-01' AND DATE '2018-06-30') THEN a WHEN (b BETWEEN DATE '1985-01-01' AND DATE '2018-06-30') AND NOT (a BETWEEN DATE '1985-01-01' AND DATE '2018-06-30') THEN b END AS day FROM d)
SELECT id, CAST(day AS VARCHAR) AS day, CASE WHEN day < DATE '2018-01-01' THEN 'LIDAR_TILE_BEFORE_MINIMUM_ACQUISITION_DATE' END AS code FROM w""")
def q57_gps_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    days = F.array_distinct(scalars.gps_dates(k.cast("bigint") * 86399 % 400000000))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), days.alias("days"), F.lit("1985-01-01").cast("date").alias("low"), F.lit("2018-06-30").cast("date").alias("high"))
    found = points.gps_date(rows, "id", F.col("days"), "low", "high")
    return found.select("id", F.col("day").cast("string").alias("day"), points.date_floor(F.col("day")).alias("code"))


@query(f"""WITH c(code, http, again) AS (VALUES (NULL, 200, false), {", ".join(f"('{c}', {h}, {a})" for names, h, a in ((decision.TRANSIENT, 503, "true"), (decision.MISSING, 404, "false"), (decision.SETTINGS, 503, "false")) for c in names)}, ('INTERNAL_GEOMETRY_ERROR', 500, false), ('GEOMETRY_CONFIDENCE_TOO_LOW', 422, false)),
n AS (SELECT *, row_number() OVER (ORDER BY code NULLS FIRST) AS i, count(*) OVER () AS m FROM c), o AS (SELECT o_orderkey AS id, o_orderkey % (SELECT max(m) FROM n) + 1 AS i FROM orders)
SELECT o.id, n.code AS error_code, n.http AS http_status, n.again AS retryable, n.code IS NULL AS available FROM o JOIN n ON o.i = n.i""")
def q58_error_envelope(spark, sf_dir):
    known = [None, *sorted([*decision.TRANSIENT, *decision.MISSING, *decision.SETTINGS, "INTERNAL_GEOMETRY_ERROR", "GEOMETRY_CONFIDENCE_TOO_LOW"])]
    codes = F.array(*[F.lit(c).cast("string") for c in known])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(codes, (F.col("o_orderkey") % len(known) + 1).cast("int")).alias("code"))
    return decision.envelope(rows).select("id", "error_code", "http_status", "retryable", "available")


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey % 40 AS VARCHAR) AS f FROM orders), e AS (SELECT DISTINCT CAST(c_custkey % 40 AS VARCHAR) AS f, c_custkey % 40 AS v FROM customer WHERE c_custkey % 40 < 30)
SELECT k AS id, e.v AS record, CASE WHEN e.f IS NULL THEN 'CURRENT_IMAGERY_PROPERTY_NOT_VALIDATED' END AS code FROM o LEFT JOIN e ON o.f = e.f""")
def q59_evidence_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).cast("string").alias("footprint_id"))
    v = F.col("c_custkey") % 40
    records = table(spark, sf_dir, "customer").where(v < 30).select(v.cast("string").alias("footprint_id"), v.alias("record")).distinct()
    return matching.with_evidence(rows, records).select("id", "record", F.col("evidence_code").alias("code"))


@query("""SELECT count(*) AS reports, count(*) FILTER (WHERE s = 0) AS pass, count(*) FILTER (WHERE s = 1) AS fail, count(*) FILTER (WHERE s = 2) AS missing_obj FROM (SELECT o_orderkey % 3 AS s FROM orders) t""")
def q60_manifest_summary(spark, sf_dir):
    status = F.element_at(F.array(F.lit("PASS"), F.lit("FAIL"), F.lit("MISSING_OBJ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return calibration.summary(table(spark, sf_dir, "orders").select(status.alias("status")))


@query("""SELECT o_custkey AS request_id, bool_and(o_orderkey % 4 < 2) AS only_empty FROM orders GROUP BY o_custkey""")
def q61_codes_subset(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("LIDAR_CROP_EMPTY", "NO_USABLE_ROOF_RETURNS", "ROOFER_RMSE_TOO_HIGH", "LIDAR_DENSITY_TOO_LOW"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request_id")).agg(F.collect_set(code).alias("codes"))
    return rows.select("request_id", cascade.all_failures_in("codes", ["LIDAR_CROP_EMPTY", "NO_USABLE_ROOF_RETURNS"]).alias("only_empty"))
