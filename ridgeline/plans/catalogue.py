"""Registered queries over the provided tables, with the SQL each must equal.

Each applies an operator of ``ridgeline.operators`` to a table in a role (``roles``); doubles are rounded, as
engines add in different orders.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import DEFAULTS, METRES_TO_FEET, SQUARE_METRES_TO_SQUARE_FEET, Thresholds
from ..functions import geometry as G
from ..functions import overlay, projection, scalars
from ..operators import calibration, cascade, decision, evidence, footprints, lidar, planes, points, pricing, roof
from . import roles
from .registry import ORACLES, QUERIES, query, r
from .roles import table, with_views

@query(with_views("pts") + "SELECT b, cls, count(*) AS n FROM pts GROUP BY b, cls")
def q01_class_histogram(spark, sf_dir):
    return points.class_histogram(roles.points(spark, sf_dir), "b")


@query(with_views("pts") + """, f AS (SELECT b, count(*) FILTER (WHERE cls = 6) AS n, CAST(max(b % 7 + 1) AS DOUBLE) AS area, CAST(greatest(8, max(b % 12)) AS DOUBLE) AS minimum FROM pts GROUP BY b)
SELECT b, n, round(n / area, 4) AS density, CASE WHEN n / area >= minimum THEN 'OK' ELSE 'LIDAR_DENSITY_TOO_LOW' END AS code FROM f""")
def q02_point_density_gate(spark, sf_dir):
    rows = roles.points(spark, sf_dir).withColumn("area", (F.col("b") % 7 + 1).cast("double"))
    minimum = F.greatest(F.lit(DEFAULTS.min_density), (F.col("b") % 12).cast("double"))
    return points.density(rows, "b", "area", minimum).withColumn("density", r("density"))


@query(with_views("pts") + """SELECT b, CASE WHEN count(DISTINCT d) = 1 THEN CAST(min(d) AS VARCHAR) END AS day FROM (
 SELECT b, CASE WHEN cls = 7 AND d BETWEEN DATE '2024-01-01' + CAST(b % 28 AS INTEGER) AND DATE '2024-01-03' + CAST(b % 28 AS INTEGER) THEN d END AS d FROM pts) t GROUP BY b""")
def q03_gps_single_date(spark, sf_dir):
    low = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("b") % 28).cast("int"))
    days = roles.points(spark, sf_dir).select("b", F.when(F.col("cls") == 7, F.col("d")).alias("day"), low.alias("low"), F.date_add(low, 2).alias("high"))
    return points.only_date(days, "b", "day", "low", "high").withColumn("day", F.col("day").cast("string"))


@query(with_views("src") + """SELECT county, source_id, row_number() OVER (PARTITION BY county ORDER BY acquired_end DESC, coverage DESC, density DESC, priority DESC, source_id) AS rank FROM src""")
def q04_candidate_ranking(spark, sf_dir):
    return lidar.ranked(roles.sources(spark, sf_dir), "county").select("county", "source_id", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH c AS (SELECT o_custkey AS request_id, o_orderkey AS candidate_id, ((o_orderkey * 7) % 40) * 0.75e0 AS distance, (o_orderkey % 13) + 50.0e0 AS area, o_orderkey % 3 = 0 AS inside FROM orders),
w AS (SELECT *, row_number() OVER v AS place, lead(distance) OVER v AS second_distance FROM c WINDOW v AS (PARTITION BY request_id ORDER BY distance, area, candidate_id))
SELECT request_id, candidate_id, distance, CASE WHEN distance > 20 THEN 'BUILDING_FOOTPRINT_NOT_FOUND' WHEN second_distance <= 20 AND abs(second_distance - distance) <= 2 AND NOT inside THEN 'BUILDING_FOOTPRINT_AMBIGUOUS' ELSE 'OK' END AS code FROM w WHERE place = 1""")
def q05_nearest_two_ambiguity(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), k.alias("candidate_id"), (k * 7 % 40 * F.lit(0.75)).alias("distance"), (k % 13 + F.lit(50.0)).alias("area"), (k % 3 == 0).alias("inside"))
    best = footprints.nearest_two(rows, "request_id", "distance", "area", "candidate_id")
    code = footprints.ambiguity(F.col("distance"), F.col("second_distance"), F.col("inside"), F.lit(False))
    return best.select("request_id", "candidate_id", "distance", F.coalesce(code, F.lit("OK")).alias("code"))


@query(with_views("src", "req") + """SELECT r.request_id, s.source_id, CASE WHEN NOT (s.enabled AND s.county = r.county) THEN 'SKIPPED_DISABLED_OR_COUNTY' WHEN s.license = 'PENDING' THEN 'REJECTED_LICENSE_UNVERIFIED'
 WHEN s.acquired_end < DATE '2018-01-01' THEN 'REJECTED_BEFORE_MINIMUM_ACQUISITION_DATE' WHEN s.coverage < 0.98e0 THEN 'NO_COMPLETE_BUFFERED_COVERAGE' ELSE 'CANDIDATE' END AS decision FROM req r CROSS JOIN src s""")
def q06_source_decision_chain(spark, sf_dir):
    found = lidar.decide(roles.requests(spark, sf_dir), roles.sources(spark, sf_dir))
    return found.select("request_id", "source_id", "decision")


@query("""SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*e') OR regexp_matches(p_name, '7$')""")
def q07_regex_catalog_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.where(lidar.matches_catalogue(F.col("p_name"), ["(?i)^[a-m].*e", "7$"]))


@query(with_views("rect") + """, m AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) AS inter, aw * ah AS aa, bw * bh AS ab FROM rect)
SELECT id, round(inter / (aa + ab - inter), 6) AS iou, round(sqrt(pow(ax + aw / 2 - bx - bw / 2, 2) + pow(ay + ah / 2 - b_y - bh / 2, 2)), 6) AS centroid_gap, round(abs(aa - ab) / greatest(aa, ab) * 100, 6) AS area_gap FROM m""")
def q08_iou_rectangles(spark, sf_dir):
    rows = roles.rectangles(spark, sf_dir).withColumn("inter", overlay.intersection_area("ra", "rb"))
    m = footprints.compare(F.col("ra"), F.col("rb"), F.col("inter"))  # fields not taken are not computed
    return rows.select("id", *[r(m[c], 6).alias(c) for c in ("iou", "centroid_gap", "area_gap")])


@query(with_views("rect") + "SELECT id, round(aw * ah, 6) AS area, round(2 * (aw + ah), 6) AS perimeter, round(ax + aw / 2, 6) AS cx, round(ay + ah / 2, 6) AS cy FROM rect")
def q09_ring_area_perimeter_centroid(spark, sf_dir):
    rows = roles.rectangles(spark, sf_dir).select("id", F.array("ra").alias("p"), "ra", G.centroid(F.col("ra")).alias("c"))
    return rows.select("id", r(G.area(F.col("p")), 6).alias("area"), r(G.perimeter(F.col("p")), 6).alias("perimeter"), r("c.x", 6).alias("cx"), r("c.y", 6).alias("cy"))


@query(with_views("tri") + "SELECT id, round(area, 4) AS area, round(pitch, 4) AS pitch, round(azimuth, 3) % 360 AS azimuth, round(12 * tan(radians(pitch)), 4) AS rise FROM facet WHERE gx <> 0 OR gy <> 0")
def q10_facet_pitch_azimuth(spark, sf_dir):
    rows = roles.triangles(spark, sf_dir).withColumn("v", G.newell(F.col("ring")))
    rows = rows.withColumn("n", G.upward(F.col("v"))).where((F.col("v.x") != 0) | (F.col("v.y") != 0))
    pitch = G.pitch_degrees(F.col("n"))
    return rows.select("id", r(G.norm(F.col("v")) / 2).alias("area"), r(pitch).alias("pitch"), (r(G.azimuth_degrees(F.col("n")), 3) % 360).alias("azimuth"), r(G.rise_per_12(pitch)).alias("rise"))


@query("""WITH e AS (SELECT o_orderkey AS id, (o_orderkey % 9 - 4) * 0.05e0 AS d1, (o_custkey % 9 - 4) * 0.05e0 AS d2, (o_orderkey % 5) * 0.1e0 AS drop_, (o_custkey % 4) * 1.5e0 AS angle, (o_orderkey % 6) * 0.1e0 AS middle FROM orders)
SELECT id, CASE WHEN angle <= 2 THEN 'coplanar' WHEN (d1 > 0.08e0 OR d2 > 0.08e0) AND NOT (d1 < -0.08e0 OR d2 < -0.08e0) THEN 'valleys'
 WHEN (d1 < -0.08e0 OR d2 < -0.08e0) AND NOT (d1 > 0.08e0 OR d2 > 0.08e0) THEN CASE WHEN drop_ <= 0.15e0 THEN 'ridges' ELSE 'hips' END ELSE 'ambiguous' END AS shared,
 CASE WHEN drop_ > 0.15e0 THEN 'rakes' WHEN middle <= 0.25e0 + 0.08e0 THEN 'eaves' ELSE 'highPerimeters' END AS single FROM e""")
def q11_edge_classification(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d1, d2, drop = (k % 9 - 4) * F.lit(0.05), (c % 9 - 4) * F.lit(0.05), k % 5 * F.lit(0.1)
    shared = roof.classify_pair(c % 4 * F.lit(1.5), d1, d2, drop)
    single = roof.classify_single(drop, k % 6 * F.lit(0.1), F.lit(0.25))
    return table(spark, sf_dir, "orders").select(k.alias("id"), shared.alias("shared"), single.alias("single"))


@query(with_views("tri") + f"""SELECT b, round(sum(area) * {SQUARE_METRES_TO_SQUARE_FEET!r}, 2) AS roof_area, round(sum(pitch * area) / sum(area), 4) AS average_pitch, round(max(pitch), 4) AS maximum_pitch,
 round(coalesce(sum(area) FILTER (WHERE pitch <= 5.03e0), 0) * {SQUARE_METRES_TO_SQUARE_FEET!r}, 2) AS flat_area FROM facet GROUP BY b""")
def q12_weighted_pitch_rollup(spark, sf_dir):
    rows = roles.triangles(spark, sf_dir).withColumn("v", G.newell(F.col("ring")))
    found = rows.select(
        F.col("b").alias("building_id"), F.col("id").alias("pos"), (G.norm(F.col("v")) / 2).alias("area"), G.ring_area(F.col("ring")).alias("plan_area"), G.pitch_degrees(G.upward(F.col("v"))).alias("pitch"),
        F.lit(None).cast("string").alias("code"), F.lit(0).alias("openings"), F.lit(0.0).alias("opening_perimeter"),
    )
    out = roof.facet_totals(found, Thresholds(flat_pitch_degrees=5.03), digits=4)
    return out.select(F.col("building_id").cast("bigint").alias("b"), F.col("roof_area_sqft").alias("roof_area"), "average_pitch", "maximum_pitch", F.col("flat_area_sqft").alias("flat_area"))


@query("""WITH e AS (SELECT l_partkey AS b, l_linenumber % 6 AS kind, round(CAST(l_quantity AS DOUBLE) * 3.280839895013123e0, 2) AS feet FROM lineitem),
t AS (SELECT b, round(coalesce(sum(feet) FILTER (WHERE kind = 0), 0), 2) AS rakes, round(coalesce(sum(feet) FILTER (WHERE kind = 1), 0), 2) AS eaves, round(coalesce(sum(feet) FILTER (WHERE kind = 2), 0), 2) AS valleys,
 round(coalesce(sum(feet) FILTER (WHERE kind = 3), 0), 2) AS ridges, round(coalesce(sum(feet) FILTER (WHERE kind = 4), 0), 2) AS hips, round(coalesce(sum(feet) FILTER (WHERE kind = 5), 0), 2) AS high_perimeters FROM e GROUP BY b)
SELECT *, round(eaves + rakes, 2) AS external_feet, round(ridges + hips + valleys, 2) AS internal_feet FROM t""")
def q13_edge_totals_pivot(spark, sf_dir):
    feet = r(F.col("l_quantity").cast("double") * METRES_TO_FEET, 2)
    kind = F.element_at(F.array(*map(F.lit, roof.KINDS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("building_id"), kind.alias("kind"), feet.alias("length_feet"), feet.alias("plan_feet"), F.lit(1).alias("n_uses"))
    out = roof.edge_totals(rows)
    return out.select(F.col("building_id").alias("b"), "rakes", "eaves", "valleys", "ridges", "hips", F.col("highPerimeters").alias("high_perimeters"), F.col("external_perimeter_feet").alias("external_feet"), F.col("internal_edge_feet").alias("internal_feet"))


@query(with_views("plane") + """, f AS (SELECT unnest([0, 1, 2]) AS facet), d AS (SELECT p.g, p.pid, f.facet, abs((p.x - 0.05e0 * f.facet) * CASE WHEN f.facet = 0 THEN 1.0e0 ELSE 0.0e0 END + (p.y - 0.02e0 * f.facet) * CASE WHEN f.facet = 1 THEN 1.0e0 ELSE 0.0e0 END + p.z * CASE WHEN f.facet = 2 THEN 1.0e0 ELSE 0.0e0 END) AS d FROM plane p CROSS JOIN f),
m AS (SELECT *, row_number() OVER (PARTITION BY g, pid ORDER BY d, facet) AS n FROM d)
SELECT g, pid, facet, round(d, 6) AS d FROM m WHERE n = 1 AND d <= 0.05e0""")
def q14_nearest_plane_assign(spark, sf_dir):
    pts = roles.plane_points(spark, sf_dir)
    unit = [(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 0.05, 0.02, 0.0, 0.0, 1.0, 0.0), (2, 0.1, 0.04, 0.0, 0.0, 0.0, 1.0)]
    three = spark.createDataFrame(unit, "facet int, ox double, oy double, oz double, nx double, ny double, nz double")
    facets = pts.select("g").distinct().crossJoin(F.broadcast(three))  # three planes for each group
    return planes.nearest_plane(pts, facets, "g", limit=0.05).select("g", "pid", "facet", r("d", 6).alias("d"))


@query(with_views("plane") + """, m AS (SELECT g, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM plane GROUP BY g),
k AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m)
SELECT g, n, round(a, 6) AS a, round(b, 6) AS b, round(sqrt(greatest(0, zz - a * xz - b * yz)), 6) AS rmse, round(degrees(atan(sqrt(a * a + b * b))), 5) AS pitch FROM k""")
def q15_plane_fit_moments(spark, sf_dir):
    m = planes.moments(roles.plane_points(spark, sf_dir), "g")
    return m.select("g", "n", *[r(c, 6).alias(c) for c in ("a", "b", "rmse")], r("pitch", 5).alias("pitch"))


@query("""WITH q AS (SELECT o_orderkey AS id, (o_orderkey % 31) * 0.8e0 AS density, (o_custkey % 17) * 0.01e0 AS nodata, (o_orderkey % 13) * 0.04e0 AS rmse, (o_custkey % 23) * 1.0e0 AS distance, o_orderkey % 12 AS age, (o_custkey % 11) * 0.1e0 AS rec, o_orderkey % 2 = 0 AS ok FROM orders),
c AS (SELECT *, CASE WHEN density < 8 THEN 'LIDAR_DENSITY_TOO_LOW' WHEN nodata > 0.1e0 THEN 'LIDAR_COVERAGE_INCOMPLETE' WHEN rmse > 0.35e0 THEN 'ROOFER_RMSE_TOO_HIGH' ELSE 'OK' END AS code,
 least(1.0e0, density / 12) * 0.35e0 + greatest(0.0e0, least(1.0e0, 1 - nodata / 0.1e0)) * 0.35e0 + greatest(0.0e0, least(1.0e0, 1 - rmse / 0.35e0)) * 0.3e0 AS quality FROM q)
SELECT id, code, round(quality, 6) AS quality, round(quality * 0.55e0 + greatest(0.0e0, 1 - distance / 20) * 0.1e0 + CASE WHEN ok THEN 1.0e0 ELSE greatest(0.0e0, 1 - age / 10.0e0) END * 0.1e0 + least(1.0e0, rec) * 0.25e0, 6) AS confidence FROM c""")
def q16_quality_confidence(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    density, nodata, rmse = k % 31 * F.lit(0.8), c % 17 * F.lit(0.01), k % 13 * F.lit(0.04)
    t = DEFAULTS
    code = scalars.first_code((density < t.min_density, "LIDAR_DENSITY_TOO_LOW"), (nodata > t.max_nodata_fraction, "LIDAR_COVERAGE_INCOMPLETE"), (rmse > t.max_rmse_m, "ROOFER_RMSE_TOO_HIGH"))
    quality = scalars.quality_confidence(density, nodata, rmse)
    score = scalars.combined_confidence(quality, c % 23 * F.lit(1.0), k % 12, c % 11 * F.lit(0.1), k % 2 == 0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.coalesce(code, F.lit("OK")).alias("code"), r(quality, 6).alias("quality"), r(score, 6).alias("confidence"))


@query("""WITH q AS (SELECT o_orderkey AS id, 1000.0e0 + o_orderkey % 300 AS area, 1100.0e0 + o_custkey % 90 AS ref, (o_orderkey % 40) * 0.7e0 AS pitch, (o_custkey % 35) * 0.8e0 AS ref_pitch FROM orders),
v AS (SELECT id, abs(area - ref) / ref * 100 AS av, abs(pitch - ref_pitch) AS pv FROM q)
SELECT id, round(av, 4) AS area_variance, round(pv, 4) AS pitch_variance, CASE WHEN av > 15 THEN 'SOLAR_AREA_RECONCILIATION_FAILED' WHEN pv > 10.05e0 THEN 'SOLAR_PITCH_RECONCILIATION_FAILED' ELSE 'OK' END AS code,
 round((greatest(0, 1 - av / 15) + greatest(0, 1 - pv / 10.05e0)) / 2, 5) AS reconciliation FROM v""")
def q17_reconciliation(spark, sf_dir):
    from dataclasses import replace

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), (F.lit(1000.0) + k % 300).alias("area"), (F.lit(1100.0) + c % 90).alias("reference_area"), (k % 40 * F.lit(0.7)).alias("pitch"), (c % 35 * F.lit(0.8)).alias("reference_pitch"))
    out = decision.reconcile(rows, replace(DEFAULTS, max_solar_pitch_degrees=10.05))
    return out.select("id", r("area_variance").alias("area_variance"), r("pitch_variance").alias("pitch_variance"), F.coalesce("reconciliation_code", F.lit("OK")).alias("code"), r("reconciliation", 5).alias("reconciliation"))


@query(with_views("src", "req") + """, p AS (SELECT r.request_id, s.source_id, s.acquired_end, row_number() OVER (PARTITION BY r.request_id ORDER BY s.acquired_end DESC, s.source_id) AS n FROM req r JOIN src s ON r.county = s.county AND s.acquired_end > r.lidar_date)
SELECT r.request_id, p.source_id, CAST(p.acquired_end AS VARCHAR) AS captured FROM req r LEFT JOIN p ON r.request_id = p.request_id AND p.n = 1""")
def q18_newest_evidence_asof(spark, sf_dir):
    src = roles.sources(spark, sf_dir).select("source_id", "county", "acquired_end")
    best = evidence.newest_after(roles.requests(spark, sf_dir).select("request_id", "county", "lidar_date"), src, ["county"], "lidar_date", "acquired_end", "source_id")
    return best.select("request_id", "source_id", F.col("acquired_end").cast("string").alias("captured"))


@query("""WITH q AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS lidar, DATE '1992-01-01' + CAST((o_custkey * 7) % 3000 AS INTEGER) AS capture, (o_orderkey % 5) * 0.05e0 AS gsd, 0.8e0 + (o_custkey % 20) * 0.01e0 AS iou, (o_orderkey % 6) * 0.5e0 AS shift, (o_custkey % 25) * 0.5e0 AS area, o_orderkey % 5 AS age FROM orders),
f AS (SELECT id, age, concat_ws(',', CASE WHEN capture <= lidar THEN 'IMAGERY_NOT_NEWER_THAN_LIDAR' END,
 CASE WHEN 1996 - year(capture) - CASE WHEN (6, 30) < (month(capture), day(capture)) THEN 1 ELSE 0 END > 2 THEN 'IMAGERY_TOO_OLD_FOR_CURRENT_VALIDATION' END,
 CASE WHEN gsd <= 0 OR gsd > 0.15e0 THEN 'IMAGERY_GSD_INSUFFICIENT' END, CASE WHEN iou < 0.85e0 THEN 'FOOTPRINT_IOU_FAILED' END, CASE WHEN shift > 2 THEN 'FOOTPRINT_CENTROID_SHIFTED' END, CASE WHEN area > 10 THEN 'FOOTPRINT_AREA_CHANGED' END) AS failures FROM q)
SELECT id, failures, CASE WHEN failures <> '' THEN 'INSPECTION_REQUIRED' WHEN age <= 2 THEN 'VERIFIED_CURRENT' ELSE 'VERIFIED_HISTORICAL_UNCHANGED' END AS verification,
 CASE WHEN failures LIKE '%FOOTPRINT%' THEN 'STRUCTURE_CHANGED_AFTER_LIDAR' WHEN failures <> '' THEN 'CURRENT_IMAGERY_INSUFFICIENT' WHEN age <= 2 THEN 'GEOMETRY_VERIFIED' ELSE 'HISTORICAL_PRICING_CALIBRATION_HOLD' END AS status FROM f""")
def q19_failure_codes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    capture = F.date_add(F.lit("1992-01-01").cast("date"), (c * 7 % 3000).cast("int"))
    failures = evidence.footprint_failures(capture, F.to_date("o_orderdate"), F.lit("1996-06-30").cast("date"), k % 5 * F.lit(0.05), F.lit(0.8) + c % 20 * F.lit(0.01), k % 6 * F.lit(0.5), c % 25 * F.lit(0.5))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), failures.alias("f"), (k % 5).alias("age"))
    rows = rows.withColumn("o", evidence.outcome(F.col("f"), F.col("age")))
    return rows.select("id", F.array_join("f", ",").alias("failures"), "o.verification", "o.status")


@query("""SELECT o_orderkey AS id, CAST(greatest(0, 1998 - year(o_orderdate) - CASE WHEN (2, 28) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END) AS INTEGER) AS age FROM orders""")
def q20_year_age(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scalars.year_age(F.to_date("o_orderdate"), F.lit("1998-02-28").cast("date")).cast("int").alias("age"))


def _quadkey_sql(zoom: int) -> str:
    digits = " || ".join(f"CAST(((tx >> {k}) & 1) + 2 * ((ty >> {k}) & 1) AS VARCHAR)" for k in range(zoom - 1, -1, -1))
    return f""", t AS (SELECT request_id, lon, lat, CAST(floor((lon + 180) / 360 * {1 << zoom}) AS INTEGER) AS tx,
 CAST(floor((0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {1 << zoom}) AS INTEGER) AS ty FROM req)
SELECT request_id, {digits} AS quadkey, CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM t"""


@query(with_views("req") + _quadkey_sql(9))
def q21_quadkey(spark, sf_dir):
    rows = roles.requests(spark, sf_dir)
    lon, lat = F.col("lon"), F.col("lat")
    return rows.select("request_id", projection.quadkey(lon, lat).alias("quadkey"), projection.utm_epsg(lon, lat).alias("epsg"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS request_id, l_linenumber AS rank, CASE l_orderkey * 3 % 7 + l_linenumber % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'UNRELIABLE' WHEN 2 THEN 'TRANSIENT' WHEN 6 THEN 'OK' ELSE 'NO_COVERAGE' END AS outcome FROM lineitem),
w AS (SELECT request_id, min(rank) FILTER (WHERE outcome IN ('OK', 'UNRELIABLE')) AS winner FROM a GROUP BY request_id)
SELECT a.request_id, CAST(w.winner AS INTEGER) AS winner, coalesce(max(outcome) FILTER (WHERE rank = winner), 'BUILDING_FOOTPRINT_NOT_FOUND') AS outcome, count(*) FILTER (WHERE winner IS NULL OR rank <= winner) AS attempts,
 coalesce(bool_or(outcome = 'TRANSIENT') FILTER (WHERE winner IS NULL OR rank <= winner), false) AS retryable FROM a JOIN w ON a.request_id = w.request_id GROUP BY a.request_id, w.winner""")
def q22_first_success_cascade(spark, sf_dir):
    k = F.col("l_orderkey") * 3 % 7 + F.col("l_linenumber") % 4
    outcome = F.when(k.isin(0, 6), "OK").when(k == 1, "UNRELIABLE").when(k == 2, "TRANSIENT").otherwise("NO_COVERAGE")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("int").alias("rank"), outcome.alias("outcome")).distinct()
    return cascade.first_decisive(rows, "request_id")


@query("""WITH p AS (SELECT p_partkey % 25 AS county, p_type AS material, p_retailprice FROM part), cells AS (SELECT c.county, m.material FROM (SELECT DISTINCT county FROM p) c CROSS JOIN (SELECT DISTINCT material FROM p) m),
n AS (SELECT county, material, count(*) AS n FROM p WHERE p_retailprice < 903 GROUP BY county, material)
SELECT cells.county, cells.material, coalesce(n.n, 0) AS profiles, CASE WHEN n.n IS NULL THEN 'MISSING_APPROVED_PRICE' WHEN n.n = 1 THEN 'READY' ELSE 'REVIEW_PROFILE_OVERLAP' END AS status FROM cells LEFT JOIN n ON cells.county = n.county AND cells.material = n.material""")
def q23_pricebook_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("county"), F.col("p_type").alias("material"), "p_retailprice")
    return pricing.coverage(p, p, p.where("p_retailprice < 903"))


@query("""WITH m AS (SELECT o_orderkey AS id, (500.0e0 + o_orderkey % 3000) * (1 + (o_custkey % 20) / 100.0e0) AS a, (o_orderkey % 90) + (o_custkey % 70) * 1.0e0 AS rh, (o_custkey % 210) * 1.0e0 AS e FROM orders),
u AS (SELECT id, 'bundles' AS package, a AS required, 33.3e0 AS coverage FROM m UNION ALL SELECT id, 'caps', rh, 20.0e0 FROM m UNION ALL SELECT id, 'starter', e, 105.0e0 FROM m)
SELECT id, package, round(required, 4) AS required, CAST(ceil(required / coverage - 1e-10) AS BIGINT) AS packages FROM u""")
def q24_order_packages(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    area = pricing.order_area(F.lit(500.0) + k % 3000, c % 20)
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), area.alias("areaSqFt"), (k % 90 + c % 70 * F.lit(1.0)).alias("ridgeHipFeet"), (c % 210 * F.lit(1.0)).alias("eavesFeet"))
    specs = spark.createDataFrame([("bundles", "areaSqFt", 33.3), ("caps", "ridgeHipFeet", 20.0), ("starter", "eavesFeet", 105.0)], "package string, basis string, coverage double")
    return pricing.package_counts(rows, specs, "id").withColumn("required", r("required"))


@query("""WITH a AS (SELECT o_orderkey AS report_id, 1000.0e0 + o_orderkey % 50 AS area, CAST(o_orderkey % 9 AS INTEGER) AS facets, CAST(o_orderkey % 12 AS DOUBLE) AS rise FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS report_id, 1005.0e0 + o_orderkey % 60 AS area, CAST(o_orderkey % 8 AS INTEGER) AS facets, CAST(o_orderkey % 11 AS DOUBLE) AS rise FROM orders WHERE o_orderpriority < '3'),
r AS (SELECT coalesce(b.report_id, a.report_id) AS report_id, CASE WHEN b.report_id IS NOT NULL THEN b.area ELSE a.area END AS area, CASE WHEN b.report_id IS NOT NULL THEN b.facets ELSE a.facets END AS facets, CASE WHEN b.report_id IS NOT NULL THEN b.rise ELSE a.rise END AS rise FROM b FULL JOIN a ON a.report_id = b.report_id),
m AS (SELECT o_orderkey AS report_id, 1002.0e0 + o_orderkey % 50 AS area, CAST(o_orderkey % 9 AS INTEGER) AS facets, CAST(o_orderkey % 12 AS BIGINT) AS rise_class FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
j AS (SELECT r.report_id, m.area AS ma, abs(m.area - r.area) / r.area * 100 AS area_error, abs(degrees(atan(m.rise_class / 12.0e0)) - degrees(atan(r.rise / 12))) AS pitch_error, m.facets = r.facets AS same FROM r LEFT JOIN m ON r.report_id = m.report_id)
SELECT report_id, round(area_error, 5) AS area_error, round(pitch_error, 5) AS pitch_error, CASE WHEN ma IS NULL THEN 'MISSING_OBJ' WHEN area_error <= 1 AND pitch_error <= 1 AND same THEN 'PASS' ELSE 'FAIL' END AS status FROM j""")
def q25_manifest_join(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    # status and priority say which reports exist as text, as export and as mesh
    view = lambda keep, base, m, f, p: o.where(keep).select(k.alias("report_id"), (F.lit(base) + k % m).alias("area"), (k % f).cast("int").alias("facets"), (k % p).cast("double").alias("rise"))
    refs = calibration.preferred_reference(view(F.col("o_orderstatus") != "P", 1000.0, 50, 9, 12), view(F.col("o_orderpriority") < "3", 1005.0, 60, 8, 11))
    meshes = o.where("o_orderpriority <> '4-NOT SPECIFIED'").select(k.alias("report_id"), (F.lit(1002.0) + k % 50).alias("area"), (k % 9).cast("int").alias("facets"), (k % 12).alias("rise_class"), F.lit(0.0).alias("max_error"))
    out = calibration.compare(refs, meshes)
    return out.select("report_id", r("area_error", 5).alias("area_error"), r("pitch_error", 5).alias("pitch_error"), "status")


@query(with_views("tri") + """, o AS (SELECT b, id, area, CAST(floor(12 * tan(radians(pitch)) + 0.500001e0) AS BIGINT) AS rise_class FROM facet),
c AS (SELECT b, rise_class, sum(area) AS class_area, min(id) AS met FROM o GROUP BY b, rise_class), w AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(class_area, 6) DESC, met) AS n FROM c)
SELECT b, rise_class, round(class_area, 4) AS class_area FROM w WHERE n = 1""")
def q26_pitch_class_dominant(spark, sf_dir):
    rows = roles.triangles(spark, sf_dir).withColumn("v", G.newell(F.col("ring")))
    rows = rows.select("b", F.col("id").alias("met"), r(G.norm(F.col("v")) / 2, 9).alias("area"), G.pitch_degrees(G.upward(F.col("v"))).alias("pitch"))
    return calibration.dominant_class(rows, "b", "met").select("b", "rise_class", r("class_area").alias("class_area"))


@query("""SELECT n_regionkey AS g, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM (SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) || '|' || n_name AS line FROM nation) t GROUP BY n_regionkey""")
def q27_fingerprint(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), "n_nationkey", "n_name")
    return calibration.fingerprint(n, "g", ["n_nationkey", "n_name"])


@query("""WITH e AS (SELECT event_id AS id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT id, k, CASE WHEN k <> 0 THEN CAST(DATE '1970-01-01' + CAST(floor(k * 1e9 / 86400000) AS INTEGER) AS VARCHAR) END AS day FROM e""")
def q28_json_evidence_parse(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("double")
    day = scalars.epoch_date((k * 1e9).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), k.alias("k"), day.cast("string").alias("day"))


@query(r"""WITH t AS (SELECT doc_id, 'Report: ' || CAST(100000 + doc_id AS VARCHAR) || chr(10) || 'Total Roof Area = ' || CAST(1 + doc_id % 9 AS VARCHAR) || ',' || CAST(100 + doc_id % 800 AS VARCHAR) || '.5 sq ft' || chr(10) || 'Total Roof Facets = ' || CAST(doc_id % 30 AS VARCHAR) || chr(10) || substr(text, 1, 0) || 'Predominant Pitch = ' || CAST(doc_id % 12 AS VARCHAR) || '/12' AS s FROM documents)
SELECT doc_id, regexp_extract(s, 'Report:\s*(\d{6,12})', 1) AS report_id, TRY_CAST(replace(regexp_extract(s, 'Total Roof Area\s*=\s*([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS area,
 TRY_CAST(regexp_extract(s, 'Total Roof Facets\s*=\s*(\d+)', 1) AS INTEGER) AS facets, TRY_CAST(regexp_extract(s, 'Predominant Pitch\s*=\s*([0-9.]+)\s*/\s*12', 1) AS DOUBLE) AS rise FROM t""")
def q29_text_metric_extract(spark, sf_dir):
    d = F.col("doc_id")
    s = F.concat(F.lit("Report: "), (d + 100000).cast("string"), F.lit("\nTotal Roof Area = "), (d % 9 + 1).cast("string"), F.lit(","), (d % 800 + 100).cast("string"), F.lit(".5 sq ft\nTotal Roof Facets = "), (d % 30).cast("string"), F.lit("\n"), F.substring("text", 1, 0), F.lit("Predominant Pitch = "), (d % 12).cast("string"), F.lit("/12"))
    out = calibration.report_from_text(table(spark, sf_dir, "documents").select("doc_id", s.alias("text")))
    return out.select("doc_id", "report_id", "area", "facets", "rise")


@query(with_views("pts") + """, p AS (SELECT b AS g, pid, x, y, z FROM pts WHERE z IS NOT NULL), d AS (SELECT a.g, a.pid, sqrt((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) + (a.z - o.z) * (a.z - o.z)) AS d, o.pid AS other FROM p a JOIN p o ON a.g = o.g AND a.pid <> o.pid),
w AS (SELECT *, row_number() OVER (PARTITION BY g, pid ORDER BY d, other) AS n FROM d), m AS (SELECT g, pid, avg(d) AS mean_distance FROM w WHERE n <= 12 GROUP BY g, pid), l AS (SELECT g, avg(mean_distance) + 2.2e0 * stddev_samp(mean_distance) AS lim FROM m GROUP BY g)
SELECT m.g, m.pid, round(mean_distance, 5) AS mean_distance, coalesce(mean_distance > lim, false) AS outlier FROM m JOIN l ON m.g = l.g""")
def q30_knn_outlier(spark, sf_dir):
    rows = roles.points(spark, sf_dir).where("z IS NOT NULL").withColumnRenamed("b", "g")
    out = points.outliers(rows, "g").where("mean_distance IS NOT NULL AND NOT isnan(mean_distance)")
    return out.select("g", "pid", r("mean_distance", 5).alias("mean_distance"), "outlier")


@query()
def q31_ransac_planes(spark, sf_dir):
    fits = planes.fit_planes(roles.plane_points(spark, sf_dir), ["g"])
    return fits.select("g", "n", "inliers", r("inlier_ratio").alias("inlier_ratio"), r("rmse").alias("rmse"), r("pitch", 3).alias("pitch"))


@query()
def q32_clusters(spark, sf_dir):
    rows = roles.points(spark, sf_dir).where("z IS NOT NULL").withColumn("g", F.col("b"))
    return points.clusters(rows, "g")


@query()
def q33_concave_overlay(spark, sf_dir):
    u = lambda x, y: F.array(*[G.point(x + dx, y + dy) for dx, dy in ((0, 0), (9, 0), (9, 8), (6, 8), (6, 3), (3, 3), (3, 8), (0, 8))])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), u((k % 5).cast("double"), (c % 3).cast("double")).alias("a"), u((c % 4).cast("double") + 0.25, (k % 3).cast("double") + 0.25).alias("b"))
    rows = rows.withColumn("inter", overlay.intersection_area("a", "b"))
    return rows.select("id", r("inter", 6).alias("inter"), r(footprints.compare(F.col("a"), F.col("b"), F.col("inter"))["iou"], 6).alias("iou"))


def saltbox(front: float, back: float = 6.0, length: float = 11.0) -> str:
    """One line of city-model text: a ridge 3 m up, a front slope down to the ground, a back slope that ends half a metre above it."""
    corners = [(x, y, z) for x, z in ((0, 0), (front, 3), (front + back, 0.5)) for y in (0, length)]
    slopes = [[[0, 2, 3, 1]], [[2, 4, 5, 3]]]
    geometry = {"type": "MultiSurface", "lod": "2.2", "boundaries": slopes, "semantics": {"surfaces": [{"type": "WallSurface"}, {"type": "RoofSurface"}], "values": [1, 1]}}
    quality = {"rf_success": True, "rf_extrusion_mode": "standard", "rf_pt_density": 22.5, "rf_nodata_frac": 0.03, "rf_rmse_lod22": 0.07}
    objects = {"house": {"type": "Building", "attributes": quality}, "house-roof": {"type": "BuildingPart", "geometry": [geometry]}}
    return json.dumps({"type": "CityJSONFeature", "id": "house", "vertices": [list(c) for c in corners], "CityObjects": objects})


@query(f"""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS building_id, 2.0e0 + (c_custkey % 4) AS f FROM customer),
p AS (SELECT building_id, 11 * sqrt(f * f + 9) AS a1, 11 * sqrt(36 + 6.25e0) AS a2, degrees(atan(3 / f)) AS p1, degrees(atan(2.5e0 / 6)) AS p2 FROM s)
SELECT building_id, 2 AS facets, round((a1 + a2) * {SQUARE_METRES_TO_SQUARE_FEET!r}, 2) AS roof_area, round((p1 * a1 + p2 * a2) / (a1 + a2), 2) AS pitch,
 round(11 * {METRES_TO_FEET!r}, 2) AS ridges, round(2 * round(11 * {METRES_TO_FEET!r}, 2), 2) AS eaves FROM p""")
def q34_cityjson_saltbox(spark, sf_dir):
    """City-model text, one building a customer with one of four front slopes, measured end to end."""
    text = F.element_at(F.array(*[F.lit(saltbox(2.0 + i)) for i in range(4)]), (F.col("c_custkey") % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("building_id"), text.alias("value"))
    m = roof.measure(lines)
    return m.select("building_id", F.col("facets").cast("int").alias("facets"), F.col("roof_area_sqft").alias("roof_area"), F.col("average_pitch").alias("pitch"), "ridges", "eaves")


def _utm_sql() -> str:
    e, s = repr(projection.ECCENTRICITY), repr(projection.SCALE * projection.RADIUS)
    east = " + ".join(["eta", *[f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(projection.ALPHA, 1)]])
    north = " + ".join(["xi", *[f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(projection.ALPHA, 1)]])
    return f""", a AS (SELECT request_id, radians(lon - (6 * (floor((lon + 180) / 6) + 1) - 183)) AS lam, sin(radians(lat)) AS s FROM req),
b AS (SELECT request_id, lam, sinh(atanh(s) - {e} * atanh({e} * s)) AS t FROM a), c AS (SELECT request_id, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM b)
SELECT request_id, round(500000.0e0 + {s} * ({east}), 3) AS easting, round({s} * ({north}), 3) AS northing FROM c"""


@query(with_views("req") + _utm_sql())
def q35_utm_projection(spark, sf_dir):
    rows = roles.requests(spark, sf_dir).withColumn("p", projection.to_utm(F.col("lon"), F.col("lat")))
    return rows.select("request_id", r("p.x", 3).alias("easting"), r("p.y", 3).alias("northing"))


@query("""WITH b AS (SELECT c_custkey AS id, (c_custkey % 300) * 1.5e0 AS x0, (c_custkey % 170) * 2.0e0 AS y0 FROM customer), p AS (SELECT o_orderkey AS pid, (o_orderkey % 451) * 1.0e0 AS x, (o_custkey % 341) * 1.0e0 AS y FROM orders)
SELECT id, count(*) AS n, min(pid) AS first_pid FROM p JOIN b ON x BETWEEN x0 AND x0 + 12 AND y BETWEEN y0 AND y0 + 9 GROUP BY id""")
def q36_box_join(spark, sf_dir):
    k = F.col("c_custkey")
    boxes = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 300 * F.lit(1.5)).alias("x0"), (k % 170 * F.lit(2.0)).alias("y0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 12, "y1": F.col("y0") + 9})
    pts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), (F.col("o_orderkey") % 451 * F.lit(1.0)).alias("x"), (F.col("o_custkey") % 341 * F.lit(1.0)).alias("y"))
    return footprints.counts_in_boxes(pts, boxes, 16.0)


@query("""WITH o AS (SELECT o_custkey AS request_id, CAST(o_orderkey % 4 AS INTEGER) AS rank, CASE WHEN o_orderkey % 4 = 2 THEN 'COUNTY' ELSE 'MAP' END AS lineage, (60 + o_orderkey % 40) / 100.0e0 AS iou, (o_orderkey % 11) * 0.5e0 AS cg, (o_orderkey % 24) * 1.0e0 AS ag, o_orderkey AS k FROM orders),
f AS (SELECT request_id, rank, lineage, iou, cg, ag FROM (SELECT *, row_number() OVER (PARTITION BY request_id, rank ORDER BY k) AS n FROM o) t WHERE n = 1),
p AS (SELECT c_custkey AS request_id, CAST(c_custkey % 2 AS INTEGER) AS primary_rank FROM customer),
s AS (SELECT p.request_id, f.rank, CASE WHEN lineage = 'MAP' THEN iou >= 0.65e0 AND ag <= 20 ELSE iou >= 0.7e0 AND cg <= 4 AND ag <= 16 END AS good, lineage = 'MAP' AS same FROM p JOIN f ON p.request_id = f.request_id AND f.rank > p.primary_rank AND (p.primary_rank <> 0 OR f.rank IN (2, 3))),
d AS (SELECT *, CASE WHEN NOT good THEN 'FOOTPRINT_PROVIDER_CONFLICT' WHEN NOT same THEN 'CORROBORATED' END AS step FROM s),
a AS (SELECT request_id, min(rank) FILTER (WHERE step IS NOT NULL) AS at, bool_or(same AND good) AS support FROM d GROUP BY request_id)
SELECT p.request_id, p.primary_rank, coalesce(d.step, CASE WHEN a.support THEN 'CORRELATED_SUPPORT_ONLY' END, 'SINGLE_SOURCE') AS status FROM p LEFT JOIN a ON p.request_id = a.request_id LEFT JOIN d ON d.request_id = p.request_id AND d.rank = a.at""")
def q37_footprint_consensus(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), (k % 4).cast("int").alias("rank"), F.when(k % 4 == 2, "COUNTY").otherwise("MAP").alias("lineage"), ((k % 40 + 60) / F.lit(100.0)).alias("iou"), (k % 11 * F.lit(0.5)).alias("centroid_gap"), (k % 24 * F.lit(1.0)).alias("area_gap"), k.alias("k"))
    first = F.row_number().over(Window.partitionBy("request_id", "rank").orderBy("k"))
    rows = rows.withColumn("n", first).where("n = 1").drop("n", "k")
    primary = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 2).cast("int").alias("rank"), F.lit("MAP").alias("lineage"))
    return footprints.consensus(primary, rows)


from . import decisions  # noqa: E402, F401  registers its queries after those above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q34_cityjson_saltbox(spark, sf_dir)
