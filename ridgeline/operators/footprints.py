"""Building outlines: selection among candidates, and consensus of providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULTS, Thresholds
from ..functions import geometry as G
from ..functions.scalars import percent_change


def usable(candidates: DataFrame, ring: str = "ring", position: str = "candidate_id") -> DataFrame:
    """Valid, non-empty outlines, equal ones of a request once (drawn from another vertex or way round too): the first by position."""
    good = candidates.where(G.simple_ring(F.col(ring))).withColumn("__same", G.normal_ring(F.col(ring)))
    first = F.row_number().over(Window.partitionBy("request_id", "__same").orderBy(position))
    return good.withColumn("__n", first).where("__n = 1").drop("__same", "__n")


def nearest_two(candidates: DataFrame, request: str, distance: str, area: str, position: str) -> DataFrame:
    """The first candidate by (distance, area) with the second's distance beside it."""
    order = Window.partitionBy(request).orderBy(distance, area, position)
    rows = candidates.withColumns({"place": F.row_number().over(order), "second_distance": F.lead(distance).over(order)})
    return rows.where("place = 1").drop("place")


def ambiguity(first: Column, second: Column, inside: Column, covered_by_second: Column, t: Thresholds = DEFAULTS) -> Column:
    """Code for the nearest outline: none near enough, or a rival as near, unless the point is in the first alone."""
    rival = (second <= t.footprint_max_distance_m) & (F.abs(second - first) <= t.footprint_ambiguity_m) & ~(inside & ~covered_by_second)
    return F.when(first.isNull() | (first > t.footprint_max_distance_m), F.lit("BUILDING_FOOTPRINT_NOT_FOUND")).when(F.coalesce(rival, F.lit(False)), F.lit("BUILDING_FOOTPRINT_AMBIGUOUS"))


def prepared(outlines: DataFrame) -> DataFrame:
    """outlines(candidate_id, ring) -> the valid ones, equal ones once (the least id), with their area.

    Validity and equality do not depend on the request, so they are settled here, before outlines meet requests;
    rings that are drawn alike become one before they are looked at.
    """
    drawn = outlines.groupBy("ring").agg(F.min("candidate_id").alias("candidate_id"), F.count(F.lit(1)).alias("__n"))
    simple = F.when(F.col("__n") > 0, G.simple_ring(F.col("ring")))  # named with the count, else Spark asks it of every row first
    good = drawn.where(simple).withColumn("__same", G.normal_ring(F.col("ring")))
    return good.groupBy("__same").agg(F.min_by(F.struct("candidate_id", "ring"), "candidate_id").alias("o")).select("o.*").withColumn("area", G.ring_area(F.col("ring")))


def select_footprint(candidates: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """candidates(request_id, candidate_id, px, py, ring; metres) -> the chosen one per request, and its code."""
    return select_prepared(usable(candidates).withColumn("area", G.ring_area(F.col("ring"))), t)


def select_prepared(candidates: DataFrame, t: Thresholds = DEFAULTS, tolerance: float = 1e-9) -> DataFrame:
    """As select_footprint, for candidates of prepared() outlines: each ring is walked twice a pair, and only the
    two nearest of a request are shuffled."""
    px, py, ring = F.col("px"), F.col("py"), F.col("ring")
    rows = candidates.withColumns({"edge": G.boundary_distance(px, py, ring), "within": G.inside_even_odd(px, py, ring)})
    on = F.col("edge") <= tolerance
    rows = rows.withColumns({"distance": F.when(F.col("within") | on, F.lit(0.0)).otherwise(F.col("edge")), "inside": F.col("within") & ~on, "covered": F.col("within") | on})
    order = Window.partitionBy("request_id").orderBy("distance", "area", "candidate_id")
    rows = rows.withColumn("place", F.row_number().over(order)).where("place <= 2")
    rows = rows.withColumns({"second": F.lead("distance").over(order), "second_covers": F.lead("covered").over(order)})
    code = ambiguity(F.col("distance"), F.col("second"), F.col("inside"), F.coalesce("second_covers", F.lit(False)), t)
    return rows.where("place = 1").select("request_id", "candidate_id", "ring", "distance", code.alias("code"))


def agreement(iou: Column, centroid_gap: Column, area_gap: Column, same_lineage: Column, t: Thresholds = DEFAULTS) -> Column:
    """Whether a corroborating outline agrees; outlines of one lineage need less and support less."""
    related = (iou >= t.correlated_iou) & (area_gap <= t.review_area_percent)
    apart = (iou >= t.consensus_iou) & (centroid_gap <= t.consensus_centroid_m) & (area_gap <= t.consensus_area_percent)
    return F.when(same_lineage, related).otherwise(apart)


def consensus(primary: DataFrame, others: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """primary(request_id, rank, lineage), others(request_id, rank, lineage, iou, centroid_gap, area_gap) -> status.

    Others are asked in rank order, those after the primary, but only ranks 2 and 3 if it has rank 0. The
    first that disagrees is a conflict, the first of another lineage that agrees corroborates; what comes
    later does not count. The primary's geometry stays.
    """
    p = primary.select("request_id", F.col("rank").alias("primary_rank"), F.col("lineage").alias("primary_lineage"))
    rows = others.join(p, "request_id").where((F.col("rank") > F.col("primary_rank")) & ((F.col("primary_rank") != 0) | F.col("rank").isin(2, 3)))
    same = F.col("lineage") == F.col("primary_lineage")
    good = agreement(F.col("iou"), F.col("centroid_gap"), F.col("area_gap"), same, t)
    step = F.when(~good, "FOOTPRINT_PROVIDER_CONFLICT").when(~same, "CORROBORATED")
    found = rows.groupBy("request_id").agg(F.min_by(step, F.when(step.isNotNull(), F.col("rank"))).alias("decided"), F.bool_or(same & good).alias("support"))
    out = p.join(found, "request_id", "left")
    status = F.coalesce("decided", F.when(F.col("support"), "CORRELATED_SUPPORT_ONLY"), F.lit("SINGLE_SOURCE"))
    return out.select("request_id", "primary_rank", status.alias("status"))


def compare(a: Column, b: Column, intersection: Column) -> Column:
    """struct(iou, centroid_gap, area_gap, hausdorff) of two rings whose intersection area is known."""
    area_a, area_b = G.ring_area(a), G.ring_area(b)
    union = F.greatest(area_a + area_b - intersection, F.lit(1e-12))
    return G.named(iou=intersection / union, centroid_gap=G.length_plan(G.centroid(a), G.centroid(b)), area_gap=F.abs(area_a - area_b) / F.greatest(area_a, area_b) * 100, hausdorff=G.hausdorff(a, b))


def mask_gates(quality: Column, simplified_area: Column, area: Column, ground_area: Column, iou: Column, centroid_gap: Column, area_gap: Column, t: Thresholds = DEFAULTS) -> Column:
    """First code against a roof outline taken from a raster mask."""
    return (
        F.when(F.upper(quality) != "HIGH", "SOLAR_ROOF_MASK_QUALITY_INSUFFICIENT")
        .when(percent_change(simplified_area, area) > 2, "SOLAR_ROOF_MASK_SIMPLIFICATION_CONFLICT")
        .when(ground_area <= 0, "SOLAR_GROUND_AREA_MISSING")
        .when(percent_change(simplified_area, ground_area) > t.mask_area_percent, "SOLAR_ROOF_MASK_AREA_CONFLICT")
        .when((iou < t.correlated_iou) | (centroid_gap > t.consensus_centroid_m) | (area_gap > t.review_area_percent), "SOLAR_ROOF_MASK_BUILDING_CONFLICT")
    )


def within_boxes(points: DataFrame, boxes: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """points join boxes(x0, y0, x1, y1) by grid cell, then exactly: an equi-join instead of a nested loop.

    A box goes to every cell it meets, a point to its one cell, so no pair comes twice.
    """
    at = lambda v: F.floor(v / F.lit(cell)).cast("long")
    spread = boxes.withColumn("__cx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("__cy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))
    placed = points.withColumns({"__cx": at(F.col(x)), "__cy": at(F.col(y))})
    inside = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return placed.join(spread, ["__cx", "__cy"]).where(inside).drop("__cx", "__cy")


def counts_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """points(pid, x, y), boxes(id, x0, y0, x1, y1) -> (id, n, first_pid): how many points each id's boxes hold, and the least.

    Ids without points are left out. Points of one place count as one row with their number, and equal boxes are
    searched once, so that copies are not expanded into pairs.
    """
    box = ["x0", "y0", "x1", "y1"]
    places = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first_pid"))
    held = within_boxes(places, boxes.select(*box).distinct(), cell).groupBy(*box).agg(F.sum("n").alias("n"), F.min("first_pid").alias("first_pid"))
    return boxes.join(held, box).groupBy("id").agg(F.sum("n").alias("n"), F.min("first_pid").alias("first_pid"))
