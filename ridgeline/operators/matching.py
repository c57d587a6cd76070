"""Spatial and key joins that attach outlines, tiles, counties and evidence to requests.

Every theta join is an equi-join on grid cells or keys with the exact test behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULTS, Thresholds
from ..functions import geometry as G
from ..functions import overlay
from ..functions.scalars import county_name
from .footprints import prepared, within_boxes
from .pricing import COUNTIES

BOX = ("x0", "y0", "x1", "y1")


def boxed(rows: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds the bounding box x0, y0, x1, y1 of a ring."""
    r = F.col(ring)
    return rows.withColumns({"x0": F.array_min(r["x"]), "y0": F.array_min(r["y"]), "x1": F.array_max(r["x"]), "y1": F.array_max(r["y"])})


def box_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Rows of left and right, each with a box x0, y0, x1, y1, whose boxes meet (touching counts).

    Boxes are put into every grid cell they meet; a pair is kept only in the cell that holds the lower left
    corner of what they share, so it comes once and nothing has to be made distinct. The result has left's
    columns and right's without its box. Boxes should be a few cells wide at most.
    """
    at = lambda v: F.floor(v / F.lit(float(cell))).cast("long")
    ours = left.withColumn("__cx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("__cy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))
    theirs = right.withColumnsRenamed({c: f"__{c}" for c in BOX})
    theirs = theirs.withColumn("__cx", F.explode(F.sequence(at(F.col("__x0")), at(F.col("__x1"))))).withColumn("__cy", F.explode(F.sequence(at(F.col("__y0")), at(F.col("__y1")))))
    meet = (F.col("x0") <= F.col("__x1")) & (F.col("__x0") <= F.col("x1")) & (F.col("y0") <= F.col("__y1")) & (F.col("__y0") <= F.col("y1"))
    once = (F.col("__cx") == at(F.greatest("x0", "__x0"))) & (F.col("__cy") == at(F.greatest("y0", "__y0")))
    return ours.join(theirs, ["__cx", "__cy"]).where(meet & once).drop("__cx", "__cy", *[f"__{c}" for c in BOX])


def footprint_candidates(requests: DataFrame, outlines: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """requests(request_id, px, py), outlines(candidate_id, ring), all in metres -> pairs for select_prepared.

    An outline is a candidate where its box meets the box a search radius around the point.
    """
    r = t.footprint_radius_m
    px, py = F.col("px"), F.col("py")
    search = requests.select("request_id", "px", "py", (px - r).alias("x0"), (py - r).alias("y0"), (px + r).alias("x1"), (py + r).alias("y1"))
    return box_pairs(search, boxed(prepared(outlines)), 2 * r).drop(*BOX)


def with_tile(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """requests(quadkey) with their tile's url, or a code; tiles(quadkey, url) has a row per key at most."""
    out = requests.join(tiles.select("quadkey", "url"), "quadkey", "left")
    return out.withColumn("code", F.when(F.col("url").isNull(), F.lit("MICROSOFT_FOOTPRINT_TILE_NOT_FOUND")))


def service_counties(counties: DataFrame) -> DataFrame:
    """counties(name, ring) -> those served, under their fixed names, with boxes."""
    return boxed(counties.select(county_name(F.col("name")).alias("county"), "ring").where(F.col("county").isin(*COUNTIES)))


def county_of_point(points: DataFrame, counties: DataFrame, cell: float = 0.25) -> DataFrame:
    """points(request_id, lon, lat) -> (request_id, county, code): the only served county that covers the point."""
    pairs = within_boxes(points.select("request_id", "lon", "lat"), service_counties(counties), cell, "lon", "lat")
    found = pairs.where(G.covers(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("request_id")
    found = found.agg(F.min("county").alias("county"), F.count(F.lit(1)).alias("n"))
    out = points.select("request_id").join(found, "request_id", "left")
    sure = F.coalesce(F.col("n") == 1, F.lit(False))
    return out.select("request_id", F.when(sure, F.col("county")).alias("county"), F.when(~sure, F.lit("OUTSIDE_SERVICE_AREA")).alias("code"))


def county_of_outline(outlines: DataFrame, counties: DataFrame, cell: float, t: Thresholds = DEFAULTS) -> DataFrame:
    """outlines(request_id, ring) -> (request_id, county, ratio, code): the county that covers most of the outline.

    Of equal ratios the last name counts; a ratio under the least coverage gives a code. Both tables in one
    plane (metres, or degrees where the difference over a building does not matter).
    """
    pairs = box_pairs(boxed(outlines.select("request_id", F.col("ring").alias("own")), "own"), service_counties(counties), cell)
    pairs = pairs.withColumn("ratio", overlay.coverage_ratio("ring", "own", G.ring_area(F.col("own"))))
    best = pairs.where("ratio > 0").groupBy("request_id").agg(F.max(F.struct("ratio", "county")).alias("best"))
    out = outlines.select("request_id").join(best, "request_id", "left").select("request_id", "best.county", "best.ratio")
    sure = F.coalesce(F.col("ratio") >= t.min_coverage, F.lit(False))
    return out.select("request_id", F.when(sure, F.col("county")).alias("county"), "ratio", F.when(~sure, F.lit("OUTSIDE_SERVICE_AREA")).alias("code"))


def catalogue_matches(sources: DataFrame, catalogue: DataFrame, allowed: str, few: int = 10_000) -> DataFrame:
    """sources(source_id, patterns array) x catalogue(name, url): entries whose name matches one of the patterns.

    Patterns have no common key, so this stays a nested loop over a source registry, which is broadcast up to
    ``few`` patterns (counted). Beyond that the registry is dealt to the catalogue's partitions by Spark
    itself. An entry that several patterns of a source match comes once.
    """
    each = sources.select("source_id", F.explode(F.array_distinct("patterns")).alias("pattern"))
    small = each.limit(few + 1).count() <= few
    good = catalogue.where(F.col("url").rlike(f"^(?:{allowed})$"))
    pairs = good.join(F.broadcast(each) if small else each, F.regexp_like(F.col("name"), F.col("pattern")))
    return pairs.drop("pattern").distinct()


def with_evidence(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows(footprint_id) with the evidence record of their footprint (null: none, with a code)."""
    out = rows.join(records.select("footprint_id", "record"), "footprint_id", "left")
    return out.withColumn("evidence_code", F.when(F.col("record").isNull(), F.lit("CURRENT_IMAGERY_PROPERTY_NOT_VALIDATED")))


def ground_area(facets: Column) -> Column:
    """Ground area of facets(ground_area, area, pitch): the stated one, else the area's projection; 0 for none."""
    each = F.transform(facets, lambda f: F.coalesce(f["ground_area"], F.coalesce(f["area"], F.lit(0.0)) * F.cos(F.radians(F.coalesce(f["pitch"], F.lit(0.0))))))
    return F.coalesce(G.total(each), F.lit(0.0))


def provenance(provider: Column, *licenses: Column) -> Column:
    """struct(component, license): the point cloud's component by its provider, and all licenses joined."""
    noaa = F.coalesce(F.upper(provider).contains("NOAA"), F.lit(False))
    own = F.when(noaa, F.lit("NOAA-PUBLIC-DATASET")).otherwise(F.lit("USGS-PUBLIC-DOMAIN"))
    return F.struct(F.when(noaa, F.lit("NOAA/DigitalCoast")).otherwise(F.lit("USGS/3DEP")).alias("component"), F.concat_ws(" + ", own, *licenses).alias("license"))
