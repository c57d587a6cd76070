"""The whole measurement of a batch of requests: outlines, sources, roofs, checks, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULTS, Thresholds
from ..functions.scalars import first_code, year_age
from ..operators import cascade, decision, evidence, footprints, lidar, matching, points, roof


def outlines(requests: DataFrame, candidates: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Requests with the service-area gate and their chosen outline."""
    return gated(requests, footprints.select_footprint(candidates, t), t)


def gated(requests: DataFrame, chosen: DataFrame, t: Thresholds = DEFAULTS, on: str | list[str] = "request_id") -> DataFrame:
    rows = requests.withColumn("area_code", decision.service_area(F.col("lon"), F.col("lat"), t))
    joined = rows.join(chosen.withColumnRenamed("code", "footprint_code"), on, "left")
    missing = F.when(F.col("candidate_id").isNull(), F.lit("BUILDING_FOOTPRINT_NOT_FOUND"))
    return joined.withColumn("code", F.coalesce("area_code", "footprint_code", missing))


def located(requests: DataFrame, outlines_m: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """requests(request_id, lon, lat, px, py) and all outlines(candidate_id, ring; metres) -> as outlines().

    The choice depends on the place alone, so each place is searched once, and its requests join the one chosen.
    """
    place = F.struct("px", "py")
    places = requests.where("px IS NOT NULL AND py IS NOT NULL").select("px", "py").distinct().withColumn("request_id", place)
    chosen = footprints.select_prepared(matching.footprint_candidates(places, outlines_m, t), t)
    chosen = chosen.select(F.col("request_id.px").alias("px"), F.col("request_id.py").alias("py"), "candidate_id", "ring", "distance", "code")
    return gated(requests, chosen, t, ["px", "py"])


def waves(requests: DataFrame, sources: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Ranked source candidates of each request that is still open."""
    return lidar.candidates(requests.where("code IS NULL"), sources)


def selections(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, candidates, first_source, code): how many sources pass, the first of them, and why none does.

    A refusal may pass with time where a source of the county could not be asked (coverage null). A source of another
    county is neither a candidate nor a reason, so the registry is summed up by county, and requests join a row each;
    a request with several counties gets the sum of theirs. As in the audit, without any source there is no row.
    """
    judged = lidar.decision(F.col("enabled"), F.lit(True), F.col("license"), F.col("acquired_end"), F.col("coverage"))
    rows = sources.withColumn("decision", judged).where("county IS NOT NULL")
    good = F.col("decision") == "CANDIDATE"
    order = F.struct("acquired_end", "coverage", "density", "priority", -F.col("source_id"), "source_id")
    by_county = rows.groupBy("county").agg(F.count_if(good).alias("n"), F.max(F.when(good, order)).alias("best"), F.bool_or(F.col("decision") == "SOURCE_UNAVAILABLE").alias("away"))
    asked = requests.select("request_id", "county").crossJoin(F.broadcast(sources.limit(1).select(F.lit(1).alias("__any")))).drop("__any")
    found = asked.join(by_county, "county", "left").groupBy("request_id")
    found = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.max("best")["source_id"].alias("first_source"), F.coalesce(F.bool_or("away"), F.lit(False)).alias("retry"))
    return found.select("request_id", "candidates", "first_source", lidar.selection_code(F.col("candidates") > 0, F.col("retry")).alias("code"))


def evaluate(attempts: DataFrame, as_of: Column, t: Thresholds = DEFAULTS) -> DataFrame:
    """A row per request and ranked source, with all that was measured there -> its codes, confidence and evidence.

    Needs: provider_code (null: none), total and roof (crop counts), tile_date, acquired_end, density,
    minimum_density, roof_code, external_plan_perimeter_feet, outline_feet, plane_codes (array), area, pitch,
    reference_area, reference_pitch, flat_area, flat, family, failures (of the evidence; null: no source), quality
    and distance. final_code is the first gate that fails, in the order of the work. Evidence that fails rejects
    nothing: it takes the temporal credit away and blocks pricing. The age is that of the exact date, if there is one.
    """
    rows = attempts.withColumn("lidar_age", year_age(F.coalesce("tile_date", "acquired_end"), as_of))
    rows = roof.perimeter_gate(rows, "outline_feet", t)
    rows = decision.reconcile(rows, t)
    rows = rows.withColumn("evidence", evidence.decided(F.col("tile_date"), F.col("failures"), F.col("lidar_age"), t))
    rows = rows.withColumn("validated", F.col("evidence.verification") != "INSPECTION_REQUIRED")
    rows = decision.decide(rows, t)
    sparse = first_code((F.col("density") < F.greatest(F.lit(t.min_density), "minimum_density"), "LIDAR_DENSITY_TOO_LOW"))
    type_code = decision.roof_type_code(F.col("flat_area"), F.col("area"), F.col("flat"), F.col("family"))
    final = F.coalesce(
        "provider_code", points.crop_code(F.col("total"), F.col("roof")), points.date_floor(F.col("tile_date"), t), sparse,
        "roof_code", "perimeter_code", F.get("plane_codes", F.lit(0)), "reconciliation_code", type_code, "confidence_code",
    )
    return rows.withColumn("final_code", final)


def measure_roofs(lines: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return roof.measure(lines, t)


def winners(attempts: DataFrame) -> DataFrame:
    """attempts(request_id, rank, source_id, final_code) -> (request_id, winner, code, log).

    winner is the first rank without a code; log (array of rank, source_id, decision, error_code, retryable) ends
    with it, as later sources are not tried. Without one the log has all, and the code tells whether a failure may
    pass, whether no crop had roof returns, or that nothing was reliable. A request has as many rows as it has
    sources, a few dozen at most.
    """
    code = F.col("final_code")
    entry = F.struct(
        "rank", "source_id", F.when(code.isNull(), F.lit("SELECTED_VALID_CROP")).otherwise(F.lit("REJECTED_PROPERTY_CROP")).alias("decision"),
        code.alias("error_code"), F.coalesce(code.isin(*decision.TRANSIENT), F.lit(False)).alias("retryable"),
    )
    tried = attempts.groupBy("request_id").agg(F.min(F.when(code.isNull(), F.col("rank"))).alias("winner"), F.array_sort(F.collect_list(entry)).alias("log"))
    tried = tried.withColumn("log", F.filter("log", lambda x: F.col("winner").isNull() | (x["rank"] <= F.col("winner"))))
    codes = F.transform("log", lambda x: x["error_code"])
    none = (
        F.when(F.exists("log", lambda x: x["retryable"]), F.lit("LIDAR_CANDIDATES_TEMPORARILY_UNAVAILABLE"))
        .when(cascade.all_failures_in(codes, ["NO_USABLE_ROOF_RETURNS", "LIDAR_CROP_EMPTY"]), F.lit("NO_USABLE_ROOF_RETURNS"))
        .otherwise(F.lit("NO_RELIABLE_LIDAR_GEOMETRY"))
    )
    return tried.select("request_id", "winner", F.when(F.col("winner").isNull(), none).alias("code"), "log")


#: The fields of a result that diagnostics may show; no vertices, no credentials.
SHOWN = ("roof_area_sqft", "average_pitch", "maximum_pitch", "rakes", "eaves", "valleys", "ridges", "hips", "highPerimeters", "flat_area_sqft", "external_perimeter_feet", "internal_edge_feet")


def diagnostics(rows: DataFrame, most: int = 20) -> DataFrame:
    """rows with the SHOWN fields, facets and source_records -> (request_id, geometry struct, source_records of at most 20)."""
    return rows.select("request_id", F.struct(*SHOWN, F.col("facets").alias("facet_count")).alias("geometry"), F.slice("source_records", 1, most).alias("source_records"))
