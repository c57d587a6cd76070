"""Reconciliation with reference measures, and the final decision on a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULTS, Thresholds
from ..functions.scalars import combined_confidence, first_code, reconciliation


def reconcile(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """rows(area, pitch, reference_area > 0, reference_pitch) -> variances, code and score."""
    area = F.abs(F.col("area") - F.col("reference_area")) / F.col("reference_area") * 100
    pitch = F.abs(F.col("pitch") - F.col("reference_pitch"))
    code = first_code((area > t.max_solar_area_percent, "SOLAR_AREA_RECONCILIATION_FAILED"), (pitch > t.max_solar_pitch_degrees, "SOLAR_PITCH_RECONCILIATION_FAILED"))
    return rows.withColumns({"area_variance": area, "pitch_variance": pitch, "reconciliation_code": code, "reconciliation": reconciliation(area, pitch, t)})


def roof_type_code(flat_area: Column, area: Column, flat: Column, family: Column) -> Column:
    share = flat_area / F.greatest(area, F.lit(0.01))
    return first_code((flat & (share < 0.5), "SELECTED_FLAT_ROOF_MISMATCH"), ((family == "STEEP_SLOPE") & (share > 0.5), "SELECTED_STEEP_ROOF_MISMATCH"))


def decide(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """rows(quality, distance, lidar_age, reconciliation, validated) -> confidence and code."""
    score = combined_confidence(F.col("quality"), F.col("distance"), F.col("lidar_age"), F.col("reconciliation"), F.col("validated"), t)
    return rows.withColumns({"confidence": F.round(score, 3), "confidence_code": F.when(F.round(score, 3) < t.min_confidence, F.lit("GEOMETRY_CONFIDENCE_TOO_LOW"))})


def service_area(longitude: Column, latitude: Column, t: Thresholds = DEFAULTS) -> Column:
    inside = longitude.between(t.min_longitude, t.max_longitude) & latitude.between(t.min_latitude, t.max_latitude)
    return F.when(~F.coalesce(inside, F.lit(False)), F.lit("OUTSIDE_SERVICE_AREA"))


#: The outputs that every request has to ask for.
OUTPUTS = ("roofAreaSqFt", "averagePitchDegrees", "maximumPitchDegrees", "facets", "rakesFeet", "eavesFeet", "valleysFeet", "ridgesFeet", "hipsFeet", "flatRoofAreaSqFt")


#: The request's fields as they arrive; unknown ones at the top are a problem, inside the roof type they may stand.
REQUEST = (
    "struct<schemaVersion string, requestId string, location struct<latitude double, longitude double>,"
    " selectedRoofType struct<name string, family string, material string, flat boolean>,"
    " solarReference struct<roofAreaSqFt double, averagePitchDegrees double, maximumPitchDegrees double, imageryDate string, imageryQuality string,"
    " facets array<struct<planeId string, areaSqFt double, groundAreaSqFt double, pitchDegrees double, azimuthDegrees double>>>,"
    " requiredOutputs array<string>>"
)
FIELDS = ("schemaVersion", "requestId", "location", "selectedRoofType", "solarReference", "requiredOutputs")


def parse_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds request (struct) and problems (codes in order of the fields) to lines of request JSON.

    Text that is no object has the one problem JSON; a field that does not parse is null and so breaks its rule.
    """
    rows = lines.withColumn("request", F.from_json(value, REQUEST))
    f = lambda name: F.col(f"request.{name}")
    solar, kind = "solarReference", "selectedRoofType"
    holds = lambda condition: ~F.coalesce(condition, F.lit(False))
    text = lambda name, most: holds(F.length(f(name)).between(1, most))
    angle = lambda c, most=90: c.between(0, most)
    facet_bad = lambda x: ~F.coalesce((x["areaSqFt"] >= 0) & angle(x["pitchDegrees"]), F.lit(False)) | F.coalesce(x["groundAreaSqFt"] < 0, F.lit(False)) | F.coalesce(~angle(x["azimuthDegrees"], 360), F.lit(False))
    day = f(solar + ".imageryDate")
    rules = [
        (F.size(F.array_except(F.json_object_keys(value), F.array(*map(F.lit, FIELDS)))) > 0, "UNKNOWN_FIELD"),
        (holds(f("schemaVersion") == "1.0"), "SCHEMA_VERSION"),
        (holds(f("requestId").rlike(REQUEST_ID)), "REQUEST_ID"),
        (holds(f("location.latitude").between(-90, 90)), "LATITUDE"),
        (holds(f("location.longitude").between(-180, 180)), "LONGITUDE"),
        (text(kind + ".name", 80) | text(kind + ".family", 40) | text(kind + ".material", 80) | f(kind + ".flat").isNull(), "ROOF_TYPE"),
        (holds(f(solar + ".roofAreaSqFt") > 0), "REFERENCE_AREA"),
        (holds(angle(f(solar + ".averagePitchDegrees")) & angle(f(solar + ".maximumPitchDegrees"))), "REFERENCE_PITCH"),
        (F.coalesce((day != "") & ~day.rlike(r"^20\d{2}-\d{2}-\d{2}$"), F.lit(False)), "IMAGERY_DATE"),
        (F.coalesce(F.length(f(solar + ".imageryQuality")) > 20, F.lit(False)), "IMAGERY_QUALITY"),
        (holds(F.size(f(solar + ".facets")).between(1, 200)), "REFERENCE_FACETS"),
        (F.coalesce(F.exists(f(solar + ".facets"), facet_bad), F.lit(False)), "REFERENCE_FACET"),
        (holds(F.size(f("requiredOutputs")).between(1, 30)) | missing_outputs(f("requiredOutputs")), "REQUIRED_OUTPUTS"),
    ]
    found = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))
    return rows.withColumn("problems", F.when(F.json_object_keys(value).isNull(), F.array(F.lit("JSON"))).otherwise(found))


REQUEST_ID = "^[A-Za-z0-9_-]{6,100}$"


def missing_outputs(outputs: Column) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, OUTPUTS)), F.coalesce(outputs, F.array().cast("array<string>")))) > 0


def request_problems(rows: DataFrame) -> DataFrame:
    """requests(request_id, schema_version, longitude, latitude, outputs, reference_area, reference_facets) + problems."""
    rules = [
        (~F.coalesce(F.col("schema_version") == "1.0", F.lit(False)), "SCHEMA_VERSION"),
        (~F.coalesce(F.col("request_id").rlike(REQUEST_ID), F.lit(False)), "REQUEST_ID"),
        (~F.coalesce(F.col("longitude").between(-180, 180), F.lit(False)), "LONGITUDE"),
        (~F.coalesce(F.col("latitude").between(-90, 90), F.lit(False)), "LATITUDE"),
        (missing_outputs(F.col("outputs")), "REQUIRED_OUTPUTS"),
        (~F.coalesce(F.col("reference_area") > 0, F.lit(False)), "REFERENCE_AREA"),
        (~F.coalesce(F.col("reference_facets").between(1, 200), F.lit(False)), "REFERENCE_FACETS"),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules])))


#: Codes of failures that may pass, of missing coverage, and of wrong settings. All others reject the geometry.
TRANSIENT = (
    "COUNTY_FOOTPRINT_UNAVAILABLE", "EPT_CRS_MISSING", "EPT_METADATA_INVALID", "GEOMETRY_COMMAND_TIMEOUT", "LIDAR_CANDIDATES_TEMPORARILY_UNAVAILABLE", "LIDAR_SOURCES_TEMPORARILY_UNAVAILABLE",
    "MICROSOFT_FOOTPRINT_CATALOG_INVALID", "MICROSOFT_FOOTPRINT_TILE_INVALID", "OPEN_DATA_COMMAND_TIMEOUT", "OSM_OVERPASS_UNAVAILABLE", "OVERTURE_CATALOG_INVALID", "OVERTURE_CATALOG_UNAVAILABLE",
    "OVERTURE_RESPONSE_INVALID", "PROVIDER_HTTP_ERROR", "PROVIDER_JSON_INVALID", "PROVIDER_NETWORK_ERROR", "PROVIDER_RESPONSE_TOO_LARGE", "SOLAR_ROOF_MASK_HTTP_ERROR", "SOLAR_ROOF_MASK_UNAVAILABLE",
)
MISSING = (
    "BUILDING_FOOTPRINT_NOT_FOUND", "MICROSOFT_FOOTPRINT_DISABLED", "MICROSOFT_FOOTPRINT_TILE_NOT_FOUND", "NO_LIDAR_COVERAGE", "OSM_FOOTPRINT_DISABLED", "OUTSIDE_SERVICE_AREA",
    "PROVIDER_RESOURCE_NOT_FOUND", "SOLAR_ROOF_MASK_NOT_FOUND",
)
SETTINGS = (
    "AUTH_TOKEN_MISSING", "CONCURRENCY_INVALID", "CONFIDENCE_THRESHOLD_INVALID", "CONFIG_DATE_INVALID", "CONFIG_NUMBER_INVALID", "COUNTY_BOUNDARIES_INVALID", "CURRENT_IMAGERY_AGE_INVALID",
    "FOOTPRINT_COMPARISON_INVALID", "FOOTPRINT_CONSENSUS_INVALID", "FOOTPRINT_CORRELATION_INVALID", "FOOTPRINT_PROVIDER_URL_INVALID", "LIDAR_MINIMUM_DATE_INVALID", "MICROSOFT_BFP_CONFIG_INVALID",
    "MICROSOFT_BFP_RELEASE_INVALID", "OSM_CACHE_INVALID", "OVERTURE_RELEASE_INVALID", "REGISTRY_ACCESS_INVALID", "REGISTRY_CLASS_INVALID", "REGISTRY_COUNTY_INVALID", "REGISTRY_DATE_INVALID",
    "REGISTRY_DENSITY_INVALID", "REGISTRY_ENDPOINT_INVALID", "REGISTRY_ENDPOINT_MISSING", "REGISTRY_FIELD_INVALID", "REGISTRY_INVALID", "REGISTRY_MISSING", "REGISTRY_PATTERN_INVALID",
    "REGISTRY_PATTERN_MISSING", "REGISTRY_PROVIDER_NOT_ALLOWED", "REGISTRY_SCHEMA_UNSUPPORTED", "REGISTRY_SOURCE_ID_INVALID", "REGISTRY_SOURCE_INVALID", "ROOFER_COMPLEXITY_FACTOR_INVALID",
    "ROOFER_PLANE_EPSILON_INVALID", "ROOFPRINT_PERIMETER_THRESHOLD_INVALID", "ROOF_CLUSTER_CONFIG_INVALID", "ROOF_HAG_RANGE_INVALID", "SERVICE_BOUNDS_INVALID", "SOLAR_API_KEY_MISSING",
    "SOLAR_ROOFPRINT_CONFIG_INVALID", "SOURCE_COMMIT_INVALID", "USGS_CATALOG_INVALID",
)
UNEXPECTED = "INTERNAL_GEOMETRY_ERROR"


def envelope(rows: DataFrame) -> DataFrame:
    """rows with a code (null: measured) + the error envelope.

    available, verification_status, pricing_allowed (false and INSPECTION_REQUIRED for every error, else what the
    row says itself, null here), status and error_code (the code), retryable, http_status: 503 for failures that
    may pass (retryable) and for wrong settings (not), 404 for missing coverage, 500 for unexpected errors, 422 for
    all other codes, 200 without one.
    """
    code, failed = F.col("code"), F.col("code").isNotNull()
    transient = F.coalesce(code.isin(*TRANSIENT), F.lit(False))
    status = F.when(~failed, 200).when(transient | code.isin(*SETTINGS), 503).when(code.isin(*MISSING), 404).when(code == UNEXPECTED, 500).otherwise(422)
    return rows.withColumns({
        "available": ~failed, "verification_status": F.when(failed, F.lit("INSPECTION_REQUIRED")), "pricing_allowed": F.when(failed, F.lit(False)),
        "status": code, "error_code": code, "retryable": transient, "http_status": status,
    })
