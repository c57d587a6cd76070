"""Batch comparison of meshes with reference reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent_error, pitch_class, plain_number

NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
#: Labels of lengths in a report's text, and attribute names of its JSON form.
LENGTHS = {"ridges": ("Ridges", "TotalRidgesLength"), "hips": ("Hips", "TotalHipsLength"), "valleys": ("Valleys", "TotalValleysLength"), "rakes": ("Rakes", "TotalRakesLength"), "eaves": (r"Eaves(?:/Starter)?", "TotalEavesLength"), "flashing": ("Flashing", "TotalFlashingLength"), "step_flashing": (r"Step\s+flashing", "TotalStepFlashingLength")}


def extracted(text: Column, pattern: str) -> Column:
    """First group of the first match, any case; null without a match."""
    return F.nullif(F.regexp_extract(text, "(?im)" + pattern, 1), F.lit(""))


def report_from_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of a report's text, and a code if id, area, facet count or pitch is missing."""
    t = F.col(text)
    out = rows.withColumns({
        "report_id": extracted(t, r"Report:\s*(\d{6,12})"),
        "area": plain_number(extracted(t, rf"Total Roof Area\s*=\s*{NUMBER}\s*sq\s*ft")),
        "facets": extracted(t, r"Total Roof Facets\s*=\s*(\d+)").cast("int"),
        "rise": plain_number(extracted(t, rf"Predominant Pitch\s*=\s*{NUMBER}\s*/\s*12")),
        **{k: plain_number(extracted(t, rf"^\s*{label}\s*=\s*{NUMBER}\s*ft")) for k, (label, _) in LENGTHS.items()},
    })
    missing = F.col("report_id").isNull() | F.col("area").isNull() | F.col("facets").isNull() | F.col("rise").isNull()
    return out.withColumn("code", F.when(missing, "REPORT_INCOMPLETE"))


def report_from_json(rows: DataFrame, text: str = "value") -> DataFrame:
    """The same measures from a report's JSON export; of repeated attribute names the last counts."""
    schema = "struct<EAGLEVIEW_EXPORT: struct<REPORT: struct<`@reportId`: string>, OVERALL_SUMMARY: struct<ATTRIBUTE: array<struct<`@name`: string, `@value`: string>>>>>"
    root = F.from_json(text, schema)["EAGLEVIEW_EXPORT"]
    items = root["OVERALL_SUMMARY"]["ATTRIBUTE"]
    of = lambda name: F.nullif(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(items, lambda i: i["@name"] == name), lambda i: i["@value"])), -1), F.lit(""))
    out = rows.withColumns({
        "report_id": root["REPORT"]["@reportId"],
        "area": plain_number(of("TotalRoofArea")),
        "facets": of("TotalRoofFacets").try_cast("int"),
        "rise": plain_number(extracted(of("PredominantPitch"), rf"^{NUMBER}\s*/\s*12$")),
        **{k: plain_number(of(name)) for k, (_, name) in LENGTHS.items()},
    })
    missing = F.col("report_id").isNull() | F.col("area").isNull() | F.col("facets").isNull() | F.col("rise").isNull()
    return out.withColumn("code", F.when(missing, "REPORT_INCOMPLETE"))


def mesh_triangles(lines: DataFrame, key: str) -> DataFrame:
    """lines(key, line_no, value) of a mesh -> triangles (key, object, line_no, fan, area, plan_area, pitch, error).

    The current object is the last one named above; faces of more corners are fans. Flat triangles drop.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    v = F.split(F.trim("value"), r"\s+")
    rows = lines.select(key, "line_no", v.alias("v"), F.trim("value").alias("s"))
    rows = rows.withColumns({
        "object": F.last(F.when(F.col("v")[0] == "o", F.trim(F.substring("s", 3, 10_000))), True).over(order),
        "n": F.sum(F.when((F.col("v")[0] == "v") & (F.size("v") >= 4), 1).otherwise(0)).over(order),
    })
    points = rows.where((F.col("v")[0] == "v") & (F.size("v") >= 4)).select(key, F.col("n").alias("id"), *[F.col("v")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    faces = rows.where((F.col("v")[0] == "f") & (F.size("v") >= 4) & F.col("object").startswith("Roof.") & ~F.col("object").endswith(".Label"))
    corner = F.transform(F.slice("v", 2, 100_000), lambda p: F.split(p, "/")[0].cast("int"))
    fans = faces.select(key, "object", "line_no", corner.alias("c")).select(key, "object", "line_no", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("fan"))
    ids = fans.select(key, "object", "line_no", "fan", F.col("c")[0].alias("i0"), F.get("c", F.col("fan")).alias("i1"), F.get("c", F.col("fan") + 1).alias("i2"))
    for i in range(3):
        ids = ids.join(points.select(key, F.col("id").alias(f"i{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]), [key, f"i{i}"])
    a, b = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    cx, cy, cz = a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
    tri = ids.select(key, "object", "line_no", "fan", cx.alias("cx"), cy.alias("cy"), cz.alias("cz"))
    return measured(tri.withColumn("twice", F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2 + F.col("cz") ** 2)).where("twice > 1e-9"))


def measured(tri: DataFrame) -> DataFrame:
    """Adds area, plan_area, pitch and formula error (percent) to rows with a cross product cx, cy, cz and its length."""
    area, plan = F.col("twice") / 2, F.abs(F.col("cz")) / 2
    pitch = F.degrees(F.atan2(F.hypot("cx", "cy"), F.abs(F.col("cz"))))
    cosine = F.cos(F.radians(pitch))
    error = F.when(cosine > 1e-12, F.abs(plan / cosine - area) / area * 100).otherwise(float("inf"))
    return tri.withColumns({"area": area, "plan_area": plan, "pitch": pitch, "error": error}).drop("cx", "cy", "cz", "twice")


def dominant_class(objects: DataFrame, key: str, order: str) -> DataFrame:
    """objects(key, object, area, pitch, order) -> (key, rise_class, class_area): the class with most area.

    Of classes with equal area, the one met first.
    """
    rise = pitch_class(F.tan(F.radians("pitch")) * 12)
    classes = objects.groupBy(key, rise.alias("rise_class")).agg(F.sum("area").alias("class_area"), F.min(order).alias("met"))
    best = F.max_by(F.struct("rise_class", "class_area"), F.struct("class_area", -F.col("met"))).alias("m")
    return classes.groupBy(key).agg(best).select(key, "m.*")


def mesh_summary(triangles: DataFrame, key: str) -> DataFrame:
    """One row per mesh: areas, facets, area-weighted pitch, dominant class, greatest formula error, triangles."""
    weighted = F.sum(F.col("area") * F.col("pitch")) / F.sum("area")
    objects = triangles.groupBy(key, "object").agg(F.sum("area").alias("area"), weighted.alias("pitch"), F.min(F.col("line_no")).alias("met"))
    whole = triangles.groupBy(key).agg(F.sum("area").alias("area"), F.sum("plan_area").alias("plan_area"), F.count_distinct("object").alias("facets"), weighted.alias("pitch"), F.max("error").alias("max_error"), F.count(F.lit(1)).alias("triangles"))
    return whole.join(dominant_class(objects, key, "met"), key)


def compare(references: DataFrame, meshes: DataFrame, key: str = "report_id", max_area: float = 1.0, max_pitch: float = 1.0) -> DataFrame:
    """references(key, area, facets, rise), meshes(key, area, facets, rise_class, max_error) -> errors and status."""
    m = meshes.select(key, *[F.col(c).alias("mesh_" + c) for c in ("area", "facets", "rise_class", "max_error")])
    out = references.join(m, key, "left")
    degrees = lambda rise: F.degrees(F.atan(rise / 12))
    area_error = percent_error(F.col("mesh_area"), F.col("area"))
    pitch_error = F.abs(degrees(F.col("mesh_rise_class")) - degrees(F.col("rise")))
    good = (area_error <= max_area) & (pitch_error <= max_pitch) & (F.col("mesh_facets") == F.col("facets")) & (F.col("mesh_max_error") <= 1e-6)
    status = F.when(F.col("mesh_area").isNull(), "MISSING_OBJ").when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL")
    return out.withColumns({"area_error": area_error, "pitch_error": pitch_error, "status": status})


def preferred_reference(texts: DataFrame, exports: DataFrame, key: str = "report_id") -> DataFrame:
    """All ids of either table; measures of the export where there is one, else of the text."""
    columns = [c for c in texts.columns if c != key]
    a, b = exports.alias("a"), texts.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    has = F.col(f"a.{key}").isNotNull()
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.when(has, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns])


def summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.lit(1)).alias("reports"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "MISSING_OBJ")])


def fingerprint(rows: DataFrame, group: str, parts: list[str]) -> DataFrame:
    """(group, sha256) of each group's lines "part|part|..", sorted and joined by newlines."""
    line = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    text = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return rows.groupBy(group).agg(F.sha2(text, 256).alias("sha256"))
