"""Readers of the pipeline's inputs as DataFrames. Bad rows are kept with a code, never raised one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import license_verified

GEOMETRY = "struct<type string, coordinates string>"
FEATURE = f"struct<id string, geometry {GEOMETRY}, properties map<string,string>>"


def registry(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """A YAML registry (a short, hand-kept file, read by the driver through Spark) as a table of ``schema``."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()["value"]
    loaded = yaml.safe_load(text)
    if not isinstance(loaded, dict):
        raise ValueError(f"{path}: not an object")
    fields = [f.split()[0] for f in schema.split(", ")]
    rows = [tuple(item.get(f) for f in fields) for item in loaded.get(section) or []]
    return spark.createDataFrame(rows, schema)


def shell_of(geometry: Column) -> Column:
    """The outer ring of a GeoJSON polygon (of a multi-polygon's only part), unclosed; null for anything else."""
    one = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    many = F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    ring = F.when(geometry["type"] == "Polygon", one[0]).when((geometry["type"] == "MultiPolygon") & (F.size(many) == 1), many[0][0])
    n = F.size(ring)
    closed = F.get(ring, F.lit(0)) == F.get(ring, n - 1)
    open_ring = F.when(closed, F.slice(ring, 1, n - 1)).otherwise(ring)
    return F.transform(open_ring, lambda p: G.named(x=p[0], y=p[1]))


def features(spark: SparkSession, path: str) -> DataFrame:
    """Whole GeoJSON files -> (file, pos, id, ring, properties, code); no features: no rows, bad JSON: one coded row."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"struct<type string, features array<{FEATURE}>>").alias("c"))
    bad = raw.where("c.type IS NULL").select("file", F.lit(None).cast("int").alias("pos"), F.lit(None).cast(FEATURE).alias("f"), F.lit("PROVIDER_JSON_INVALID").alias("code"))
    good = raw.where("c.type IS NOT NULL").select("file", F.posexplode("c.features").alias("pos", "f")).withColumn("code", F.lit(None).cast("string"))
    return good.unionByName(bad).select("file", "pos", identified("f").alias("id"), shell_of(F.col("f.geometry")).alias("ring"), F.col("f.properties").alias("properties"), "code")


def identified(feature: str) -> Column:
    """The feature's id, else its properties', else a hash of its geometry."""
    own = F.nullif(F.trim(F.col(f"{feature}.id")), F.lit(""))
    inner = F.nullif(F.trim(F.element_at(F.col(f"{feature}.properties"), "id")), F.lit(""))
    return F.coalesce(own, inner, F.concat(F.lit("geometry-"), F.substring(F.sha2(F.to_json(F.col(f"{feature}.geometry")), 256), 1, 24)))


def tile_lines(spark: SparkSession, path: str, quadkey: str) -> DataFrame:
    """A tile of JSON lines (gzip allowed: one task a file), each a feature or a collection; ids default to quadkey:line."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.trim("value") != "")
    parsed = raw.select("line", F.from_json("value", FEATURE).alias("one"), F.from_json("value", f"struct<features array<{FEATURE}>>").alias("many"))
    each = parsed.select("line", F.explode(F.when(F.col("one.geometry").isNotNull(), F.array("one")).otherwise(F.col("many.features"))).alias("f"))
    default = F.concat(F.lit(quadkey + ":"), F.col("line").cast("string"))
    return each.select("line", F.coalesce(F.nullif(F.trim("f.id"), F.lit("")), default).alias("id"), shell_of(F.col("f.geometry")).alias("ring"), F.col("f.properties").alias("properties"))


def tile_catalogue(spark: SparkSession, path: str, locations: tuple[str, ...] = ("unitedstates", "united states")) -> DataFrame:
    """A CSV catalogue of tiles, header names trimmed and lower-cased, one row (the first) per quadkey."""
    raw = spark.read.csv(path, header=True)
    rows = raw.toDF(*[c.strip().lstrip("﻿").lower() for c in raw.columns]).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.where(F.lower(F.trim("location")).isin(*locations))
    first = F.row_number().over(Window.partitionBy("quadkey").orderBy("__at"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n", "__at")


def map_ways(spark: SparkSession, path: str) -> DataFrame:
    """Map-service JSON -> (id, ring): ways of at least four points, closing point taken off."""
    schema = "struct<elements array<struct<type string, id long, tags map<string,string>, geometry array<struct<lat double, lon double>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["elements"]).alias("e")).where("e.type = 'way' AND size(e.geometry) >= 4")
    ring = F.transform("e.geometry", lambda p: G.named(x=p["lon"], y=p["lat"]))
    closed = F.col("e.geometry")[0] == F.element_at("e.geometry", -1)
    return rows.select(F.concat(F.lit("way/"), F.col("e.id").cast("string")).alias("id"), F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring).alias("ring"), F.col("e.tags").alias("tags"))


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """Point-tile metadata files -> (file, x0..z1, crs, points): conforming bounds first, else the cube's."""
    schema = "struct<boundsConforming array<double>, bounds array<double>, srs struct<wkt string, authority string, horizontal string>, points long>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("m"))
    b = F.coalesce("m.boundsConforming", "m.bounds")
    crs = F.coalesce(F.nullif("m.srs.wkt", F.lit("")), F.concat_ws(":", "m.srs.authority", "m.srs.horizontal"))
    return rows.select("file", *[F.get(b, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "z0", "x1", "y1", "z1"))], crs.alias("crs"), "m.points")


def point_table(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Returns in Parquet with x, y, z and class; a box becomes pushed-down range filters."""
    rows = spark.read.parquet(path)
    if box is None:
        return rows
    x0, y0, x1, y1 = box
    return rows.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def xyz(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated points with a header; rows without three finite numbers drop."""
    rows = spark.read.csv(path, header=True, schema="x double, y double, z double")
    return rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in "xyz"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(building_id, line_no, value): text files, the building named by the file up to its first dot."""
    raw = spark.read.text(path).select(F.substring_index("_metadata.file_name", ".", 1).alias("building_id"), F.monotonically_increasing_id().alias("at"), "value")
    return raw.select("building_id", F.row_number().over(Window.partitionBy("building_id").orderBy("at")).alias("line_no"), "value")


def reports(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(report_id, sha256, file, content): files whose name starts with 6 to 12 digits."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    named = rows.select(F.regexp_extract("_metadata.file_name", r"^(\d{6,12})", 1).alias("report_id"), F.sha2("content", 256).alias("sha256"), F.col("_metadata.file_name").alias("file"), "content")
    return named.where("report_id <> ''")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet grid saved as CSV: text cells with a row number from 2; blank rows drop, repeated headers are refused."""
    header = spark.read.text(path).first()["value"].split(",")
    if len(set(header)) != len(header):
        raise ValueError("Duplicate pricebook headers.")
    rows = spark.read.csv(path, header=True).withColumn("row", F.monotonically_increasing_id() + 2)
    return rows.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns if c != "row"]).isNotNull())


def evidence_records(spark: SparkSession, path: str) -> DataFrame:
    """(footprint_id, record): an evidence file's records by footprint, each as a variant."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<records map<string,string>>")["records"]).alias("footprint_id", "text"))
    return rows.select("footprint_id", F.try_parse_json("text").alias("record"))


def pinned_release(latest: str, pinned: str | None, policy: str = "current") -> str:
    """The release to read: of the form yyyy-mm-dd.n, and the pinned one if the policy says so."""
    import re

    if not re.fullmatch(r"20\d\d-\d\d-\d\d\.\d+", latest):
        raise ValueError(f"release {latest!r}")
    if policy == "pinned" and latest != pinned:
        raise ValueError(f"release {latest} is not the pinned {pinned}")
    return latest


def mask_rings(cells: DataFrame, key: str) -> DataFrame:
    """cells(key, row, col, value) of raster masks -> (key, n, ring): outlines of cells of value 1, in cell units."""
    import pandas as pd

    from ..functions.overlay import polygonise

    kind = dict(cells.dtypes)[key]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rings = polygonise(frame)
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(rings), "n": range(len(rings)), "ring": [[{"x": x, "y": y} for x, y in g] for g in rings]})

    return cells.where("value = 1").groupBy(key).applyInPandas(run, f"{key} {kind}, n int, ring array<struct<x:double,y:double>>")


def usable_registry(rows: DataFrame) -> DataFrame:
    return rows.where(license_verified(F.col("license")))
