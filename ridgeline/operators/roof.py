"""City-model lines to roof facets, classified edges and totals, one building per row or group.

Row-level measures are column expressions. Only the order-dependent node clustering of a building's few
hundred vertices runs in an Arrow function, over the buildings of a batch at once. ``measure`` moves each
building twice, before its text is parsed and after its nodes are found, and joins nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULTS, METRES_TO_FEET, SQUARE_METRES_TO_SQUARE_FEET, Thresholds
from ..functions import geometry as G
from ..functions.scalars import first_code, quality_confidence, quality_number

FEATURE = """struct<type string, id string, vertices array<array<double>>,
 transform struct<scale array<double>, translate array<double>>,
 CityObjects map<string, struct<type string, attributes map<string,string>,
  geometry array<struct<type string, lod string, boundaries string,
   semantics struct<surfaces array<struct<type string, rf_slope double>>, values string>>>>>>"""
SOLID = ("array<array<array<array<int>>>>", "array<array<int>>")
SURFACE = ("array<array<array<int>>>", "array<int>")
MIN_EDGE = 0.10


def features(lines: DataFrame) -> DataFrame:
    """lines(building_id, value) -> one row per building with its only feature and transform, or a code.

    A feature's own transform wins over the header's. Not exactly one feature: CITYJSON_FEATURE_COUNT_INVALID.
    """
    parsed = lines.select("building_id", F.from_json("value", FEATURE).alias("f"))
    feature = F.col("f.type") == "CityJSONFeature"
    grouped = parsed.groupBy("building_id").agg(
        F.count_if(feature).alias("n"),
        F.max_by("f", F.when(feature, 1).otherwise(0)).alias("f"),
        F.max(F.when(~feature, F.to_json("f.transform"))).alias("header"),
    )
    header = F.from_json("header", "struct<scale array<double>, translate array<double>>")
    transform = F.coalesce(F.col("f.transform"), header)
    bad = transform.isNotNull() & ((F.size(transform["scale"]) != 3) | (F.size(transform["translate"]) != 3))
    code = first_code((F.col("n") != 1, "CITYJSON_FEATURE_COUNT_INVALID"), (bad, "CITYJSON_TRANSFORM_INVALID"), (F.coalesce(F.size("f.vertices"), F.lit(0)) < 1, "CITYJSON_VERTICES_MISSING"))
    return grouped.select("building_id", "f", transform.alias("transform"), code.alias("code"))


def vertices(found: Column, transform: Column) -> Column:
    """Decoded vertices as structs; no transform is the identity."""

    def decode(v: Column) -> Column:
        at = lambda i: v[i] * F.coalesce(transform["scale"][i], F.lit(1.0)) + F.coalesce(transform["translate"][i], F.lit(0.0))
        return G.named(x=at(0), y=at(1), z=at(2))

    return F.transform(found, decode)


def surfaces(buildings: DataFrame) -> DataFrame:
    """(building_id, pos, rings, slope): roof surfaces of level 2.2, in order; rings of vertex structs."""
    return surfaces_beside(buildings.where("code IS NULL")).where("pos IS NOT NULL")


def surfaces_beside(buildings: DataFrame, *kept: str) -> DataFrame:
    """As surfaces(), with the kept columns; a building without surfaces has rows too, without pos."""
    parts = F.filter(F.map_values("f.CityObjects"), lambda o: o["type"].isin("Building", "BuildingPart"))
    rows = buildings.select("building_id", *kept, vertices(F.col("f.vertices"), F.col("transform")).alias("v"), F.posexplode_outer(F.when(F.col("code").isNull(), parts)).alias("o", "object"))
    rows = rows.select("building_id", *kept, "v", "o", F.posexplode_outer(F.filter("object.geometry", lambda g: g["lod"] == "2.2")).alias("g", "geom"))
    solid = F.col("geom.type") == "Solid"
    flat = F.col("geom.type").isin("MultiSurface", "CompositeSurface")
    faces = F.when(solid, F.flatten(F.from_json("geom.boundaries", SOLID[0]))).when(flat, F.from_json("geom.boundaries", SURFACE[0]))
    labels = F.when(solid, F.flatten(F.from_json("geom.semantics.values", SOLID[1]))).when(flat, F.from_json("geom.semantics.values", SURFACE[1]))
    rows = rows.select("building_id", *kept, "v", "o", "g", F.col("geom.semantics.surfaces").alias("surfaces"), faces.alias("faces"), labels.alias("labels"))
    both = F.when(F.size("faces") == F.size("labels"), F.arrays_zip("faces", "labels"))
    rows = rows.select("building_id", *kept, "v", "o", "g", "surfaces", F.posexplode_outer(both).alias("k", "face"))
    label = F.get("surfaces", F.col("face.labels"))
    roof = F.coalesce(label["type"] == "RoofSurface", F.lit(False))
    rings = F.transform("face.faces", lambda ring: F.transform(ring, lambda i: F.get("v", i)))
    rows = rows.withColumns({"roof": roof, "slope": label["rf_slope"]})
    pos = F.count_if("roof").over(Window.partitionBy("building_id").orderBy("o", "g", "k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.select("building_id", *kept, F.when(F.col("roof"), pos).alias("pos"), F.when(F.col("roof"), rings).alias("rings"), "slope")
    return rows


def facets(found: DataFrame, t: Thresholds = DEFAULTS, *kept: str) -> DataFrame:
    """Roof surfaces -> measures of each facet (metres, degrees) and the first rule it breaks, or null; with the kept columns."""
    shell = F.col("rings")[0]
    holes = F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0)))
    rows = found.select(
        "building_id", *kept, "pos", F.concat(F.lit("F"), "pos").alias("facet_id"), shell.alias("ring"), "slope",
        F.exists("rings", lambda r: (F.size(r) < 3) | F.exists(r, lambda p: p.isNull())).alias("broken"),
        G.newell(shell).alias("vector"),
        F.exists(holes, lambda h: G.norm(G.newell(h)) <= 0.02).alias("pinhole"),
        (G.ring_area(shell) - G.total(F.transform(holes, G.ring_area))).alias("plan_area"),
        (G.norm(G.newell(shell)) / 2 - G.total(F.transform(holes, lambda h: G.norm(G.newell(h)) / 2))).alias("area"),
        F.size(holes).alias("openings"),
        G.total(F.transform(holes, lambda h: G.cyclic(h, G.length_3d))).alias("opening_perimeter"),
        G.mean_vertex(shell).alias("centroid"),
    )
    rows = rows.withColumn("normal", G.upward(F.col("vector")))
    rows = rows.withColumn("pitch", G.pitch_degrees(F.col("normal"))).withColumn("azimuth", G.azimuth_degrees(F.col("normal")))
    sloped = F.col("plan_area") / F.cos(F.radians("pitch"))
    code = first_code(
        (F.col("broken"), "ROOF_FACET_INVALID"),
        (F.col("pinhole"), "ROOF_OPENING_INVALID"),
        (F.col("area") <= 0.25, "ROOF_FACET_TOO_SMALL"),
        (F.col("normal.z") <= 1e-5, "ROOF_FACET_VERTICAL"),
        (F.abs(sloped - F.col("area")) / F.col("area") * 100 > 0.5, "ROOF_AREA_FORMULA_MISMATCH"),
        (F.abs(F.col("slope") - F.col("pitch")) > 3, "ROOF_PITCH_SEMANTICS_MISMATCH"),
    )
    kind = F.when(F.col("pitch") <= t.flat_pitch_degrees, "FLAT").otherwise("SLOPED")
    return rows.withColumns({"code": code, "classification": kind, "rise": G.rise_per_12(F.col("pitch"))}).drop("broken", "pinhole", "vector")


def quality(buildings: DataFrame, t: Thresholds = DEFAULTS, *kept: str) -> DataFrame:
    """(building_id, code, confidence) from the reconstruction's own quality attributes; with the kept columns."""
    owner = F.filter(F.map_values("f.CityObjects"), lambda o: o["type"] == "Building")
    a = F.aggregate(owner, F.create_map().cast("map<string,string>"), lambda m, o: F.when(o["attributes"].isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(o["attributes"]), k)), o["attributes"])))
    rows = buildings.select("building_id", *kept, a.alias("a")).select(
        "building_id",
        *kept,
        quality_number(F.col("a.rf_pt_density")).alias("density"),
        quality_number(F.col("a.rf_nodata_frac"), 1.0).alias("nodata"),
        quality_number(F.col("a.rf_rmse_lod22")).alias("rmse"),
        F.coalesce((F.col("a.rf_success") == "false") | (F.col("a.rf_pointcloud_unusable") == "true"), F.lit(False)).alias("unusable"),
        F.coalesce(F.col("a.rf_extrusion_mode"), F.lit("standard")).alias("mode"),
    )
    density, nodata, rmse = F.col("density"), F.col("nodata"), F.col("rmse")
    code = first_code(
        (F.col("unusable"), "ROOFER_RECONSTRUCTION_UNUSABLE"),
        (F.col("mode") != "standard", "ROOFER_FALLBACK_MODEL"),
        (density.isNull() | nodata.isNull() | rmse.isNull(), "ROOFER_QUALITY_METADATA_INVALID"),
        (density < t.min_density, "LIDAR_DENSITY_TOO_LOW"),
        (nodata > t.max_nodata_fraction, "LIDAR_COVERAGE_INCOMPLETE"),
        (rmse > t.max_rmse_m, "ROOFER_RMSE_TOO_HIGH"),
    )
    return rows.select("building_id", *kept, code.alias("code"), F.when(code.isNull(), quality_confidence(density, nodata, rmse, t)).alias("confidence"))


XYZ = pa.struct([(c, pa.float64()) for c in "xyz"])
USE = pa.struct([*((c, pa.int32()) for c in ("seq", "lo", "hi", "pos")), ("a", XYZ), ("b", XYZ)])
USES = "array<struct<seq:int,lo:int,hi:int,pos:int,a:struct<x:double,y:double,z:double>,b:struct<x:double,y:double,z:double>>>"
#: Pairs of points, or of sides and points, that are tested at once.
PAIRS = 250_000


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(counts) items: which count it belongs to, and its number there."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(counts: np.ndarray) -> list[np.ndarray]:
    """Item numbers in blocks of about PAIRS by count; an item is never cut."""
    if not len(counts):
        return []
    return np.split(np.arange(len(counts)), np.flatnonzero(np.diff((np.cumsum(counts) - counts) // PAIRS)) + 1)


def node_buildings(building: np.ndarray, pos: np.ndarray, size: np.ndarray, xyz: np.ndarray, tolerance: float) -> tuple:
    """Edge uses (building, seq, lo, hi, pos, start, end; arrays) of buildings: sides of facets, cut at nodes on them.

    A facet has a building (numbers that do not fall), a pos and a size, and its vertices follow in xyz. Of a
    building, vertices in that order join the first node within tolerance, else found a new one. seq is the
    order in which uses are met; a facet uses a pair of nodes once.
    """
    facet, corner = _spread(size)
    owner = building[facet]
    order = np.lexsort((*xyz.T, owner))
    same = np.concatenate(([True], (owner[order][1:] != owner[order][:-1]) | (xyz[order][1:] != xyz[order][:-1]).any(axis=1)))[: len(order)]
    first = np.sort(order[same])
    points, at_home = xyz[first], owner[first]
    n_buildings = int(building[-1]) + 1 if len(building) else 0
    held = np.bincount(at_home, minlength=n_buildings)
    begin = np.cumsum(held) - held

    founder = np.arange(len(points))
    for block in _blocks(held[at_home]):
        left, k = _spread(held[at_home[block]])
        left = block[left]
        right = begin[at_home[left]] + k
        near = (right < left) & (np.linalg.norm(points[right] - points[left], axis=1) <= tolerance)
        for i, j in zip(left[near].tolist(), right[near].tolist()):  # by i, then j
            if founder[i] == i and founder[j] == j:
                founder[i] = j
    rank = np.cumsum(founder == np.arange(len(points)))
    keys = (rank - 1)[founder] - (rank - (founder == np.arange(len(points))))[begin[at_home]]

    start = xyz
    side = xyz[np.arange(len(xyz)) + np.where(corner + 1 == size[facet], 1 - size[facet], 1)] - start
    length = np.linalg.norm(side, axis=1)
    sides = np.flatnonzero(~(length <= MIN_EDGE))
    found = [(sides[:0], sides[:0], length[:0])]
    for block in _blocks(held[owner[sides]]):
        s, k = _spread(held[owner[sides[block]]])
        s = sides[block][s]
        p = begin[owner[s]] + k
        with np.errstate(invalid="ignore"):
            gap = points[p] - start[s]
            at = (gap * side[s]).sum(axis=1) / length[s] ** 2
            off = np.linalg.norm(gap - at[:, None] * side[s], axis=1)
            on = (np.abs(at - 0.5) <= 0.5 + tolerance / length[s]) & (off <= tolerance)
        found.append((s[on], p[on], np.clip(at[on], 0, 1)))
    s, p, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, s))
    s, p, at = s[order], p[order], at[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (keys[p[1:]] != keys[p[:-1]])))[: len(s)]
    s, p, at = s[new], p[new], at[new]
    i = np.flatnonzero(s[1:] == s[:-1])
    a, b = (start[s[x]] + at[x][:, None] * side[s[x]] for x in (i, i + 1))
    lo, hi = np.minimum(keys[p[i]], keys[p[i + 1]]), np.maximum(keys[p[i]], keys[p[i + 1]])
    long = np.linalg.norm(b - a, axis=1) > MIN_EDGE
    a, b, lo, hi, of = a[long], b[long], lo[long], hi[long], facet[s[i[long]]]
    order = np.lexsort((hi, lo, of))
    met = np.concatenate(([True], (of[order][1:] != of[order][:-1]) | (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])))[: len(order)]
    good = np.sort(order[met])
    _, seq = _spread(np.bincount(building[of[good]], minlength=n_buildings))
    return building[of[good]], seq, lo[good], hi[good], pos[of[good]], a[good], b[good]


def node_edges(facets: list[tuple[int, np.ndarray]], tolerance: float) -> list[tuple]:
    """node_buildings() of one building: uses (seq, lo, hi, pos, start, end) of its facets (pos, ring of xyz rows)."""
    pos, rings = [f[0] for f in facets], [f[1] for f in facets]
    found = node_buildings(np.zeros(len(pos), dtype=int), np.array(pos), np.array([len(r) for r in rings]), np.concatenate(rings), tolerance)
    return [(int(seq), int(lo), int(hi), int(at), a, b) for _, seq, lo, hi, at, a, b in zip(*found)]


def noded(batch: pa.Array, tolerance: float) -> pa.Array:
    """Arrays of facets struct(pos, xyz: all coordinates of the ring, vertex by vertex) -> arrays of uses."""
    facets_of = np.asarray(batch.value_lengths().fill_null(0))
    f = batch.flatten()
    pos = np.asarray(f.field("pos"), dtype=np.int64)
    rings = f.field("xyz")
    size = np.asarray(rings.value_lengths(), dtype=np.int64) // 3
    xyz = np.asarray(rings.flatten().cast(pa.float64()).fill_null(float("nan")) if len(rings) else [], dtype=float).reshape(-1, 3)
    row, _ = _spread(facets_of)
    of, seq, lo, hi, at, a, b = node_buildings(row, pos, size, xyz, tolerance)
    ends = lambda v: pa.StructArray.from_arrays([pa.array(v[:, i]) for i in range(3)], fields=list(XYZ))
    uses = pa.StructArray.from_arrays([*(pa.array(x, pa.int32()) for x in (seq, lo, hi, at)), ends(a), ends(b)], fields=list(USE))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(facets_of))))), pa.int32()), uses)


def uses_of(sides: Column, t: Thresholds = DEFAULTS) -> Column:
    """Uses of a building's facets: an array of struct(pos, xyz), in order -> an array of uses."""
    tolerance = t.edge_node_m

    def run(batch: pa.Array) -> pa.Array:
        return noded(batch, tolerance)

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, USES)(sides)


def _xyz(ring: Column) -> Column:
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"], p["z"])))


def edge_uses(found: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(building_id, seq, lo, hi, pos, a, b). A building's facets come as one row, so an Arrow batch holds many buildings."""
    rows = found.select(F.col("building_id").cast("string").alias("building_id"), F.struct("pos", _xyz(F.col("ring")).alias("xyz")).alias("f"))
    rows = rows.groupBy("building_id").agg(F.array_sort(F.collect_list("f")).alias("facets"))
    return rows.select("building_id", F.inline(uses_of(F.col("facets"), t)))


def classify_pair(angle: Column, first: Column, second: Column, drop: Column, level: float = 0.15, decisive: float = 0.08, coplanar: float = 2.0) -> Column:
    """Kind of an edge that two facets share, from the heights of their planes beside it."""
    up, down = (first > decisive) | (second > decisive), (first < -decisive) | (second < -decisive)
    return (
        F.when(angle <= coplanar, F.lit("coplanar"))
        .when(up & ~down, F.lit("valleys"))
        .when(down & ~up, F.when(drop <= level, F.lit("ridges")).otherwise(F.lit("hips")))
        .otherwise(F.lit("ambiguous"))
    )


def classify_single(drop: Column, middle: Column, centre: Column, level: float = 0.15, decisive: float = 0.08) -> Column:
    """Kind of an edge with one facet."""
    return F.when(drop > level, F.lit("rakes")).when(middle <= centre + decisive, F.lit("eaves")).otherwise(F.lit("highPerimeters"))


def edges(uses: DataFrame, found: DataFrame) -> DataFrame:
    """(building_id, seq, kind, length_feet, plan_feet, facets): each noded edge once; lengths of its first use."""
    side = found.select(F.col("building_id").cast("string").alias("building_id"), "pos", "facet_id", "ring", "normal", F.col("centroid.z").alias("centre"))
    return classified(uses.join(side, ["building_id", "pos"]))


def classified(rows: DataFrame, *kept: str) -> DataFrame:
    """Uses with their facet's facet_id, ring, normal and centre -> as edges(), with columns that a building keeps.

    A row without seq stands for a building without edges and comes out with n_uses 0 and no kind.
    """
    rows = rows.withColumn("delta", G.side_height(F.col("ring"), F.col("normal"), F.col("a"), F.col("b")))
    item = F.when(F.col("seq").isNotNull(), F.struct("seq", "facet_id", "normal", "delta", "a", "b", "centre"))
    pairs = rows.groupBy("building_id", "lo", "hi").agg(F.array_sort(F.collect_list(item)).alias("u"), *[F.first(c).alias(c) for c in kept])  # two uses, or broken
    first, second = F.get("u", F.lit(0)), F.get("u", F.lit(1))
    drop = F.abs(first["a"]["z"] - first["b"]["z"])
    kind = (
        F.when(F.size("u") > 2, F.lit("nonManifold"))
        .when(F.size("u") == 2, classify_pair(G.angle_degrees(first["normal"], second["normal"]), first["delta"], second["delta"], drop))
        .when(F.size("u") == 1, classify_single(drop, (first["a"]["z"] + first["b"]["z"]) / 2, first["centre"]))
    )
    feet = lambda x: F.round(x * METRES_TO_FEET, 2)
    return pairs.select(
        "building_id", *kept, first["seq"].alias("seq"), kind.alias("kind"), F.size("u").alias("n_uses"),
        feet(G.length_3d(first["a"], first["b"])).alias("length_feet"), feet(G.length_plan(first["a"], first["b"])).alias("plan_feet"),
        F.transform("u", lambda x: x["facet_id"]).alias("facets"),
    )


KINDS = {"rakes": "RA", "eaves": "EA", "valleys": "VA", "ridges": "RI", "hips": "HI", "highPerimeters": "HP"}


def numbered(found: DataFrame) -> DataFrame:
    """Edges with an id by kind in order of encounter."""
    prefix = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    n = F.row_number().over(Window.partitionBy("building_id", "kind").orderBy("seq"))
    return found.where(F.col("kind").isin(*KINDS)).withColumn("edge_id", F.concat(prefix[F.col("kind")], n))


def facet_sums(t: Thresholds = DEFAULTS, digits: int = 2) -> list[Column]:
    """Aggregates of a building's facets (as of facets()): count, areas in square feet, pitches, openings, first facet code."""
    ft2 = SQUARE_METRES_TO_SQUARE_FEET
    return [
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("pos"))).alias("facet_code"),
        F.count("pos").alias("facets"),
        F.round(F.sum("area") * ft2, 2).alias("roof_area_sqft"),
        F.round(F.sum("plan_area") * ft2, 2).alias("plan_area_sqft"),
        F.round(F.sum(F.col("pitch") * F.col("area")) / F.sum("area"), digits).alias("average_pitch"),
        F.round(F.max("pitch"), digits).alias("maximum_pitch"),
        F.round(F.coalesce(F.sum(F.when(F.col("pitch") <= t.flat_pitch_degrees, F.col("area"))), F.lit(0.0)) * ft2, 2).alias("flat_area_sqft"),
        F.sum("openings").alias("openings"),
        F.round(F.sum("opening_perimeter") * METRES_TO_FEET, 2).alias("opening_perimeter_feet"),
    ]


def facet_totals(found: DataFrame, t: Thresholds = DEFAULTS, digits: int = 2) -> DataFrame:
    """Facets (as of facets()) -> one row per building with facet_sums()."""
    return found.groupBy(F.col("building_id").cast("string").alias("building_id")).agg(*facet_sums(t, digits))


def edge_totals(classified: DataFrame, *kept: str) -> DataFrame:
    """Edges (as of edges()) -> one row per building: feet by kind, in space and in plan, derived totals, counts."""
    of = lambda column, kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0.0)), 2)
    lines = classified.groupBy("building_id").agg(
        *[F.first(c).alias(c) for c in kept],
        *[of("length_feet", k).alias(k) for k in KINDS],
        *[of("plan_feet", k).alias("plan_" + k) for k in KINDS],
        F.count_if(F.col("n_uses") > 0).alias("noded_edges"),
        F.count_if(F.col("n_uses") == 2).alias("shared_edges"),
        F.count_if(F.col("n_uses") == 1).alias("exterior_edges"),
        F.bool_or(F.col("kind") == "nonManifold").alias("non_manifold"),
        F.bool_or(F.col("kind") == "ambiguous").alias("ambiguous"),
    )
    return lines.withColumns({
        "external_perimeter_feet": F.round(F.col("eaves") + F.col("rakes"), 2),
        "external_plan_perimeter_feet": F.round(F.col("plan_eaves") + F.col("plan_rakes") + F.col("plan_highPerimeters"), 2),
        "internal_edge_feet": F.round(F.col("ridges") + F.col("hips") + F.col("valleys"), 2),
    })


def measure(lines: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """lines(building_id, value) of city-model text -> one row per building: areas, pitches, lengths by kind (sums of
    rounded lengths), and the first code; facet codes come before quality codes, these before edge codes.

    The text is shuffled and parsed once; a building's codes, facets and edges then follow, each in the row or group
    of the one before. So no table of buildings is joined, or broadcast.
    """
    texts = lines.select(F.col("building_id").cast("string").alias("building_id"), "value").repartition("building_id")
    buildings = features(texts).withColumnRenamed("code", "feature_code")
    graded = quality(buildings, t, "f", "transform", "feature_code")
    head = F.struct("feature_code", F.col("code").alias("quality_code"), "confidence")
    graded = graded.select("building_id", "f", "transform", F.col("feature_code").alias("code"), head.alias("head"))
    found = facets(surfaces_beside(graded, "head"), t, "head")
    there = F.col("pos").isNotNull()
    found = found.withColumns({c: F.when(there, F.col(c)) for c in ("code", "area", "plan_area", "pitch", "openings", "opening_perimeter")})
    sums = facet_sums(t)
    names = ("facet_code", "facets", "roof_area_sqft", "plan_area_sqft", "average_pitch", "maximum_pitch", "flat_area_sqft", "openings", "opening_perimeter_feet")
    facet = F.struct("pos", "code", "facet_id", "ring", "normal", F.col("centroid.z").alias("centre"))
    rows = found.groupBy("building_id").agg(F.first("head").alias("head"), *sums, F.array_sort(F.collect_list(F.when(there, facet))).alias("all"))
    rows = rows.select("building_id", F.struct("head.*", *names).alias("roof"), "all")
    good = F.transform(F.filter("all", lambda f: f["code"].isNull()), lambda f: F.struct(f["pos"].alias("pos"), _xyz(f["ring"]).alias("xyz")))
    rows = rows.withColumn("uses", uses_of(good, t)).repartition("building_id")  # Arrow functions lose the partitioning
    rows = rows.select("building_id", "roof", "all", F.explode_outer("uses").alias("use"))
    rows = rows.select("building_id", "roof", "use.*", F.get("all", F.col("use.pos") - 1).alias("side"))
    rows = rows.select("building_id", "roof", "seq", "lo", "hi", "a", "b", "side.facet_id", "side.ring", "side.normal", "side.centre")
    out = edge_totals(classified(rows, "roof"), "roof").select("*", "roof.*")
    some, lined = F.col("facets") > 0, F.col("noded_edges") > 0
    code = F.coalesce(
        "feature_code",
        F.when(~some, F.lit("ROOF_FACETS_MISSING")),
        "facet_code",
        "quality_code",
        F.when(F.col("non_manifold"), F.lit("NON_MANIFOLD_ROOF_EDGE")),
        F.when(F.col("ambiguous"), F.lit("ROOF_EDGE_CLASSIFICATION_INCOMPLETE")),
    )
    of_facets = [F.when(some, F.col(c)).alias(c) for c in names[1:]]
    of_edges = [F.when(lined, F.col(c)).alias(c) for c in (*KINDS, "external_perimeter_feet", "external_plan_perimeter_feet", "internal_edge_feet", "noded_edges", "shared_edges", "exterior_edges")]
    return out.select("building_id", code.alias("code"), F.round("confidence", 3).alias("confidence"), *of_facets, *of_edges)


def perimeter_gate(measured: DataFrame, outline_feet: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds perimeter_code: the plan perimeter of the edges must be there and agree with that of the outline."""
    plan, outline = F.col("external_plan_perimeter_feet"), F.col(outline_feet)
    gap = F.abs(plan - outline) / F.greatest(outline, F.lit(0.01)) * 100
    known = F.coalesce((plan > 0) & (outline > 0), F.lit(False))
    code = first_code((~known, "ROOF_TOPOLOGY_PERIMETER_MISSING"), (gap > t.perimeter_percent, "ROOF_TOPOLOGY_PERIMETER_MISMATCH"))
    return measured.withColumn("perimeter_variance", F.round(gap, 2)).withColumn("perimeter_code", code)
