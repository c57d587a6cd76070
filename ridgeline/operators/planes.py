"""Independent check of roof planes against points: assignment, robust fit and gates."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULTS, Thresholds
from ..functions import geometry as G


def nearest_plane(points: DataFrame, planes: DataFrame, key: str, within: float | None = None, limit: float = DEFAULTS.plane_assign_m) -> DataFrame:
    """(key, pid, facet, d): the plane of its building nearest to each point, the least facet of equals.

    planes(key, facet, ox, oy, oz, nx, ny, nz[, ring]); with ``within`` only facets whose outline is that
    near in plan compete. Points farther than ``limit`` from their plane are left out.
    """
    d = F.abs((F.col("x") - F.col("ox")) * F.col("nx") + (F.col("y") - F.col("oy")) * F.col("ny") + (F.col("z") - F.col("oz")) * F.col("nz"))
    pairs = points.join(planes, key)
    if within is not None:
        pairs = pairs.where(G.distance_to_polygon(F.col("x"), F.col("y"), F.col("ring")) <= within)
    best = pairs.withColumn("d", d).groupBy(key, "pid").agg(F.min(F.struct("d", "facet")).alias("m"))
    return best.select(key, "pid", "m.facet", "m.d").where(F.col("d") <= limit)


def moments(points: DataFrame, key: str) -> DataFrame:
    """(key, n, a, b, rmse, pitch): least-squares plane z = a x + b y + c in closed form, about the mean."""
    cov, var = F.covar_pop, F.var_pop
    m = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), var("x").alias("xx"), var("y").alias("yy"), var("z").alias("zz"),
        cov("x", "y").alias("xy"), cov("x", "z").alias("xz"), cov("y", "z").alias("yz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    a = F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det)
    b = F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)
    m = m.withColumns({"a": a, "b": b})
    rest = F.greatest(F.lit(0.0), F.col("zz") - F.col("a") * F.col("xz") - F.col("b") * F.col("yz"))
    return m.select(key, "n", "a", "b", F.sqrt(rest).alias("rmse"), F.degrees(F.atan(F.sqrt(F.col("a") ** 2 + F.col("b") ** 2))).alias("pitch"))


def ransac(xyz: np.ndarray, threshold: float, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit normal with z up, inlier mask) of the plane with most points within threshold, refitted to them."""
    rng = np.random.default_rng(seed)
    triples = rng.random((rounds, len(xyz))).argpartition(2, axis=1)[:, :3] if len(xyz) < 2000 else rng.integers(0, len(xyz), (rounds, 3))
    a, b, c = (xyz[triples[:, i]] for i in range(3))
    normal = np.cross(b - a, c - a)
    size = np.linalg.norm(normal, axis=1)
    good = size > 1e-12
    normal, a = normal[good] / size[good, None], a[good]
    votes = np.array([(np.abs((xyz - p) @ n) <= threshold).sum() for p, n in zip(a, normal)])
    if not len(votes):
        return np.array([0.0, 0.0, 1.0]), np.zeros(len(xyz), dtype=bool)
    best = votes.argmax()
    inside = np.abs((xyz - a[best]) @ normal[best]) <= threshold
    centre = xyz[inside].mean(0)
    fitted = np.linalg.svd(xyz[inside] - centre, full_matrices=False)[2][2]
    fitted = fitted if fitted[2] >= 0 else -fitted
    return fitted, np.abs((xyz - centre) @ fitted) <= threshold


FIT = "n long, span_x double, span_y double, span_z double, singular_x double, singular_y double, singular_z double, nx double, ny double, nz double, inliers long, inlier_ratio double, rmse double, pitch double"


def fit_planes(points: DataFrame, keys: list[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """One robust plane per group of points (a facet's), fitted about the group's mean, seeded by its key."""
    types = dict(points.dtypes)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x", "y", "z"])
        xyz = frame[["x", "y", "z"]].to_numpy(float)
        local = xyz - xyz.mean(0)
        span = np.ptp(local, axis=0)
        singular = np.zeros(3)
        values = np.linalg.svd(local, compute_uv=False)
        singular[: len(values)] = values
        if len(xyz) < 3:
            row = [len(xyz), *span, *singular, np.nan, np.nan, np.nan, 0, 0.0, np.nan, np.nan]
        else:
            normal, inside = ransac(local, t.plane_ransac_m, t.plane_iterations, zlib.crc32(repr(key).encode()))
            centre = local[inside].mean(0) if inside.any() else np.zeros(3)
            off = (local[inside] - centre) @ normal
            rmse = float(np.sqrt((off**2).mean())) if len(off) else np.nan
            row = [len(xyz), *span, *singular, *normal, int(inside.sum()), float(inside.mean()), rmse, float(np.degrees(np.arccos(np.clip(normal[2], -1, 1))))]
        return pd.DataFrame([[*key, *row]])

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + FIT
    return points.select(*keys, "x", "y", "z").groupBy(*keys).applyInPandas(run, schema)


def plane_gates(n: Column, ratio: Column, angle: Column, rmse: Column, t: Thresholds = DEFAULTS) -> Column:
    """Codes against a fitted facet; too little support stands alone."""
    few = F.array(F.lit("OPEN3D_FACET_SUPPORT_INSUFFICIENT"))
    rest = F.array_compact(F.array(
        F.when(ratio < t.plane_min_inliers, "PLANE_INLIER_RATIO_TOO_LOW"),
        F.when(angle > t.plane_normal_degrees, "PLANE_NORMAL_DISAGREEMENT"),
        F.when(rmse.isNull() | (rmse > t.plane_rmse_m), "PLANE_RMSE_TOO_HIGH"),
    ))
    return F.when(n < t.plane_min_points, few).otherwise(rest)


def validate(points: DataFrame, facets: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """points(building_id, pid, x, y, z), facets of roof.facets() -> a row per facet with its fit and codes."""
    planes = facets.select(
        "building_id", F.col("pos").alias("facet"), "ring", "normal",
        *[F.col("ring")[0][c].alias("o" + c) for c in "xyz"], *[F.col("normal")[c].alias("n" + c) for c in "xyz"],
    )
    owner = nearest_plane(points, planes, "building_id", within=0.02, limit=t.plane_assign_m)
    fits = fit_planes(points.join(owner, ["building_id", "pid"]), ["building_id", "facet"], t).drop("facet_id")
    side = planes.select("building_id", "facet", "normal")
    out = side.join(fits, ["building_id", "facet"], "left")
    angle = G.angle_degrees(F.col("normal"), G.named(x=F.col("nx"), y=F.col("ny"), z=F.col("nz")))
    codes = plane_gates(F.coalesce("n", F.lit(0)), F.col("inlier_ratio"), angle, F.col("rmse"), t)
    return out.withColumns({"normal_angle": angle, "codes": codes}).drop("normal")
