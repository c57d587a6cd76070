"""Point-cloud filters, densities and neighbourhood operators over tables of returns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULTS, Thresholds
from ..functions.scalars import first_code, single

GROUND, BUILDING, NOISE = 2, 6, 7


def allowed(points: DataFrame, classes: Column, cls: str = "cls") -> DataFrame:
    return points.where(F.array_contains(classes, F.col(cls)))


def cleaned(points: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """No noise; heights in the band, but ground and building returns whatever their height."""
    keep = F.col("cls").isin(GROUND, BUILDING) | F.col("height").between(t.height_min_m, t.height_max_m)
    return points.where((F.col("cls") != NOISE) & keep)


def clustered(points: DataFrame) -> DataFrame:
    """Ground, and what belongs to a cluster."""
    return points.where((F.col("cls") == GROUND) | (F.col("cluster") > 0))


def planar(points: DataFrame, min_normal_z: float = 0.65, max_curvature: float = 0.12) -> DataFrame:
    return points.where((F.col("cls") == GROUND) | ((F.col("normal_z") >= min_normal_z) & (F.col("curvature") <= max_curvature)))


def as_building(cls: Column, roof_classes: Column) -> Column:
    """Roof classes become the building class; histograms are taken before this."""
    return F.when(F.array_contains(roof_classes, cls), F.lit(BUILDING)).otherwise(cls)


def class_histogram(points: DataFrame, key: str, cls: str = "cls") -> DataFrame:
    """(key, cls, n) for each class that occurs."""
    return points.groupBy(key, cls).agg(F.count(F.lit(1)).alias("n"))


def density(points: DataFrame, key: str, area: str, minimum: Column, cls: str = "cls") -> DataFrame:
    """(key, n, density, code): building returns per area against the greater of two minima."""
    found = points.groupBy(key).agg(F.count_if(F.col(cls) == BUILDING).alias("n"), F.max(area).alias("area"), F.max(minimum).alias("minimum"))
    d = F.try_divide(F.col("n"), F.col("area"))
    code = F.when(F.coalesce(F.col("area") > 0, F.lit(False)) & (d >= F.col("minimum")), F.lit("OK")).otherwise("LIDAR_DENSITY_TOO_LOW")
    return found.select(key, "n", d.alias("density"), code.alias("code"))


def crop_gate(points: DataFrame, key: str, roof_classes: list[int], t: Thresholds = DEFAULTS) -> DataFrame:
    """(key, total, roof, code): what a crop's class counts say, before classes are rewritten."""
    found = points.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cls").isin(*roof_classes)).alias("roof"))
    return found.withColumn("code", crop_code(F.col("total"), F.col("roof")))


def crop_code(total: Column, roof: Column) -> Column:
    """Code of a crop by its counts: none at all, or none in a roof class."""
    return first_code((F.coalesce(total, F.lit(0)) <= 0, "LIDAR_CROP_EMPTY"), (F.coalesce(roof, F.lit(0)) <= 0, "NO_USABLE_ROOF_RETURNS"))


def date_floor(day: Column, t: Thresholds = DEFAULTS) -> Column:
    """Code of an exact date before the floor; without a date nothing is said here."""
    return F.when(day < F.lit(t.min_acquisition), F.lit("LIDAR_TILE_BEFORE_MINIMUM_ACQUISITION_DATE"))


def time_stats(points: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, minimum, maximum, average) of a column, as a point file's statistics."""
    c = F.col(column)
    return points.groupBy(key).agg(F.count(c).alias("n"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.avg(c).alias("average"))


def only_date(days: DataFrame, key: str, day: str, low: str, high: str) -> DataFrame:
    """(key, day): the one distinct date inside the registered window, null if there are none or several."""
    inside = F.when(F.col(day).between(F.col(low), F.col(high)), F.col(day))
    span = days.groupBy(key).agg(F.min(inside).alias("first_day"), F.max(inside).alias("last_day"))  # equal ends: one date
    return span.select(key, F.when(F.col("first_day") == F.col("last_day"), F.col("first_day")).alias(day))


def gps_date(stats: DataFrame, key: str, candidates: Column, low: str, high: str) -> DataFrame:
    """stats with candidate dates as an array -> the only distinct one inside the window, or null."""
    inside = F.array_distinct(F.filter(candidates, lambda d: d.between(F.col(low), F.col(high))))
    return stats.select(key, single(inside).alias("day"))


def in_cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({c: F.floor(F.col(a) / size).cast("long") for c, a in (("cx", "x"), ("cy", "y"))})


def neighbours_within(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, pid, other, d): pairs at most radius apart, by cells of that size and their neighbours."""
    cells = in_cells(points.select(key, "pid", "x", "y", "z"), radius)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    far = cells.select(key, F.col("pid").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), "cx", "cy")
    near = cells.withColumn("n", F.explode(around)).withColumns({"cx": F.col("cx") + F.col("n.i"), "cy": F.col("cy") + F.col("n.j")}).drop("n")
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2)
    return near.join(far, [key, "cx", "cy"]).withColumn("d", d).where((F.col("pid") != F.col("other")) & (F.col("d") <= radius)).select(key, "pid", "other", "d")


def knn(group: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of each row's k nearest others."""
    distances, places = [], []
    for at in range(0, len(group), block):
        d = np.sqrt(((group[at : at + block, None] - group[None]) ** 2).sum(2))
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        places.append(order)
        distances.append(np.take_along_axis(d, order, 1))
    return np.concatenate(distances), np.concatenate(places)


def outliers(points: DataFrame, key: str, k: int = 12, multiplier: float = 2.2, classes: tuple[int, ...] | None = None) -> DataFrame:
    """(key, pid, mean_distance, outlier): mean distance to the k nearest beyond mean + multiplier * deviation.

    Per group (a building's crop); groups of fewer than two points have no outliers. With ``classes`` only
    returns of these (production: 1 and 6) are judged, among themselves; the others come back with no distance
    and as no outliers.
    """
    if classes is not None:
        mine = F.coalesce(F.col("cls").isin(*classes), F.lit(False))
        rest = points.where(~mine).select(key, "pid", F.lit(None).cast("double").alias("mean_distance"), F.lit(False).alias("outlier"))
        return outliers(points.where(mine), key, k, multiplier).unionByName(rest)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < 2:
            return pd.DataFrame({key: frame[key], "pid": frame["pid"], "mean_distance": np.nan, "outlier": False})
        frame = frame.sort_values("pid")
        d, _ = knn(frame[["x", "y", "z"]].to_numpy(float), min(k, len(frame) - 1))
        mean = d.mean(1)
        limit = mean.mean() + multiplier * mean.std(ddof=1)
        return pd.DataFrame({key: frame[key], "pid": frame["pid"], "mean_distance": mean, "outlier": mean > limit})

    schema = f"{key} {dict(points.dtypes)[key]}, pid long, mean_distance double, outlier boolean"
    return points.select(key, "pid", "x", "y", "z").groupBy(key).applyInPandas(run, schema)


def heights(points: DataFrame, key: str, k: int = 8, radius: float = 50.0) -> DataFrame:
    """(key, pid, height): z over the ground, the ground by inverse distance from its k nearest returns in plan."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ground = frame[frame["cls"] == GROUND]
        out = np.full(len(frame), np.nan)
        if len(ground):
            xy, gxy, gz = frame[["x", "y"]].to_numpy(float), ground[["x", "y"]].to_numpy(float), ground["z"].to_numpy(float)
            for at in range(0, len(frame), 512):
                d = np.sqrt(((xy[at : at + 512, None] - gxy[None]) ** 2).sum(2))
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                dist = np.take_along_axis(d, near, 1)
                w = np.where(dist <= radius, 1 / np.maximum(dist, 1e-9), 0)
                total = w.sum(1)
                level = np.divide((w * gz[near]).sum(1), total, out=np.full(len(total), np.nan), where=total > 0)
                out[at : at + 512] = frame["z"].to_numpy(float)[at : at + 512] - level
        return pd.DataFrame({key: frame[key], "pid": frame["pid"], "height": out})

    schema = f"{key} {dict(points.dtypes)[key]}, pid long, height double"
    return points.select(key, "pid", "x", "y", "z", "cls").groupBy(key).applyInPandas(run, schema)


def clusters(points: DataFrame, key: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """(key, pid, cluster): 3-D connected points, numbered by least pid from 1; small clusters are 0."""
    tolerance, least = t.cluster_tolerance_m, t.cluster_min_points

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid").reset_index(drop=True)
        xyz = frame[["x", "y", "z"]].to_numpy(float)
        label = np.arange(len(xyz))
        for at in range(0, len(xyz), 512):
            d2 = ((xyz[at : at + 512, None] - xyz[None]) ** 2).sum(2)
            a, b = np.nonzero(d2 <= tolerance**2)
            a = a + at
            while True:
                ra, rb = label[a], label[b]
                if (ra == rb).all():
                    break
                np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
                while (label[label] != label).any():
                    label = label[label]
        roots, size = np.unique(label, return_counts=True)
        number = dict(zip(roots[size >= least], range(1, len(roots) + 1)))
        return pd.DataFrame({key: frame[key], "pid": frame["pid"], "cluster": [number.get(x, 0) for x in label]})

    schema = f"{key} {dict(points.dtypes)[key]}, pid long, cluster int"
    return points.select(key, "pid", "x", "y", "z").groupBy(key).applyInPandas(run, schema)


def normals(points: DataFrame, key: str, k: int = 12) -> DataFrame:
    """(key, pid, normal_z, curvature) from the covariance of each point's k nearest; normals point up."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        xyz = frame[["x", "y", "z"]].to_numpy(float)
        nz, curve = np.full(len(xyz), np.nan), np.full(len(xyz), np.nan)
        if len(xyz) > 3:
            _, near = knn(xyz, min(k, len(xyz) - 1))
            local = xyz[near] - xyz[near].mean(1, keepdims=True)
            values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", local, local))
            nz = np.abs(vectors[:, 2, 0])
            curve = values[:, 0] / np.maximum(values.sum(1), 1e-12)
        return pd.DataFrame({key: frame[key], "pid": frame["pid"], "normal_z": nz, "curvature": curve})

    schema = f"{key} {dict(points.dtypes)[key]}, pid long, normal_z double, curvature double"
    return points.select(key, "pid", "x", "y", "z").groupBy(key).applyInPandas(run, schema)


def quantised(column: Column, scale: float = 0.01) -> Column:
    """Coordinate on the grid of a scaled-integer point file."""
    return F.round(column / scale) * scale
