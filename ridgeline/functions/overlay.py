"""Overlay of simple polygons, concave ones too: Arrow functions over numpy, a batch of rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


BLOCK = 4_000_000


def xy(ring) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in ring], dtype=float).reshape(-1, 2)


def _crossing_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, sides of a, sides of b): y where a side of one ring crosses one of the other, else nan."""
    p, q = a, np.roll(a, -1, axis=1)
    u, v = b, np.roll(b, -1, axis=1)
    d, e = (q - p)[:, :, None], (v - u)[:, None]
    w = u[:, None] - p[:, :, None]
    det = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (w[..., 0] * e[..., 1] - w[..., 1] * e[..., 0]) / det
        t = (w[..., 0] * d[..., 1] - w[..., 1] * d[..., 0]) / det
        hit = (det != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        return np.where(hit, p[:, :, None, 1] + s * d[..., 1], np.nan)


def _cuts(ring: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows, lines, sides): sorted x where each horizontal line crosses the ring, then infinities."""
    p, q = ring[:, None], np.roll(ring, -1, axis=1)[:, None]
    at = y[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = p[..., 0] + (at - p[..., 1]) / (q[..., 1] - p[..., 1]) * (q[..., 0] - p[..., 0])
    return np.sort(np.where((p[..., 1] > at) != (q[..., 1] > at), x, np.inf), axis=2)


def common_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas of the intersections of rings a(rows, n, 2) and b(rows, m, 2), simple but possibly concave.

    Between the heights of vertices and crossings all widths are linear, so the width half-way up a strip
    times its height is exact.
    """
    heights = np.concatenate([a[..., 1], b[..., 1], _crossing_heights(a, b).reshape(len(a), -1)], axis=1)
    heights = np.sort(heights, axis=1)  # nan last
    low, high = heights[:, :-1], heights[:, 1:]
    tall = np.nan_to_num(high - low)
    xa, xb = _cuts(a, (low + high) / 2), _cuts(b, (low + high) / 2)
    xa, xb = xa[..., : xa.shape[2] // 2 * 2], xb[..., : xb.shape[2] // 2 * 2]
    starts = np.maximum(xa[..., ::2, None], xb[..., None, ::2])
    ends = np.minimum(xa[..., 1::2, None], xb[..., None, 1::2])
    with np.errstate(invalid="ignore"):
        width = np.where(np.isfinite(ends), np.clip(ends - starts, 0, None), 0).sum((2, 3))
    return (width * tall).sum(1)


def common_area(a: np.ndarray, b: np.ndarray) -> float:
    return float(common_areas(a[None], b[None])[0])


@F.pandas_udf(T.DoubleType())
def _common(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    out = np.full(len(ax), np.nan)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (p, q) in enumerate(zip(ax, bx)):
        if p is not None and q is not None:
            shapes.setdefault((len(p), len(q)), []).append(i)
    for (n, m), rows in shapes.items():
        if n < 3 or m < 3:
            out[rows] = 0.0
            continue
        step = max(1, BLOCK // ((n + m + n * m) * (n * m // 4 + n + m)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            stack = lambda xs, ys: np.stack([np.stack(xs.iloc[part].to_numpy()), np.stack(ys.iloc[part].to_numpy())], axis=2)  # noqa: B023, E731
            out[part] = common_areas(stack(ax, ay), stack(bx, by))
    return pd.Series(out).where(~np.isnan(out), None)


def intersection_area(a: str | Column, b: str | Column) -> Column:
    """Area that two rings share; null for a null ring. Union area is the two areas less this.

    Rings travel as plain arrays of x and of y, and rows with equally many vertices are done at once.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return _common(a["x"], a["y"], b["x"], b["y"])


def coverage_ratio(cover: str | Column, target: str | Column, target_area: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), intersection_area(cover, target) / F.greatest(target_area, F.lit(1e-12))))


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a ring, split at its two farthest vertices; at least three stay."""
    n = len(ring)
    if n <= 3:
        return ring
    i = int(np.hypot(*(ring - ring[0]).T).argmax())
    keep = {0, i}
    todo = [(0, i), (i, n)]
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        p, q = ring[s], ring[e % n]
        inner = ring[s + 1 : e]
        d = q - p
        size = np.hypot(*d)
        off = np.abs(d[0] * (inner[:, 1] - p[1]) - d[1] * (inner[:, 0] - p[0])) / size if size > 0 else np.hypot(*(inner - p).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(s + 1 + k)
            todo += [(s, s + 1 + k), (s + 1 + k, e)]
    return ring[sorted(keep)] if len(keep) >= 3 else ring


def simplify(ring: Column, tolerance: float) -> Column:
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else [{"x": x, "y": y} for x, y in simplify_ring(xy(g), tolerance)] for g in rings])

    return run(ring)


def polygonise(cells: pd.DataFrame) -> list[np.ndarray]:
    """Outlines of the 8-connected groups of set cells (row, col) of one mask, as rings in cell units.

    Unit sides between a set and an unset cell are chained; at a corner where two cells touch the chain turns
    so as to stay with its own group.
    """
    on = set(zip(cells["row"].astype(int), cells["col"].astype(int)))
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in on:
        for side, (dr, dc) in (((c, r, c + 1, r), (-1, 0)), ((c + 1, r, c + 1, r + 1), (0, 1)), ((c + 1, r + 1, c, r + 1), (1, 0)), ((c, r + 1, c, r), (0, -1))):
            if (r + dr, c + dc) not in on:
                after.setdefault(side[:2], []).append(side[2:])
    rings = []
    while after:
        start = min(after)
        ring, at, came = [start], start, (1, 0)
        while True:
            ways = after[at]
            turn = lambda to: came[0] * (to[1] - at[1]) - came[1] * (to[0] - at[0])  # noqa: B023, E731
            to = min(ways, key=turn)
            ways.remove(to)
            if not ways:
                del after[at]
            came, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
            ring.append(at)
        rings.append(np.array(ring, dtype=float))
    return rings
