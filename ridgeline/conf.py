"""Thresholds of the measurement pipeline and their permitted ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

METRES_TO_FEET = 3.280839895013123
SQUARE_METRES_TO_SQUARE_FEET = 10.763910416709722
METRES_PER_DEGREE = 111_320.0


@dataclass(frozen=True)
class Thresholds:
    """Defaults are the production values; validate() lists what is out of range."""

    min_longitude: float = -83.25
    max_longitude: float = -80.50
    min_latitude: float = 25.50
    max_latitude: float = 28.25
    footprint_radius_m: float = 45.0
    footprint_max_distance_m: float = 20.0
    footprint_ambiguity_m: float = 2.0
    consensus_iou: float = 0.70
    correlated_iou: float = 0.65
    consensus_centroid_m: float = 4.0
    consensus_area_percent: float = 16.0
    review_area_percent: float = 20.0
    height_min_m: float = 1.5
    height_max_m: float = 25.0
    cluster_tolerance_m: float = 1.5
    cluster_min_points: int = 20
    lidar_buffer_m: float = 8.0
    lidar_max_age_years: int = 10
    min_acquisition: date = date(2018, 1, 1)
    min_density: float = 8.0
    max_nodata_fraction: float = 0.10
    max_rmse_m: float = 0.35
    flat_pitch_degrees: float = 5.0
    min_confidence: float = 0.80
    max_solar_area_percent: float = 15.0
    max_solar_pitch_degrees: float = 10.0
    min_coverage: float = 0.98
    current_lidar_years: int = 2
    current_imagery_years: int = 2
    historical_pricing: bool = False
    plane_min_points: int = 20
    plane_min_inliers: float = 0.65
    plane_assign_m: float = 0.60
    plane_ransac_m: float = 0.15
    plane_normal_degrees: float = 5.0
    plane_rmse_m: float = 0.15
    plane_iterations: int = 1000
    mask_area_percent: float = 8.0
    mask_simplify_m: float = 0.25
    edge_node_m: float = 0.10
    perimeter_percent: float = 10.0

    def validate(self) -> list[str]:
        """Names of settings out of range, in order of the checks; empty if all hold."""
        checks = {
            "longitude": -180 <= self.min_longitude < self.max_longitude <= 180,
            "latitude": -90 <= self.min_latitude < self.max_latitude <= 90,
            "consensus_iou": 0.70 <= self.consensus_iou <= 0.95,
            "correlated_iou": 0.60 <= self.correlated_iou < self.consensus_iou,
            "consensus_centroid_m": 0 < self.consensus_centroid_m <= 5,
            "consensus_area_percent": 0 < self.consensus_area_percent <= 16,
            "review_area_percent": self.consensus_area_percent < self.review_area_percent <= 25,
            "height": 0 < self.height_min_m < self.height_max_m,
            "cluster": self.cluster_tolerance_m > 0 and self.cluster_min_points > 0,
            "min_confidence": 0 < self.min_confidence <= 1,
            "min_coverage": 0.98 <= self.min_coverage <= 1,
            "current_lidar_years": 0 <= self.current_lidar_years <= 5,
            "current_imagery_years": 0 <= self.current_imagery_years <= 5,
            "plane_min_inliers": 0 < self.plane_min_inliers <= 1,
            "plane_distances": min(self.plane_assign_m, self.plane_ransac_m, self.plane_rmse_m) > 0,
            "edge_node_m": 0.02 <= self.edge_node_m <= 0.15,
            "perimeter_percent": 2 <= self.perimeter_percent <= 15,
        }
        return [name for name, good in checks.items() if not good]

    @classmethod
    def from_environment(cls, env: dict[str, str], prefix: str = "RIDGELINE_") -> "Thresholds":
        """Typed values from environment-like text; a bad value names its setting in the error."""
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or not raw.strip():
                continue
            kind = {"float": float, "int": int, "bool": lambda x: x.strip().lower() in ("1", "true", "yes"), "date": date.fromisoformat}[str(f.type)]
            try:
                found[f.name] = kind(raw)
            except ValueError as bad:
                raise ValueError(f"{f.name}: {raw!r}") from bad
        return cls(**found)


DEFAULTS = Thresholds()
