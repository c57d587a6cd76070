"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.points import quantised


def outlines(rows: DataFrame, path: str) -> None:
    """Selected outlines as Parquet, rings as arrays of points."""
    rows.write.mode("overwrite").parquet(path)


def point_table(rows: DataFrame, path: str, scale: float = 0.01) -> None:
    """Points on the grid of a scaled-integer point file, sorted in files by place so that boxes prune."""
    snapped = rows.withColumns({c: quantised(F.col(c), scale) for c in "xyz"})
    snapped.repartitionByRange("x", "y").sortWithinPartitions("x", "y").write.mode("overwrite").parquet(path)


def xyz(rows: DataFrame, path: str) -> None:
    """CSV with a header and eight decimals."""
    rows.select(*[F.format_string("%.8f", F.col(c)).alias(c) for c in "xyz"]).write.mode("overwrite").csv(path, header=True)


def manifest(compared: DataFrame, path: str) -> int:
    """JSON rows with sorted keys; 2 if a report failed, else 0."""
    compared.select(*sorted(compared.columns)).write.mode("overwrite").json(path)
    return 2 if compared.where("status = 'FAIL'").limit(1).count() else 0


def envelopes(rows: DataFrame, path: str) -> None:
    """One JSON document a request."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def health(spark) -> dict[str, bool | str]:
    """What a run needs and whether it is there."""
    import importlib.util

    found = {name: importlib.util.find_spec(name) is not None for name in ("numpy", "pandas", "pyarrow", "yaml")}
    return {"spark": spark.version, **found}
