"""Requests as a stream: each micro-batch runs the same plan as a batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decision import request_problems

SCHEMA = "request_id string, schema_version string, longitude double, latitude double, outputs array<string>, reference_area double, reference_facets int, received timestamp"


def stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Request files as they arrive, each id once within the watermark, with its problems."""
    rows = spark.readStream.schema(SCHEMA).json(path).withWatermark("received", late)
    return request_problems(rows.dropDuplicatesWithinWatermark(["request_id"]))


def process(requests: DataFrame, measure: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Measure sound requests, reject the rest with their first problem; batches append under their own id."""

    def batch(rows: DataFrame, n: int) -> None:
        good = measure(rows.where(F.size("problems") == 0))
        bad = rows.where(F.size("problems") > 0).select("request_id", F.col("problems")[0].alias("code"))
        good.unionByName(bad, allowMissingColumns=True).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests by window of arrival and first problem: a watermarked count."""
    return events.withWatermark("received", late).groupBy(F.window("received", width), F.coalesce(F.get("problems", F.lit(0)), F.lit("OK")).alias("code")).count()
