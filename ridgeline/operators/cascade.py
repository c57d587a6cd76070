"""First success over ranked attempts, with the log of what came before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Outcomes after which the next provider is tried; any other outcome decides.
PASSED_OVER = ("NO_COVERAGE", "TRANSIENT")


def first_decisive(attempts: DataFrame, key: str, rank: str = "rank", outcome: str = "outcome") -> DataFrame:
    """(key, winner, outcome, attempts, retryable): the least rank whose outcome is not passed over.

    An unreliable geometry decides too, as a failure: later providers are not asked. winner is null when
    all were passed over. attempts counts those made; retryable tells whether one of them was transient.
    """
    decides = ~F.col(outcome).isin(*PASSED_OVER)
    least = F.min(F.when(decides, F.col(rank)))
    made = attempts.groupBy(key).agg(
        least.alias("winner"),
        F.min_by(F.when(decides, F.col(outcome)), F.when(decides, F.col(rank))).alias("outcome"),
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(outcome).alias("o")))).alias("log"),  # one row per provider
    )
    log = F.filter("log", lambda x: F.col("winner").isNull() | (x["r"] <= F.col("winner")))
    return made.select(
        key, "winner", F.coalesce("outcome", F.lit("BUILDING_FOOTPRINT_NOT_FOUND")).alias("outcome"),
        F.size(log).cast("bigint").alias("attempts"), F.exists(log, lambda x: x["o"] == "TRANSIENT").alias("retryable"),
    )


def all_failures_in(codes: str, allowed: list[str]):
    """Whether a non-empty array of codes holds none but these."""
    return (F.size(codes) > 0) & (F.size(F.array_except(codes, F.array(*map(F.lit, allowed)))) == 0)
