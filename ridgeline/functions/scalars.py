"""Row-level rules that several stages share, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import DEFAULTS, Thresholds

#: License texts that mean "not confirmed".
PENDING = ("", "PENDING", "PENDING_AGENCY_CONFIRMATION", "UNKNOWN")


def year_age(day: Column, as_of: Column) -> Column:
    """Whole years from day to as_of, at least 0; a birthday on 29 February is not reached on the 28th."""
    short = F.struct(F.month(as_of), F.dayofmonth(as_of)) < F.struct(F.month(day), F.dayofmonth(day))
    return F.greatest(F.lit(0), F.year(as_of) - F.year(day) - F.when(short, 1).otherwise(0))


def license_verified(text: Column) -> Column:
    return ~F.upper(F.trim(F.coalesce(text, F.lit("")))).isin(*PENDING)


def county_name(text: Column) -> Column:
    """Without the word County; one county has a fixed spelling."""
    plain = F.trim(F.regexp_replace(F.trim(text), r"(?i)\s+County$", ""))
    return F.when(F.lower(F.regexp_replace(plain, r"\s", "")) == "desoto", F.lit("DeSoto")).otherwise(plain)


def percent_change(value: Column, reference: Column, least: float = 0.01) -> Column:
    return F.abs(value - reference) / F.greatest(reference, F.lit(least)) * 100


def percent_error(actual: Column, expected: Column) -> Column:
    return F.try_divide(F.abs(actual - expected), expected) * 100


def quality_number(raw: Column, at_most: float | None = None) -> Column:
    """A variant's or text's non-negative finite number, else null; booleans and blanks are no numbers.

    ``raw`` is text as JSON shows it (true, "0.5", 0.5, null, [..]).
    """
    bare = F.trim(F.regexp_replace(raw, r'^"(.*)"$', "$1"))
    value = F.when(~F.lower(bare).isin("true", "false", "null", ""), bare.try_cast("double"))
    good = (value >= 0) & ~F.isnan(value) & (value < float("inf"))
    return F.when(good if at_most is None else good & (value <= at_most), value)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def quality_confidence(density: Column, nodata: Column, rmse: Column, t: Thresholds = DEFAULTS) -> Column:
    parts = (
        F.least(F.lit(1.0), density / max(t.min_density * 1.5, 0.01)),
        clamp(1 - nodata / max(t.max_nodata_fraction, 0.001)),
        clamp(1 - rmse / max(t.max_rmse_m, 0.001)),
    )
    return parts[0] * 0.35 + parts[1] * 0.35 + parts[2] * 0.30


def combined_confidence(quality: Column, distance: Column, lidar_age: Column, reconciliation: Column, validated: Column, t: Thresholds = DEFAULTS) -> Column:
    age = F.greatest(F.lit(0.0), 1 - lidar_age / max(t.lidar_max_age_years, 1))
    match = F.greatest(F.lit(0.0), 1 - distance / max(t.footprint_max_distance_m, 0.01))
    temporal = F.when(validated, F.lit(1.0)).otherwise(age)
    return clamp(quality) * 0.55 + match * 0.10 + temporal * 0.10 + clamp(reconciliation) * 0.25


def reconciliation(area_percent: Column, pitch_gap: Column, t: Thresholds = DEFAULTS) -> Column:
    a = F.greatest(F.lit(0.0), 1 - area_percent / t.max_solar_area_percent)
    p = F.greatest(F.lit(0.0), 1 - pitch_gap / t.max_solar_pitch_degrees)
    return (a + p) / 2


def first_code(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds, in order; null if none does."""
    out = F.lit(None).cast("string")
    for broken, code in reversed(rules):
        out = F.when(broken, F.lit(code)).otherwise(out)
    return out


def all_codes(*rules: tuple[Column, str]) -> Column:
    """The codes of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))


def single(values: Column) -> Column:
    """The only element of an array, else null."""
    return F.when(F.size(values) == 1, values[0])


def pitch_class(rise: Column) -> Column:
    """Whole rise per 12; an exact half may sit a few ten-millionths low."""
    return F.floor(rise + 0.500001)


def packages(required: Column, coverage: Column) -> Column:
    return F.ceil(required / coverage - 1e-10).cast("bigint")


def plain_number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def serial_date(days: Column) -> Column:
    """Spreadsheet day number to date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(days).cast("int"))


def gps_dates(seconds: Column) -> Column:
    """Candidate dates of a GPS time: plain, and with the usual 1e9 offset."""
    day = lambda s: F.date_add(F.lit("1980-01-06").cast("date"), F.floor(s / 86400).cast("int"))
    return F.array(day(seconds), day(seconds + 1e9))


def epoch_date(*millis: Column) -> Column:
    """Date (UTC) of the first non-zero epoch milliseconds; null if none."""
    found = F.coalesce(*[F.nullif(m.try_cast("double"), F.lit(0.0)) for m in millis])
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(found / 86_400_000).cast("int"))


def content_id(value: Column, prefix: str = "geometry-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 24))
