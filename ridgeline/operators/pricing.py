"""Order quantities from a measured roof, and the audit of a price book."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_code, packages

#: Counties and materials that the price book must cover, its columns, and waste columns.
COUNTIES = ("Lee", "Collier", "Charlotte", "Sarasota", "Manatee", "Hendry", "Glades", "DeSoto")
MATERIALS = ("Shingle", "Tile", "Metal", "Flat-Mod bitumen", "Flat-TPO", "Flat-Rock")
REQUIRED = ("Profile ID", "Version", "Active", "County", "Roof Material", "Effective From", "Effective Through", "Pricing Readiness", "Material Rate Per Square", "Labor Rate Per Square", "Min Roof Squares", "Max Roof Squares")
WASTE = ("Simple Waste Percentage", "Hip Waste Percentage", "Complex Waste Percentage", "Highly Complex Waste Percentage")
RATES = re.compile(r"Rate Per |Charge Per |Percentage$|Allowance|Flat Fee$|Minimum Job Charge$")
POSITIVE = ("One Story Multiplier", "Two Story Multiplier", "Three Plus Story Multiplier", "Pitch/Slope Multiplier", "Remote Estimate Low Factor", "Remote Estimate High Factor", "Expiration Days")
EDGES = ("eavesFeet", "rakesFeet", "valleysFeet", "ridgesFeet", "hipsFeet")


def number(raw: Column) -> Column:
    """A finite number from a cell; blanks and booleans are none."""
    text = F.trim(raw.cast("string"))
    v = F.when(~F.lower(text).isin("", "true", "false"), text.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def active(raw: Column) -> Column:
    return F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit("")))).isin("yes", "true")


def cell_date(raw: Column) -> Column:
    """A date from ISO text or a spreadsheet's day number; blanks and other text give null."""
    serial = raw.try_cast("double")
    text = F.to_date(F.substring(raw, 1, 10).try_cast("date"))
    return F.coalesce(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")), text)


def header_problems(columns: list[str]) -> list[str]:
    out = [f"Missing pricebook column: {c}" for c in REQUIRED if c not in columns]
    return out + (["Duplicate pricebook headers."] if len(set(columns)) != len(columns) else [])


def audited(book: DataFrame, as_of: Column, position: str = "row") -> DataFrame:
    """Active rows of a price book (text cells, and a row number) with their issues and whether they are in effect.

    A profile id is a duplicate from its second row on. The last day of effect counts as a whole.
    """
    if problems := header_problems([c for c in book.columns if c != position]):
        raise ValueError("; ".join(problems))
    col = lambda c: F.col(f"`{c}`")
    blank = lambda c: F.coalesce(F.trim(col(c).cast("string")), F.lit("")) == ""
    rows = book.where(active(col("Active")))
    again = F.row_number().over(Window.partitionBy("Profile ID").orderBy(position)) > 1
    start, end = cell_date(col("Effective From")), cell_date(col("Effective Through"))
    low, high = number(col("Min Roof Squares")), number(col("Max Roof Squares"))
    rules = [
        (blank("Profile ID") | again, "Missing or duplicate profile ID"),
        (blank("Version"), "Missing version"),
        (~F.coalesce(col("Pricing Readiness") == "READY", F.lit(False)), "Profile is not READY"),
        (~F.coalesce(col("County").isin(*COUNTIES) & col("Roof Material").isin(*MATERIALS), F.lit(False)), "Unsupported county or roof material"),
    ]
    for c in book.columns:
        if c != position and RATES.search(c):
            rules.append((~F.coalesce(number(col(c)) >= 0, F.lit(False)), f"Invalid numeric field: {c}"))
    rules += [(~F.coalesce(number(col(c)) >= 0.000001, F.lit(False)), f"Invalid numeric field: {c}") for c in POSITIVE if c in book.columns]
    rules += [
        (start.isNull() | (~blank("Effective Through") & end.isNull()) | F.coalesce(end < start, F.lit(False)), "Invalid effective dates"),
        (~F.coalesce(low >= 0, F.lit(False)) | (~blank("Max Roof Squares") & ~F.coalesce(high >= 0, F.lit(False))), "Invalid numeric field: Roof Squares"),
        (F.coalesce(high <= low, F.lit(False)), "Invalid square range"),
    ]
    rows = rows.withColumn("issues", F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules])))
    return rows.withColumn("effective", (F.size("issues") == 0) & (start <= as_of) & (end.isNull() | (as_of <= end)))


def coverage(counties: DataFrame, materials: DataFrame, profiles: DataFrame) -> DataFrame:
    """(county, material, profiles, status) for every pair, by how many profiles are in effect there."""
    found = profiles.groupBy("county", "material").agg(F.count(F.lit(1)).alias("profiles"))
    cells = counties.select("county").distinct().crossJoin(F.broadcast(materials.select("material").distinct()))  # two short lists
    out = cells.join(found, ["county", "material"], "left")
    n = F.coalesce("profiles", F.lit(0))
    status = F.when(n == 0, "MISSING_APPROVED_PRICE").when(n == 1, "READY").otherwise("REVIEW_PROFILE_OVERLAP")
    return out.select("county", "material", n.cast("bigint").alias("profiles"), status.alias("status"))


def order_area(area: Column, waste: Column) -> Column:
    return area * (1 + waste / 100)


def package_counts(measured: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """measured(key, basis columns...) x specs(package, basis, coverage) -> (key, package, required, packages)."""
    bases = [c for c in measured.columns if c != key]
    pairs = ", ".join(f"'{b}', `{b}`" for b in bases)
    tall = measured.select(key, F.expr(f"stack({len(bases)}, {pairs}) AS (basis, required)"))
    return tall.join(F.broadcast(specs), "basis").select(key, "package", "required", packages(F.col("required"), F.col("coverage")).alias("packages"))


def facets_reconcile(facets: Column, total: Column) -> Column:
    """First code against facets(array of struct area, plan_area, pitch) that must add up to a roof."""
    import math

    slope = lambda f: f["plan_area"] / F.cos(f["pitch"] * math.pi / 180)
    gap = lambda f: F.abs(f["area"] - slope(f)) > F.greatest(F.lit(0.1), f["area"] * 0.05)
    area_sum = F.aggregate(facets, F.lit(0.0), lambda s, f: s + f["area"])
    return first_code(
        (facets.isNull() | (F.size(facets) == 0), "FACETS_REQUIRED"),
        (F.exists(facets, lambda f: f["pitch"] >= 90), "PITCH_TOO_STEEP"),
        (F.exists(facets, gap), "FACET_AREA_INCONSISTENT"),
        (F.abs(area_sum - total) > F.greatest(F.lit(0.1), total * 0.05), "FACET_TOTAL_MISMATCH"),
    )


def waste_percentage(profile: dict[str, Column], chosen: str | None) -> tuple[Column, Column]:
    """(waste, code): the chosen column's, or the simple one if all given columns agree."""
    if chosen is not None and chosen not in WASTE:
        raise ValueError(f"waste column {chosen!r}")
    value = number(profile[chosen or WASTE[0]])
    differ = F.lit(False)
    if chosen is None:
        for c in WASTE[1:]:
            if c in profile:
                differ = differ | F.coalesce(number(profile[c]) != value, F.lit(False))
    return value, first_code((differ, "WASTE_SELECTION_REQUIRED"), (value.isNull() | (value < 0), "WASTE_INVALID"), (value > 100, "WASTE_TOO_LARGE"))


def authorised(available: Column, pricing_allowed: Column, verification: Column, profile_active: Column, readiness: Column) -> Column:
    """Code unless the geometry may be priced and the profile is active and READY."""
    open_ = available.eqNullSafe(F.lit(True)) & pricing_allowed.eqNullSafe(F.lit(True)) & ~F.coalesce(verification == "INSPECTION_REQUIRED", F.lit(False))
    ready = active(profile_active) & F.coalesce(readiness == "READY", F.lit(False))
    return first_code((~open_, "GEOMETRY_NOT_AUTHORIZED"), (~ready, "PROFILE_NOT_READY"))


def quantities(roofs: DataFrame, chosen_waste: str | None = None) -> DataFrame:
    """roofs with geometry, profile and authorisation columns -> code, waste, order area and squares.

    Needs: available, pricing_allowed, verification, active, readiness, area, facets, the waste columns
    (snake case of WASTE), multiplier and the EDGES. The multiplier prices work; it changes no quantity.
    """
    names = {c: c.lower().replace(" ", "_") for c in WASTE}
    waste, waste_code = waste_percentage({c: F.col(n) for c, n in names.items() if n in roofs.columns}, chosen_waste)
    edge_bad = F.lit(False)
    for e in EDGES:
        edge_bad = edge_bad | ~F.coalesce(number(F.col(e)) >= 0, F.lit(False))
    code = F.coalesce(
        authorised(F.col("available"), F.col("pricing_allowed"), F.col("verification"), F.col("active"), F.col("readiness")),
        F.when(~F.coalesce(F.col("area") > 0, F.lit(False)), F.lit("AREA_REQUIRED")),
        facets_reconcile(F.col("facets"), F.col("area")),
        waste_code,
        F.when(~F.coalesce(number(F.col("multiplier")) > 0, F.lit(False)), F.lit("MULTIPLIER_INVALID")),
        F.when(edge_bad, F.lit("EDGE_LENGTH_INVALID")),
    )
    order = order_area(F.col("area"), waste)
    out = roofs.withColumn("code", code)
    good = F.col("code").isNull()
    return out.withColumns({"squares": F.when(good, F.col("area") / 100), "waste": F.when(good, waste), "order_area": F.when(good, order), "order_squares": F.when(good, order / 100)})
