"""Filter conditions and row checks shared by the questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.geo import all_of, any_of, col

# Labels the checks accept.
JURISDICTION_PATTERN = r"^[A-Z]{2}-[A-Z0-9]{1,3}$"
CONFIDENCE_LEVELS = ["confirmed", "anecdotal", "unverified"]
NON_FISHABLE = ["ditch", "drain"]
OCCURRENCE_BASIS = [
    "FOSSIL_SPECIMEN", "LITERATURE", "LIVING_SPECIMEN", "MACHINE_OBSERVATION", "MATERIAL_SAMPLE",
    "PRESERVED_SPECIMEN",
]
HABITAT_COLUMNS = [
    "substrate_category", "thermal_regime", "summer_mean_temp_c", "do_median_mgl", "ph_median",
    "conductivity_median_us_cm", "ept_quality", "ept_proportion", "barrier_count_upstream",
]


def contains_ci(c, text: str) -> Column:
    return F.lower(col(c)).contains(text.strip().lower())


def contains_any_ci(columns, texts) -> Column:
    return any_of(contains_ci(c, t) for c in columns for t in texts)


def equals_ci(c, text: str) -> Column:
    return F.lower(col(c)) == text.lower()


def optional(**parts: Column | None) -> Column:
    """AND of the conditions that were given; true when none was."""
    return all_of(p for p in parts.values() if p is not None)


def since(c, asof: str, days: int, keep_null: bool = False) -> Column:
    cond = col(c) >= F.date_sub(F.to_date(F.lit(asof)), days)
    return (col(c).isNull() | cond) if keep_null else cond


def at_most(c, limit: float) -> Column:
    """Null passes: an unknown uncertainty is not a reason to drop a record."""
    return col(c).isNull() | (col(c) <= limit)


def at_least_if_known(c, limit: float) -> Column:
    return col(c).isNull() | (col(c) >= limit)


def real_coordinates(lat="lat", lng="lng") -> Column:
    """Both present and neither zero."""
    return col(lat).isNotNull() & col(lng).isNotNull() & (col(lat) != 0) & (col(lng) != 0)


def likely_culverted(order, density) -> Column:
    o, d = col(order), col(density)
    return F.coalesce(((o <= 3) & (d > 150)) | ((o <= 2) & (d > 50)), F.lit(False))


def outside_map_region(lat, lng, kind) -> Column:
    """Rows the map leaves out: the urban south-west corner, the far south and north, and
    connector lines through lakes."""
    la, lo = col(lat), col(lng)
    return (
        ((la < 43.20) & (lo > -79.90)) | (la < 42.80) | (la > 46.40)
        | F.coalesce(col(kind) == "Virtual Flow", F.lit(False))
    )


def first_reason(checks: dict[str, Column]) -> Column:
    """Name of the first failing check, null for a good row. Each condition says what is wrong."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])


def water_quality_faults() -> dict[str, Column]:
    return {
        "ph out of range": ~F.col("ph").between(0, 14),
        "negative dissolved oxygen": F.col("do_mgl") < 0,
        "temperature out of range": ~F.col("temp_c").between(-5, 40),
    }


def zone_faults(zone="zone") -> dict[str, Column]:
    return {"zone out of range": ~col(zone).between(1, 20)}


def text_faults(*columns: str) -> dict[str, Column]:
    return {f"blank {c}": F.coalesce(F.trim(F.col(c)) == "", F.lit(True)) for c in columns}


def label_faults(c, allowed) -> dict[str, Column]:
    return {f"unknown {c}": ~F.col(c).isin(*allowed)}


def habitat_known(columns=HABITAT_COLUMNS, dtypes: dict[str, str] | None = None) -> Column:
    """Every habitat column measured: not null, and not the text 'unknown'."""
    parts = []
    for c in columns:
        ok = F.col(c).isNotNull()
        if dtypes is None or dtypes.get(c) == "string":
            ok = ok & (F.col(c).cast("string") != "unknown")
        parts.append(ok)
    return F.coalesce(all_of(parts), F.lit(False))
