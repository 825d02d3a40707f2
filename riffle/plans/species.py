"""Species names, ranges and conservation status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions.predicates import contains_ci
from riffle.operators.aggregates import lookup, prediction_rollup
from riffle.operators.ranking import severity

# Names of the modelled species.
COMMON_NAMES = {
    "Semotilus atromaculatus": "Creek Chub",
    "Lepomis gibbosus": "Pumpkinseed",
    "Perca flavescens": "Yellow Perch",
    "Ameiurus nebulosus": "Brown Bullhead",
    "Catostomus commersonii": "White Sucker",
    "Culaea inconstans": "Brook Stickleback",
    "Etheostoma caeruleum": "Rainbow Darter",
    "Ambloplites rupestris": "Rock Bass",
    "Micropterus nigricans": "Smallmouth / Largemouth Bass (pooled)",
}
AT_RISK = ["Threatened", "Endangered", "Special Concern", "Extirpated"]
PROTECTED = ["Threatened", "Endangered"]
STATUSES = ["Not at Risk", "Special Concern", "Threatened", "Endangered", "Extirpated", "No Status"]
DEFAULT_GUIDANCE = "Release immediately. Do not target. Report sightings to MNRF at 1-877-TIPS-MNR."
ONTARIO = (41.7, 56.9, -95.2, -74.3)


def common_name(c: Column) -> Column:
    """Common name of a modelled species, any other name unchanged."""
    return F.coalesce(lookup({k.lower(): v for k, v in COMMON_NAMES.items()}, F.lower(c)), c)


def scientific_name(c: Column, passthrough: bool = True) -> Column:
    """Scientific name for either spelling; unknown names pass through or become null."""
    names = {v.lower(): k for k, v in COMMON_NAMES.items()}
    names.update({k.lower(): k for k in COMMON_NAMES})
    found = lookup(names, F.lower(c))
    return F.coalesce(found, c) if passthrough else found


def resolve(name: str) -> str:
    low = name.lower()
    for sci, common in COMMON_NAMES.items():
        if low in (sci.lower(), common.lower()):
            return sci
    return name


def species_range(ranges: DataFrame, name: str, lat: float | None = None,
                  lng: float | None = None) -> DataFrame:
    """First species whose name contains the text, with alert and plausibility flags."""
    alert = F.coalesce(F.col("sara_status").isin(PROTECTED), F.lit(False)) | F.coalesce(
        F.col("ontario_status").isin(PROTECTED), F.lit(False))
    plausible = F.lit(None).cast("boolean")
    if lat is not None and lng is not None:
        inside = ONTARIO[0] <= lat <= ONTARIO[1] and ONTARIO[2] <= lng <= ONTARIO[3]
        plausible = F.lit(inside) & F.array_contains("jurisdictions_present", "CA-ON")
    return (
        ranges.where(contains_ci("species", name)).orderBy("species").limit(1)
        .withColumns({"sar_alert": alert, "is_plausible_at_location": plausible})
    )


def at_risk(ranges: DataFrame, jurisdiction: str | None = "CA-ON") -> DataFrame:
    """Species with a listed status, most severe first."""
    listed = F.col("sara_status").isin(AT_RISK) | F.col("ontario_status").isin(AT_RISK)
    rows = ranges.where(listed)
    if jurisdiction:
        rows = rows.where(F.exists("jurisdictions_present", lambda j: j.contains(jurisdiction)))
    effective = F.coalesce(F.nullif("sara_status", F.lit("")), F.col("ontario_status"),
                           F.lit("No Status"))
    effective = F.when(effective.isin(STATUSES), effective).otherwise("No Status")
    protected = F.coalesce(F.col("sara_status").isin(PROTECTED), F.lit(False)) | F.coalesce(
        F.col("ontario_status").isin(PROTECTED), F.lit(False))
    guidance = F.lit(DEFAULT_GUIDANCE)
    if "fishing_notes" in ranges.columns:
        guidance = F.coalesce(F.nullif("fishing_notes", F.lit("")), guidance)
    out = rows.withColumns({"sara_status": effective, "is_protected": protected,
                            "handling_guidance": guidance})
    return out.withColumn("severity", severity("sara_status")).orderBy("severity", "species")


def species_predictions(predictions: DataFrame, lat: float, lng: float, radius_km: float = 10.0,
                        species: str | None = None, min_probability: float = 0.0) -> DataFrame:
    """Rollup of predicted presence around a place, best mean first."""
    from riffle.functions import geo

    rows = predictions.where(
        geo.near("lat", "lng", lat, lng, radius_km) & (F.col("prob") >= min_probability))
    if species:
        rows = rows.where(F.lower("species") == resolve(species).lower())
    return prediction_rollup(rows).withColumn("common_name", common_name(F.col("species"))).orderBy(
        F.desc("mean_probability"), "species")
