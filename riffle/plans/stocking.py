"""Stocking history: rollup per water body, fishery classification, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions.predicates import contains_ci, optional
from riffle.operators.ranking import top_per_group

# Life stages.
PUT_AND_TAKE_STAGES = ["yearling", "yearlings", "adult", "adults", "catchable"]
EARLY_STAGES = ["fry", "fingerling", "fingerlings", "fry or fingerling"]


def search(records: DataFrame, name: str | None = None, species: str | None = None,
           lat: float | None = None, lng: float | None = None, radius_km: float = 50.0,
           year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    return records.where(optional(
        name=contains_ci("waterbody_name", name) if name else None,
        species=contains_ci("species", species) if species else None,
        place=geo.near("lat", "lng", lat, lng, radius_km) if lat is not None and lng is not None
        else None,
        year_from=F.col("year") >= year_from if year_from is not None else None,
        year_to=F.col("year") <= year_to if year_to is not None else None,
    ))


def classify(asof_year: int) -> dict[str, Column]:
    stage = F.lower("life_stage")
    early = F.coalesce(stage.isin(EARLY_STAGES) | (stage == ""), F.lit(True))
    return {
        "is_put_and_take": F.coalesce(
            F.bool_or((F.col("year") >= asof_year - 3) & stage.isin(PUT_AND_TAKE_STAGES)),
            F.lit(False)),
        "wild_population_likely": (F.max("year") < asof_year - 5) & F.bool_and(early),
    }


def waterbodies(records: DataFrame, asof_year: int, limit: int | None = None) -> DataFrame:
    """One row per water body, most recently stocked first."""
    rolled = records.groupBy("waterbody_name").agg(
        F.count("*").alias("event_count"), F.max("year").alias("most_recent_year"),
        F.sum("quantity").alias("total_quantity"),
        F.array_sort(F.collect_set("species")).alias("species_stocked"),
        F.array_sort(F.collect_set("life_stage")).alias("life_stages"),
        *[c.alias(n) for n, c in classify(asof_year).items()])
    total = rolled.agg(F.count("*")).scalar()
    out = rolled.orderBy(F.desc("most_recent_year"), "waterbody_name")
    return (out.limit(limit) if limit else out).withColumn("total_found", total)


def latest_events(records: DataFrame, key: str = "record_id", k: int = 5) -> DataFrame:
    return top_per_group(records, ["waterbody_name"], [F.desc("year"), F.col(key)], k, "event_rank")


def note(asof_year: int) -> Column:
    """One sentence per water body from the rollup columns."""
    species = F.when(F.size("species_stocked") > 0, F.array_join("species_stocked", " and ")
                     ).otherwise("unknown species")
    stages = F.when(F.size("life_stages") > 0, F.array_join("life_stages", ", ")
                    ).otherwise("unknown stage")
    quantity = F.when(F.coalesce("total_quantity", F.lit(0)) > 0, F.concat(
        F.lit(" ("), F.format_number("total_quantity", 0), F.lit(" fish total)"))).otherwise("")
    name, year = F.col("waterbody_name"), F.col("most_recent_year").cast("string")
    recent = F.concat(name, F.lit(" was stocked with "), stages, F.lit(" "), species,
                      F.lit(" as recently as "), year, quantity)
    return (
        F.when(F.col("is_put_and_take"), F.concat(recent, F.lit(
            ". This is a put-and-take fishery — fish availability typically peaks in spring shortly "
            "after stocking events. These are hatchery fish, not a wild self-sustaining population."
        )))
        .when(F.col("wild_population_likely"), F.concat(
            name, F.lit(" was last stocked with "), stages, F.lit(" "), species, F.lit(" in "), year,
            quantity, F.lit(
                ". Stocking was early-stage only and more than 5 years ago — if fish are present "
                "today, they likely represent a self-sustaining wild population, though this is "
                "inferred from stocking history and not confirmed by a recent survey.")))
        .when(F.col("most_recent_year") > asof_year - 5, F.concat(recent, F.lit(
            ". Stocking was early-stage only — too recent to determine whether a self-sustaining "
            "population has established.")))
        .otherwise(F.concat(name, F.lit(" has stocking records for "), species, F.lit(" ("), stages,
                            F.lit("), most recently in "), year, quantity, F.lit(".")))
    )
