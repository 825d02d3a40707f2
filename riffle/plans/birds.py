"""Fish-eating bird activity as a sign of fish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Species codes, what a sighting means, names used by the other source.
CODES = ["grbher3", "osprey1", "belkin1", "commer1", "doccor"]
SIGNIFICANCE = {
    "grbher3": "Active hunting indicates shallow fish-bearing water within foraging range",
    "osprey1": "Confirmed fish presence — osprey only hunt where fish are abundant and catchable",
    "belkin1": "Strong indicator of small fish in clear, accessible water",
    "commer1": "Diving pursuit predator — confirms fish present at depth in rivers and lakes",
    "doccor": "Colonial fish predator — high densities indicate productive fish habitat",
}
DEFAULT_SIGNIFICANCE = "Piscivore — indicates fish-bearing water"
NAME_TO_CODE = {
    "great blue heron": "grbher3", "osprey": "osprey1", "belted kingfisher": "belkin1",
    "common merganser": "commer1", "double-crested cormorant": "doccor",
}
SURE = ["osprey1", "commer1"]
LIKELY = ["grbher3", "belkin1"]


def piscivore_summary(birds: DataFrame, other: DataFrame) -> DataFrame:
    """Sightings per species code over both sources; ``other`` has species_code, observed_on."""
    both = birds.select(
        "species_code", F.lit(1).alias("e"), F.lit(0).alias("i"), "how_many", "observed_on"
    ).unionByName(other.where(F.col("species_code").isNotNull()).select(
        "species_code", F.lit(0).alias("e"), F.lit(1).alias("i"),
        F.lit(None).cast("int").alias("how_many"), "observed_on"))
    return both.groupBy("species_code").agg(
        F.sum("e").alias("ebird_sightings"), F.sum("i").alias("inat_sightings"),
        F.count("*").alias("total_sightings"), F.max("how_many").alias("max_count"),
        F.max("observed_on").alias("most_recent"))


def confidence(codes: Column) -> Column:
    """From the set of active codes."""
    has = lambda xs: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in xs]))
    return (
        F.when(has(SURE), "high").when(has(LIKELY), "moderate")
        .when(F.size(codes) > 0, "low").otherwise("none")
    )


def presence(summary: DataFrame) -> DataFrame:
    """One row over all codes; at most as many codes as there are tracked species."""
    codes = F.array_sort(F.collect_set("species_code"))
    return summary.agg(
        F.sum("total_sightings").alias("total_sightings"),
        F.max("most_recent").alias("most_recent"),
        F.count("*").alias("species_count"), confidence(codes).alias("confidence"))


# Sentence per code, in the order they are told.
NOTES = [
    ("osprey1", "Osprey recorded %d time(s) — strongest fish presence signal. "
                "Osprey only hunt where fish are at the surface and catchable."),
    ("commer1", "Common Merganser recorded %d time(s) — confirms fish at depth. "
                "Mergansers dive and pursue fish actively."),
    ("grbher3", "Great Blue Heron recorded %d time(s) — indicates shallow fish-bearing water. "
                "Herons forage widely; activity near a specific spot is a credible signal."),
    ("belkin1", "Belted Kingfisher recorded %d time(s) — confirms small fish in accessible water."),
    ("doccor", "Double-crested Cormorant recorded %d time(s) — productive fish habitat signal, "
               "though cormorants also target invertebrates."),
]


def habitat_note(summary: DataFrame, asof: str) -> DataFrame:
    """Counts in a fixed order, then how recent the latest sighting is."""
    n = lambda code: F.sum(F.when(F.col("species_code") == code, F.col("ebird_sightings")))
    wide = summary.agg(F.max("most_recent").alias("most_recent"),
                       *[n(code).alias(code) for code, _ in NOTES])
    days = F.datediff(F.to_date(F.lit(asof)), F.col("most_recent"))
    recency = F.when(days == 0, F.lit("today")).otherwise(
        F.concat(days.cast("string"), F.lit(" day(s) ago")))
    parts = [F.when(F.col(c) > 0, F.format_string(text, F.col(c))) for c, text in NOTES]
    return wide.select(
        *[F.col(c) for c, _ in NOTES], days.cast("bigint").alias("days_ago"),
        F.concat_ws(" ", *parts, F.concat(
            F.lit("Most recent observation: "), recency,
            F.lit(". Bird activity reflects conditions at time of sighting.")),
            F.lit("Absence of piscivore records does not confirm fish absence — observer coverage "
                  "varies.")).alias("habitat_note"))
