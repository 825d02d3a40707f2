"""What measured water, bottom life and geology say about a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.operators.aggregates import benthic_area, exact_median, most_common
from riffle.operators.ranking import first_per_group


def water_quality_assessment(readings: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Conditions that rule species out, and notes, per group (or for all readings)."""
    keys = group or ["_all"]
    rows = readings if group else readings.withColumn("_all", F.lit(1))
    rows = rows.withColumn("summer_temp_c", F.when(
        F.month("sampled_at").isin(6, 7, 8), F.col("temp_c")))
    med = exact_median(rows, keys, ["do_mgl", "ph", "summer_temp_c", "conductivity_us_cm"])
    low = rows.groupBy(*keys).agg(F.min("do_mgl").alias("min_do"))
    x = med.join(low, keys)
    do, ph, temp, cond = (F.col(c) for c in ("do_mgl", "ph", "summer_temp_c", "conductivity_us_cm"))
    say = F.format_string
    ruling_out = F.array_compact(F.array(
        F.when(F.col("min_do") < 3, say(
            "DO below 3 mg/L recorded (min %.1f mg/L) — hypoxic conditions; most species implausible "
            "at these levels.", "min_do"))
        .when(do < 5, say("Median DO %.1f mg/L — coolwater and coldwater species implausible.", do)),
        F.when(ph < 5.5, say("Median pH %.1f — salmonid stress; acid-sensitive species (trout, many "
                             "darters) likely absent.", ph)),
        F.when(ph > 9.0, say("Median pH %.1f — alkaline stress; sensitive species likely excluded.",
                             ph)),
        F.when(temp > 26, say("Summer median temperature %.1f °C — thermal stress for most Ontario "
                              "species; even warmwater species stressed.", temp))
        .when(temp > 22, say("Summer median temperature %.1f °C — coldwater species implausible; "
                             "warmwater species (bass, pike, carp) plausible.", temp))))
    notes = F.array_compact(F.array(
        F.when((F.col("min_do") >= 3) & (do >= 5), say(
            "Median DO %.1f mg/L — adequate for most Ontario species.", do)),
        F.when(ph.between(5.5, 9.0), say(
            "Median pH %.1f — within typical Ontario species tolerance range.", ph)),
        F.when(temp <= 22, say("Summer median temperature %.1f °C — suitable for coolwater species; "
                               "marginal for obligate coldwater.", temp)),
        F.when(cond.isNotNull(), say("Median conductivity %.0f μS/cm.", cond))))
    out = x.select(*keys, ruling_out.alias("ruling_out"), notes.alias("notes"))
    return out if group else out.drop("_all")


def benthic_assessment(samples: DataFrame) -> DataFrame:
    s = benthic_area(samples)
    p = F.col("mean_prop")
    pct = lambda c: F.format_string("%.0f%%", c * 100)
    high = F.col("high") / F.col("visit_count")
    bad = F.col("impaired") / F.col("visit_count")
    head = F.concat(F.lit("Mean EPT proportion "), pct(p))
    notes = F.array_compact(F.array(
        F.concat(head, F.when(p >= 0.5, " — predominantly high-quality benthic habitat. Clean gravel "
                                        "substrate with strong EPT community.")
                 .when(p >= 0.25, " — moderate benthic habitat quality. EPT community present but "
                                  "pollution-tolerant taxa are significant.")
                 .otherwise(" — impaired benthic community. Pollution-tolerant taxa (Chironomidae, "
                            "Oligochaeta) dominant.")),
        F.when(high >= 0.5, F.concat(pct(high), F.lit(" of sampled sites rated 'high' quality."))),
        F.when(bad >= 0.5, F.concat(pct(bad), F.lit(" of sampled sites rated 'impaired'.")))))
    implied = (
        F.when(p >= 0.5, "Coldwater and clean-water species (brook trout, darters, redhorse) are "
                         "plausible. Substrate and thermal data would further constrain predictions.")
        .when(p >= 0.25, "Coolwater generalist species plausible. Sensitive taxa (brook trout) are "
                         "marginal.")
        .otherwise("Sensitive species (darters, redhorse, trout) are unlikely. Tolerant warmwater "
                   "species (carp, bullhead, suckers) most plausible."))
    return s.select("visit_count", "site_count", "mean_ept_proportion", notes.alias("notes"),
                    implied.alias("species_implications"))


def latest_site_rows(samples: DataFrame) -> DataFrame:
    """Newest visit per site with the years spanned and the number of visits."""
    newest = first_per_group(samples, ["site_code"], [F.desc("sampled_year"), F.col("site_visit_id")])
    span = samples.groupBy("site_code").agg(
        F.count("*").alias("visit_count"), F.min("sampled_year").alias("first_year"),
        F.max("sampled_year").alias("last_year"))
    return newest.join(span, "site_code")


def substrate_at(units: DataFrame, lat: float, lng: float, radius_km: float = 10.0,
                 reach_deg: float = 1.0) -> DataFrame:
    """Nearest unit within one degree, and the make-up of the units around the point."""
    d = geo.euclid("lat", "lng", F.lit(lat), F.lit(lng))
    nearest = units.where(geo.in_box("lat", "lng", lat, lng, reach_deg)).orderBy(
        d, "unit_id").limit(1)
    around = units.where(geo.near("lat", "lng", lat, lng, radius_km))
    dominant = most_common(around, [], "substrate_class")
    total = around.agg(F.count("*")).scalar()
    top = dominant.select("substrate_class").scalar()
    return nearest.select(
        "unit_id", "substrate_class", total.alias("units_nearby"),
        F.coalesce(top, F.col("substrate_class")).alias("dominant_class"))


def confidence_tier(n: Column) -> Column:
    return F.when(n >= 50, "high").when(n >= 15, "medium").otherwise("low")


def thermal_area(summaries: DataFrame) -> DataFrame:
    """Most common known regime; the smallest name wins ties."""
    return most_common(summaries.where("thermal_regime <> 'unknown'"), [], "thermal_regime")
