"""River gauge readings: trend, level class, condition labels, river names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.operators.ranking import first_per_group
from riffle.operators.windows import closest_in_time, trailing_means

LEVEL_TREND_M = 0.05
DISCHARGE_TREND_PCT = 2.0


def level_trend(now: Column, ref: Column) -> Column:
    d = now - ref
    return F.when(d > LEVEL_TREND_M, "rising").when(d < -LEVEL_TREND_M, "falling").when(
        d.isNotNull(), "stable")


def discharge_trend(now: Column, ref: Column) -> Column:
    pct = F.when(ref != 0, (now - ref) / F.abs(ref) * 100)
    return F.when(pct > DISCHARGE_TREND_PCT, "rising").when(
        pct < -DISCHARGE_TREND_PCT, "falling").when(pct.isNotNull(), "stable")


def level_class(discharge: Column, discharge_mean: Column, level: Column,
                level_mean: Column) -> Column:
    """Against the trailing mean: by ratio of discharge, or by height where there is none."""
    ratio = F.when(discharge_mean > 0, discharge / discharge_mean)
    delta = F.when(level_mean > 0, level - level_mean)
    by_level = F.when(delta > 0.1, "elevated").when(delta < -0.1, "low").otherwise("normal")
    return (
        F.when(ratio > 1.15, "elevated").when(ratio < 0.85, "low")
        .when(ratio.isNotNull(), "normal").otherwise(by_level)
    )


def condition(cls: Column, trend: Column) -> Column:
    """One of nine labels; a class that is off normal needs a known trend to be named."""
    named = cls.isin("elevated", "low") & trend.isin("rising", "falling", "stable")
    head = F.when(named, cls).otherwise("normal")
    tail = F.when(named | trend.isin("rising", "falling"), trend).otherwise("stable")
    return F.concat(head, F.lit(" and "), tail)


# Advice per (class, trend); None stands for any other trend.
ADVICE = [
    ("elevated", "rising", "Rising, elevated water — fish tight to structure, avoid main current, "
                           "try slower backwater areas. Clarity likely reduced."),
    ("elevated", "falling", "Dropping from elevated — often a productive window as fish become "
                            "active in cleaner water."),
    ("elevated", None, "High, stable flow — fish are pushed to edges and structure. "
                       "Target slack water behind boulders or inside bends."),
    ("low", "falling", "Low and dropping — fish are stressed and concentrated in deeper pools. "
                       "Pressure carefully."),
    ("low", None, "Low, stable flow — fish are holding in the deepest available water. "
                  "Downsize gear and approach slowly."),
    (None, "rising", "Rising but not yet elevated — fish may be starting to move. "
                     "Worth monitoring; conditions can change quickly."),
    (None, "falling", "Dropping from normal — conditions are stabilizing. "
                      "Fishing is often improving as water clears."),
    (None, None, "Normal stable flow — standard conditions for this system."),
]


def advice(cls: Column, trend: Column) -> Column:
    arms = []
    for c, t, text in ADVICE:
        hit = F.lit(True)
        hit = hit & (cls == c) if c else hit
        hit = hit & (trend == t) if t else hit
        arms.append(F.when(F.coalesce(hit, F.lit(False)), F.lit(text)))
    return F.coalesce(*arms)


def river_name(station: str | Column) -> Column:
    """The part before AT, NEAR, BELOW or ABOVE (looked for in that order), in title case."""
    c = F.col(station) if isinstance(station, str) else station
    out = None
    for word in (" AT ", " NEAR ", " BELOW ", " ABOVE "):
        at = F.instr(F.upper(c), word)
        arm = F.initcap(F.substring(c, F.lit(1), at - 1))
        out = F.when(at > 0, arm) if out is None else out.when(at > 0, arm)
    return out


def labelled(readings: DataFrame, hours_back: int = 3) -> DataFrame:
    """Every reading with its trends, level class, label and advice."""
    ref = closest_in_time(readings, "station_id", "ts", "reading_id", hours_back * 3600,
                          ["level_m", "discharge_cms"], "ref_")
    out = trailing_means(ref, "station_id", "ts", {
        "level_mean": "level_m", "discharge_mean": "discharge_cms"})
    return with_labels(out)


def with_labels(out: DataFrame) -> DataFrame:
    out = out.withColumns({
        "level_trend": level_trend(F.col("level_m"), F.col("ref_level_m")),
        "discharge_trend": discharge_trend(F.col("discharge_cms"), F.col("ref_discharge_cms")),
        "level_class": level_class(F.col("discharge_cms"), F.col("discharge_mean"),
                                   F.col("level_m"), F.col("level_mean")),
    })
    trend = F.coalesce("discharge_trend", "level_trend")
    return out.withColumns({
        "condition_note": condition(F.col("level_class"), trend),
        "fishing_note": advice(F.col("level_class"), trend)})


def whole_window_means(readings: DataFrame) -> DataFrame:
    """Means over all fetched readings of a station instead of the trailing day."""
    means = readings.groupBy("station_id").agg(
        F.avg("level_m").alias("level_mean"), F.avg("discharge_cms").alias("discharge_mean"))
    return readings.join(means, "station_id")


def latest(readings: DataFrame) -> DataFrame:
    return first_per_group(readings, ["station_id"], [F.desc("ts"), F.col("reading_id")])


def stream_conditions(readings: DataFrame, stations: DataFrame, lat: float, lng: float,
                      radius_km: float = 50.0, max_stations: int = 3) -> DataFrame:
    """Latest labelled reading of the nearest gauges."""
    km = geo.haversine_km(F.lit(lat), F.lit(lng), "lat", "lng")
    near = (
        stations.where(geo.near("lat", "lng", lat, lng, radius_km)).withColumn("distance_km", km)
        .orderBy("distance_km", "station_id").limit(max_stations)
    )
    mine = readings.join(F.broadcast(near.select("station_id")), "station_id", "left_semi")
    return latest(labelled(mine)).join(F.broadcast(near), "station_id").withColumn(
        "distance_km", F.round("distance_km", 1)).orderBy("distance_km", "station_id")
