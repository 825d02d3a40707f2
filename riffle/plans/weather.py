"""Weather: trends, date choices, conditions at a place and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions.geo import col, jurisdiction
from riffle.operators.windows import closest_in_time

STEADY_HPA = 1.5


def trend(now: Column, before: Column) -> Column:
    d = now - before
    return F.when(d > STEADY_HPA, "rising").when(d < -STEADY_HPA, "falling").otherwise("steady")


def tomorrow(asof) -> Column:
    return F.date_add(col(asof), 1)


def days_ahead(asof, n: int) -> Column:
    return F.date_add(col(asof), n)


def next_weekend(asof) -> tuple[Column, Column]:
    """The first Saturday strictly after the date, and the day after it."""
    saturday = F.next_day(col(asof), "Sat")
    return saturday, F.date_add(saturday, 1)


def forecast_days(forecast: DataFrame, asof: str, when: str) -> DataFrame:
    """Forecast rows (day) picked by 'tomorrow', 'weekend' or a date text."""
    day = F.to_date(F.lit(asof))
    if when == "tomorrow":
        return forecast.where(F.col("day") == tomorrow(day))
    if when in ("weekend", "this_weekend"):
        sat, sun = next_weekend(day)
        return forecast.where(F.col("day").isin(sat, sun))
    return forecast.where(F.col("day") == F.to_date(F.lit(when)))


def pressure_trends(hourly: DataFrame, place: str = "place_id") -> DataFrame:
    """Per reading the change over 24 and 48 hours; without an earlier reading the change is 0.

    ``hourly`` has place, ts, reading_id and pressure.
    """
    out = hourly
    for hours in (24, 48):
        out = closest_in_time(out, place, "ts", "reading_id", hours * 3600, ["pressure"], f"p{hours}_")
    p = F.col("pressure")
    p24, p48 = F.coalesce("p24_pressure", p), F.coalesce("p48_pressure", p)
    return out.withColumns({
        "delta_24h": F.round(p - p24, 1), "delta_48h": F.round(p - p48, 1), "trend": trend(p, p24),
    }).drop("p24_pressure", "p48_pressure")


def conditions(payload: DataFrame) -> DataFrame:
    """Flat row of the current conditions of a place (lat, lng, current struct)."""
    c = lambda f: F.col(f"current.{f}").cast("double")
    return payload.select(
        "lat", "lng", F.col("current.time").cast("timestamp").alias("observed_at"),
        c("temperature_2m").alias("temperature_c"), c("relative_humidity_2m").alias("humidity_pct"),
        c("precipitation").alias("precipitation_mm"), c("wind_speed_10m").alias("wind_kmh"),
        c("surface_pressure").alias("pressure_hpa"), c("cloud_cover").alias("cloud_pct"),
        F.col("current.weather_code").cast("int").alias("weather_code"),
        jurisdiction("lat", "lng").alias("jurisdiction"))
