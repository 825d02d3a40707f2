"""Gauge readings as a stream: duplicates out, late data out, trends from per-station state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETENTION = "7 days"
RETENTION_S = 7 * 24 * 3600
WINDOW_S = 24 * 3600
TREND_BACK_S = 3 * 3600
OUT = ("station_id bigint, reading_id bigint, ts timestamp, level_m double, discharge_cms double, "
       "ref_level_m double, ref_discharge_cms double, level_mean double, discharge_mean double, seq bigint")
STATE = "ts array<bigint>, reading_id array<bigint>, level array<double>, discharge array<double>, seq bigint"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None,
                pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def deduplicated(readings: DataFrame, station: str = "station_id", ts: str = "ts",
                 retention: str = RETENTION) -> DataFrame:
    """First copy of each (station, instant). The watermark also bounds how long late rows are
    taken: anything older than the retention is dropped."""
    return readings.withWatermark(ts, retention).dropDuplicatesWithinWatermark([station, ts])


def labels_of(ts: np.ndarray, level: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Reference level and flow and trailing-day means of one station's readings, a row for each.

    ``ts`` (microseconds) ascends, equal instants in order of reading_id. The reference is the earlier
    reading nearest to three hours before (ties: the earlier one, then the first of its instant); the
    trailing day includes both ends. Missing values are NaN.
    """
    n = len(ts)
    target = ts - TREND_BACK_S * 1_000_000
    earlier = np.searchsorted(ts, ts, "left")
    right = np.searchsorted(ts, target, "left")
    left = right - 1
    gap_right = np.where(right < earlier, ts[np.minimum(right, n - 1)] - target, np.iinfo(np.int64).max)
    pick = np.where((left >= 0) & (target - ts[np.maximum(left, 0)] <= gap_right), left, np.where(right < earlier, right, -1))
    first = np.searchsorted(ts, ts[np.maximum(pick, 0)], "left")
    lo, hi = np.searchsorted(ts, ts - WINDOW_S * 1_000_000, "left"), np.searchsorted(ts, ts, "right")
    out = []
    for x in (level, flow):
        out.append(np.where(pick >= 0, x[first], np.nan))
    for x in (level, flow):
        known = ~np.isnan(x)
        sums, counts = (np.concatenate([[0], np.cumsum(v)]) for v in (np.where(known, x, 0.0), known))
        many = counts[hi] - counts[lo]
        out.append(np.where(many > 0, (sums[hi] - sums[lo]) / np.maximum(many, 1), np.nan))
    return np.column_stack(out)


def _labels(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Rows for the new readings of one station, and anew for older ones whose labels they change.

    The state keeps the readings that a row within the retention can still need: those of the
    retention and one day before, and the last one before that.
    """
    if state.hasTimedOut:
        state.remove()
        return
    new = pd.concat(list(batches))
    old = [np.asarray(x, dtype=float if i in (2, 3) else np.int64) for i, x in enumerate(state.get[:4])] if state.exists else [
        np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    seq = (state.get[4] if state.exists else 0) + 1
    fresh = [new["ts"].astype("datetime64[us]").astype("int64").to_numpy(), new["reading_id"].to_numpy(np.int64),
             new["level_m"].to_numpy(float), new["discharge_cms"].to_numpy(float)]
    ts, rid, level, flow = (np.concatenate(x) for x in zip(old, fresh))
    was = np.full((len(ts), 4), np.nan)
    was[:len(old[0])] = labels_of(old[0], *old[2:])
    is_new = np.arange(len(ts)) >= len(old[0])
    order = np.lexsort((rid, ts))
    ts, rid, level, flow, was, is_new = (x[order] for x in (ts, rid, level, flow, was, is_new))
    now = labels_of(ts, level, flow)
    send = is_new | ~(np.isclose(now, was, rtol=1e-12, atol=0, equal_nan=True).all(axis=1))
    mark = state.getCurrentWatermarkMs() * 1000
    keep = max(0, int(np.searchsorted(ts, mark - WINDOW_S * 1_000_000)) - 1) if mark > 0 else 0
    state.update((ts[keep:].tolist(), rid[keep:].tolist(), level[keep:].tolist(), flow[keep:].tolist(), seq))
    state.setTimeoutTimestamp(max(int(ts[-1]) // 1000 + (RETENTION_S + WINDOW_S) * 1000, state.getCurrentWatermarkMs() + 1))
    # a row at the edge of the state lacks what went before it; it cannot change any more
    send[:1] &= is_new[:1] | (keep == 0)
    out = pd.DataFrame({"station_id": key[0], "reading_id": rid[send], "ts": pd.to_datetime(ts[send], unit="us"), "level_m": level[send],
                        "discharge_cms": flow[send]})
    out[["ref_level_m", "ref_discharge_cms", "level_mean", "discharge_mean"]] = now[send]
    out["seq"] = seq
    yield out.astype(object).where(out.notna(), None).astype({"station_id": "int64", "reading_id": "int64", "seq": "int64", "ts": "datetime64[us]"})


def with_trends(readings: DataFrame, retention: str = RETENTION) -> DataFrame:
    """Each reading with its reference of three hours ago and its trailing-day means, whatever the order
    in which readings come, as long as none is later than ``retention``: later ones are dropped.

    A reading that comes late changes the labels of readings after it. Those are sent again with a
    greater ``seq``; ``settled`` keeps the last row of each. A station silent for the retention and a day
    is forgotten.
    """
    return readings.withWatermark("ts", retention).groupBy("station_id").applyInPandasWithState(
        _labels, OUT, STATE, "append", "EventTimeTimeout")


def settled(sent: DataFrame) -> DataFrame:
    """The last row sent for each reading."""
    last = Window.partitionBy("station_id", "reading_id").orderBy(F.desc("seq"))
    return sent.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "seq")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def upsert_latest(stream: DataFrame, store, table: str, checkpoint: str, arrival: Column) -> None:
    """Merge each micro-batch into a table of a ``KeyedStore``, of rows with one key the one of greatest ``arrival``. The
    stream is the writer, by the id that its checkpoint keeps, so a batch that is sent again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.merge(table, batch, arrival, stream_id, batch_id)

    query = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def as_readings(events: DataFrame) -> DataFrame:
    """Event rows as gauge readings."""
    return events.select(
        F.col("event_id").alias("reading_id"), (F.col("user_id") % 20).alias("station_id"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100).alias("level_m"),
        F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("discharge_cms"))
