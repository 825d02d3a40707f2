"""Gauge stream jobs run over all events as files that have arrived."""

from pyspark.sql import functions as F

from riffle.catalog.ranking import _REF
from riffle.catalog.registry import query
from riffle.catalog.tables import folder
from riffle.streaming import gauges as St


def readings(t):
    shape = t.base("events").schema
    events = St.read_stream(t.spark, t.folder, shape, pattern="events.parquet")
    return St.as_readings(events)


PIECES = 8


def arriving(t, name, lag, pieces=PIECES):
    """The events as files in order of arrival, less than ``lag`` days after they happened, read one file a
    batch."""
    events = t.base("events").withColumn("_day", F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")) + F.col("event_id") % lag)
    first, last = events.agg(F.min("_day"), F.max("_day")).first()
    path, width = folder(t, name), (last - first) // pieces + 1
    for k in range(pieces):  # one after the other: the source takes files by their time
        part = events.where(F.floor((F.col("_day") - first) / width) == k)
        part.drop("_day").coalesce(1).sortWithinPartitions(F.col("event_id") % 97).write.mode("append").parquet(path)
    return St.as_readings(St.read_stream(t.spark, path, t.base("events").schema, files_per_batch=1))


def finished(t, stream, name):
    out = folder(t, name)
    St.run_available(stream, out, folder(t, name + "-checkpoint"))
    return t.spark.read.parquet(out)


@query("n1_stream_dedupe", "SELECT DISTINCT station_id, date_trunc('minute', ts) AS ts FROM gauges")
def _(t):
    twice = readings(t).withColumn("ts", F.date_trunc("minute", "ts")).withColumn(
        "copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = finished(t, St.deduplicated(twice), "dedupe")
    return out.select("station_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("n2_stream_retention", f"""
    WITH a AS (SELECT event_id AS reading_id, ts, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) + event_id % 37 AS day FROM events),
      b AS (SELECT *, (day - min(day) OVER ()) // ((max(day) OVER () - min(day) OVER ()) // {2 * PIECES} + 1) AS piece FROM a),
      m AS (SELECT piece, max(ts) AS top FROM b GROUP BY 1),
      w AS (SELECT x.piece, max(y.top) - INTERVAL 7 DAY AS mark FROM m x JOIN m y ON y.piece <= x.piece - 2 GROUP BY 1)
    SELECT reading_id FROM b LEFT JOIN w USING (piece) WHERE mark IS NULL OR ts > mark""")
def _(t):
    # a batch is held against the watermark that stood when the batch before it began
    rows = arriving(t, "retention-files", 37, 2 * PIECES).withColumn("station_id", F.col("reading_id"))
    return finished(t, St.deduplicated(rows), "retention").select("reading_id")


@query("n3_stream_trends", _REF + " SELECT reading_id, level_trend, discharge_trend, cls AS level_class FROM c")
def _(t):
    from riffle.plans.gauges import with_labels

    out = with_labels(St.settled(finished(t, St.with_trends(arriving(t, "trend-files", 6, 5)), "trends")))
    return out.select("reading_id", "level_trend", "discharge_trend", "level_class")


@query("n4_stream_upsert", """
    SELECT CAST(station_id AS VARCHAR) AS station_id, ts AS reading_datetime, discharge_cms
    FROM gauges QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY reading_id DESC) = 1""")
def _(t):
    from riffle.plans.keyed_store import KeyedStore

    store = KeyedStore(t.spark, folder(t, "keyed"), parts=16)
    rows = readings(t).select(
        F.col("station_id").cast("string").alias("station_id"), F.col("ts").alias("reading_datetime"),
        F.col("level_m").alias("water_level_m"), "discharge_cms", "reading_id")
    St.upsert_latest(rows, store, "stream_gauge_readings", folder(t, "upsert-checkpoint"), F.col("reading_id"))
    return store.read("stream_gauge_readings").select(
        "station_id", F.col("reading_datetime").cast("timestamp_ntz").alias("reading_datetime"),
        "discharge_cms")
