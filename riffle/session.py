"""Session helpers: settings the engine relies on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "riffle", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the reliable checkpoint folder and go on from its files.

    Unlike a checkpointed plan, the written table carries its true size, so the joins of a long
    loop are planned on facts instead of on ever larger estimates. The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/riffle-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a result that several branches of one plan read; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def together(*steps: Callable[[], DataFrame], threads: int = 6) -> list[DataFrame]:
    """What the steps return, their jobs submitted side by side: for searches that go in rounds of many short jobs
    and do not need each other's results."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


_LIMITS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
_lowered: dict[str, list] = {}
_lock = threading.Lock()


@contextmanager
def small_broadcasts(spark: SparkSession, limit: str = "256k") -> Iterator[None]:
    """Inside, joins of this session broadcast tables up to ``limit`` only, or up to what the session allows if that is
    less. Each table that is broadcast passes through the driver and stays there until its job ends, so searches side by
    side would hold dozens of them at once. What is to keep to this has to be planned inside, its write included."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    session = spark._jsparkSession.sessionUUID()
    with _lock:  # of overlapping uses the first one lowers, the last one restores
        held = _lowered.setdefault(session, [0, {}])
        held[0] += 1
        if held[0] == 1:
            now = {key: spark.conf.get(key) for key in _LIMITS}  # none where unset, below 0 where nothing is broadcast
            held[1] = {key: value for key, value in now.items() if value and value[0] != "-" and size(value) > size(limit)}
            for key in held[1]:
                spark.conf.set(key, limit)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                for key, value in held[1].items():
                    spark.conf.set(key, value)
                del _lowered[session]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows over all cores ahead of a step that makes many rows out of few bytes,
    which size-based coalescing would put into one task."""
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *keys)
