"""What the operators share: reading tables, document keys, and tables written between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def own_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared checkpoint folder; what is there goes when the session ends."""
    path = f"{checkpoint_dir(spark)}/riffle-llm-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back: a lost executor costs a re-read,
    later joins know the true size, and nothing upstream runs twice. Goes when the session ends, or
    with ``dropped``."""
    spark = df.sparkSession
    path = own_folder(spark)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._llm_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_hash(text: str = "text") -> Column:
    """With ``doc_id`` this tells documents apart: rows equal in both are copies of one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def bytes_of(text: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the text's hash ``th`` and the asked columns; every other column stays behind, so
    none of its names can clash."""
    return docs.select("doc_id", text_hash().alias("th"), *columns)


def held_out(remainder: int, modulus: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(True))
