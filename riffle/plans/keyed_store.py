"""Tables by key whose merges rewrite only the part their keys fall into.

Rows lie in folders by a hash of their key. A merge reads the folders of its keys, writes them anew beside the old ones
and then commits: a small file of the next version number names the folder that holds each part. Readers see one version
or the next, never a mixture, and a writer that breaks off leaves files that no version names.

Of two writers that commit the same version one loses, by a rename that fails where the name is taken (HDFS does it
atomically; the local disk checks and renames). The loser goes on from the new version: it keeps what it wrote if the
other touched none of its parts, else it merges again. A writer may name itself and number its batches: a number that is
not above its last one is a replay and changes nothing.

Rules: within a batch the row of greatest ``arrival`` wins; rows whose key has a null take no part; an empty batch
commits its number and no rows; columns new to the table are added, columns absent from a batch are null in its rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.operators.tables import upsert, with_defaults
from riffle.schemas import DEFAULTS, KEYS, schema
from riffle.session import cut

PART = "key_part"
EMPTY = {"version": 0, "schema": None, "folders": {}, "writers": {}}


class KeyedStore:
    """``parts``: into how many parts a new table is cut; a table keeps the number it began with."""

    def __init__(self, spark: SparkSession, base: str, parts: int = 64):
        self.spark, self.base, self.parts = spark, base.rstrip("/"), parts

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        fs, path = self._files(), self._path(*names)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self, table: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(table, "commits") if n.endswith(".json")]

    def state(self, table: str, version: int | None = None) -> dict:
        """What a version (the newest unless one is named) says; the empty state if there is none."""
        have = self.versions(table)
        if not have:
            return {**EMPTY, "parts": self.parts}
        stream = self._files().open(self._path(table, "commits", f"{version or have[-1]:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, table: str, state: dict) -> bool:
        """Put a version in place whole; False if another writer was first."""
        fs = self._files()
        draft, final = self._path(table, "drafts", uuid.uuid4().hex), self._path(table, "commits", f"{state['version']:010d}.json")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
            return True
        except Exception:
            if not fs.exists(final):
                raise
            fs.delete(draft, False)
            return False

    def _rows(self, table: str, state: dict, parts=None) -> DataFrame:
        shape = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.base}/{table}/data/{folder}/{PART}={part}" for part, folder in state["folders"].items()
                 if parts is None or int(part) in parts]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a version; of a table never written, no rows with its known columns."""
        state = self.state(table, version)
        if state["schema"] is None:
            return self.spark.createDataFrame([], schema(table))
        return self._rows(table, state)

    def merge(self, table: str, batch: DataFrame, arrival: Column, writer: str | None = None, batch_id: int | None = None,
              keys: list[str] | None = None) -> list[int]:
        """Upsert a batch by the table's key and return the parts that were written: none for an empty batch or a
        replay. A table that ``riffle.schemas`` knows takes its columns, defaults and key from there."""
        if table in KEYS and keys is None:
            rows, keys = with_defaults(batch.withColumn("_arrival", arrival), schema(table), DEFAULTS.get(table), keep=["_arrival"]), KEYS[table]
        else:
            rows = batch.withColumn("_arrival", arrival)
        state = self.state(table)
        if self._replayed(state, writer, batch_id):
            return []
        placed = F.pmod(F.xxhash64(*keys), F.lit(state["parts"])).cast("int")
        rows = cut(rows.dropna(subset=keys).withColumn(PART, placed))
        touched = sorted(r[PART] for r in rows.select(PART).distinct().collect())  # at most one a part
        rows = rows.drop(PART)
        written = None
        while True:
            before = {str(p): state["folders"].get(str(p)) for p in touched}
            if written is None or written[1] != before:
                written = (self._write(table, state, rows, keys, placed, touched), before)
            (folder, shape), _ = written
            after = {**state, "version": state["version"] + 1, "schema": _joined(state["schema"], shape),
                     "folders": {**state["folders"], **{str(p): folder for p in touched}},
                     "writers": {**state["writers"], **({writer: batch_id} if writer is not None else {})}}
            if self._commit(table, after):
                return touched
            state = self.state(table)
            if self._replayed(state, writer, batch_id):
                return []

    @staticmethod
    def _replayed(state: dict, writer: str | None, batch_id: int | None) -> bool:
        return writer is not None and writer in state["writers"] and batch_id <= state["writers"][writer]

    def _write(self, table: str, state: dict, rows: DataFrame, keys: list[str], placed: Column, touched: list[int]) -> tuple[str, str]:
        """The touched parts with the batch merged in, in a new folder; the folder and the columns written."""
        folder = uuid.uuid4().hex
        old = self._rows(table, state, set(touched)) if state["schema"] else self.spark.createDataFrame([], rows.drop("_arrival").schema)
        merged = upsert(old, rows, keys, F.col("_arrival")).drop("_arrival")
        # parts of any size: large ones are split over tasks, small ones share one
        merged.withColumn(PART, placed).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.base}/{table}/data/{folder}")
        return folder, merged.schema.json()

    def vacuum(self, table: str, keep: int = 2, older_than_ms: int = 7 * 86_400_000) -> list[str]:
        """Delete data that none of the newest ``keep`` versions names, and older versions; the folders deleted.
        Data younger than ``older_than_ms`` stay, as a writer may be about to commit them."""
        fs, have = self._files(), self.versions(table)
        named = {f for v in have[-keep:] for f in self.state(table, v)["folders"].values()}
        now = self.spark._jvm.System.currentTimeMillis()
        old = [n for n in self._names(table, "data") if n not in named
               and now - fs.getFileStatus(self._path(table, "data", n)).getModificationTime() >= older_than_ms]
        for v in have[:-keep]:
            fs.delete(self._path(table, "commits", f"{v:010d}.json"), False)
        for name in old:
            fs.delete(self._path(table, "data", name), True)
        return old


def _joined(first: str | None, second: str) -> str:
    """The columns of both, in order of first appearance."""
    if first is None:
        return second
    a, b = (T.StructType.fromJson(json.loads(x)) for x in (first, second))
    have = set(a.names)
    return T.StructType([*a.fields, *[f for f in b.fields if f.name not in have]]).json()
