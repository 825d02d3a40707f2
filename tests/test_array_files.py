"""Array files hold a bounded number of rows each."""

from __spark_entry__ import queries
from riffle.catalog import tables as T

FOLDER = "/root/testdata/sf0.001"


def test_array_files_are_bounded(spark, monkeypatch):
    seen, read = [], T.Js.read
    monkeypatch.setattr(T, "ARRAY_ROWS", 50, raising=False)
    monkeypatch.setattr(T.Js, "read", lambda s, path, *a, **k: seen.append(path) or read(s, path, *a, **k))
    rows = queries()["a22_json_array_file"](spark, FOLDER).collect()
    names = [r.species for r in spark.read.parquet(f"{FOLDER}/customer.parquet").selectExpr("c_name AS species").collect()]
    assert sorted(r.species for r in rows) == sorted(names)
    held = [r.value.count('"species"') for r in spark.read.option("recursiveFileLookup", True).text(seen[0]).collect()]
    assert sum(held) == len(names) > 50 >= max(held)
    assert len(spark.read.option("recursiveFileLookup", True).text(seen[0]).inputFiles()) == len(held)
