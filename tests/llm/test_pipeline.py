"""The pipeline's stages against brute force, and as a whole."""

import corpus_pipeline
import pytest
from test_formats_and_rules import slow_overlap
from test_line_dedup import brute as brute_lines
from test_near_duplicates import brute as brute_near

from riffle.llm.quality_model import scored, trained_on

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        out.append((name, docs))
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_every_stage_works_on_all_that_its_predecessor_kept(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in stages] == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    assert all(df.columns == docs.columns for _, df in stages[:-1])
    good, lines, single, clean, packs = (df for _, df in stages)
    verdict = {r.doc_id: r.predicted for r in scored(docs, trained_on(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect()}
    assert pairs(good) == [(i, t) for i, t in pairs(docs) if verdict[i]]
    assert pairs(lines) == sorted((i, t) for i, _, n, t in brute_lines(pairs(good), 10) if not n or t.split())
    rows = pairs(lines)
    assert pairs(single) == sorted(min(rows[i] for i in g) for g in brute_near(rows).values())
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert pairs(clean) == [(i, t) for i, t in pairs(single) if not any(slow_overlap(t, u) for u in items)]
    assert {r.doc_id for r in packs.collect()} == {i for i, _ in pairs(clean)}
    slots = [(r.bucket, r.batch, r.slot) for r in packs.collect()]
    assert len(set(slots)) == len(slots)


def test_run_gives_the_last_stage(spark, stages):
    last = stages[-1][1]
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == last.columns and sorted(map(str, got.collect())) == sorted(map(str, last.collect()))


def test_stages_take_empty_tables_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "words\n" * 50, None, "s", 300), (2, "words\n" * 50, None, "s", 300), (None, "x y", "en", "s", 3)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.written(stage(spark, rows, FOLDER))
            rows.count()
