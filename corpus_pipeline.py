"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

No SQL checks it: training, alignment and the bucket search have no SQL form; tests hold every stage
against a brute-force version.
"""

from __future__ import annotations

from riffle.llm.decontaminate import without_benchmark
from riffle.llm.line_dedup import without_repeated_lines
from riffle.llm.near_duplicates import without_near_duplicates
from riffle.llm.packing import packed, token_counts
from riffle.llm.quality_model import without_rejected
from riffle.llm.shared import table, written


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go. It learns from the labels of the documents at hand."""
    return without_rejected(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Common blocks of lines go from the later document; so do documents that consist of nothing else."""
    return without_repeated_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of every class of near duplicates stays: the least doc_id."""
    return without_near_duplicates(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that overlap with a benchmark item go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """A row for every piece of a document: its bucket, batch and slot."""
    return packed(token_counts(docs)).drop("th")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
