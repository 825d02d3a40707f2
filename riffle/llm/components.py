"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b); root is one id of the component, the same for all.

    Each round sends every id to its least neighbour and contracts the links accordingly; at least
    half of the linked ids go each time. Rounds are tables in the checkpoint folder, nothing is
    collected, and an id with very many links only ever takes part in sums and joins Spark can split.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = written(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("root", F.col("id")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = written(both.groupBy(F.col("a").alias("old")).agg(F.least(F.min("a"), F.min("b")).alias("new")))
        move = lambda df, c: df.join(to.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        next_edges = written(move(move(edges, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        next_roots = written(move(roots, "root").select("id", "root"))
        dropped(edges, roots, to)
        edges, roots = next_edges, next_roots
    dropped(edges)
    return roots
