"""Network operators on the small networks of the specification and on random ones."""

import os
import random

import pytest
from pyspark.sql import functions as F

from riffle.operators import graph as G


def edges(spark, rows):
    full = [(i, s, d, km * 1000.0, name, bool(v)) for i, s, d, km, name, v in rows]
    return spark.createDataFrame(
        full, "ogf_id bigint, start_node bigint, end_node bigint, length_m double, name string, "
        "flow_verified boolean")


def at(spark, n):
    return spark.createDataFrame([(n,)], "node bigint")


@pytest.fixture(scope="module")
def stem(spark):
    # 1=A 2=B 3=C 4=D 5=E 6=F
    seg = edges(spark, [(1, 1, 2, 2.5, "Bronte Creek", 1), (2, 2, 3, 2.5, "Bronte Creek", 1),
                        (3, 2, 4, 1.25, None, 1), (4, 5, 6, 1.5, None, 0)])
    bars = spark.createDataFrame([(10, "Falls", 3), (11, "Sea Lamprey Barrier", 2)],
                                 "ogf_id bigint, barrier_type string, nearest_segment_ogf_id bigint")
    return G.build_edges(seg, bars)


def ids(df):
    return [r["ogf_id"] for r in df.orderBy("distance_km", "ogf_id").collect()]


def test_unverified_flow_runs_both_ways(stem):
    assert stem.where("ogf_id = 4").count() == 2 and stem.count() == 5


def test_up_and_downstream(spark, stem):
    assert ids(G.upstream_of(stem, at(spark, 2))) == [1]
    down = G.downstream_of(stem, at(spark, 2)).orderBy("distance_km").collect()
    assert [(r["ogf_id"], round(r["distance_km"], 2)) for r in down] == [(3, 1.25), (2, 2.5)]


def test_reachable_prunes_barriers(spark, stem):
    assert 3 not in ids(G.reachable_from(stem, at(spark, 2), "walleye"))
    assert 2 in ids(G.reachable_from(stem, at(spark, 2), "walleye"))
    assert 2 not in ids(G.reachable_from(stem, at(spark, 2), "sea lamprey"))


def test_tributaries(stem):
    assert [r["ogf_id"] for r in G.tributaries(stem, "bronte creek").collect()] == [3]
    assert G.tributaries(stem, "bronte creek", "walleye").count() == 0


def test_paths_carry_the_first_barrier(spark, stem):
    got = {r["node"]: r for r in G.paths_from(stem, at(spark, 1), F.lit("walleye")).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[4]["blocking_barrier"] == "Falls" and got[4]["path_km"] == pytest.approx(3.75)
    assert got[3]["blocking_barrier"] is None


def orders(spark, rows):
    seg = edges(spark, [(i, s, d, 1.0, None, 1) for i, (s, d) in enumerate(rows, 1)])
    return {r["ogf_id"]: r["stream_order"] for r in G.strahler(G.build_edges(seg)).collect()}


def test_strahler_small_networks(spark):
    assert list(orders(spark, [(1, 3), (2, 3), (3, 4)]).values()) == [1, 1, 2]
    assert set(orders(spark, [(1, 2), (2, 3)]).values()) == {1}
    y = orders(spark, [(1, 3), (2, 3), (3, 4), (4, 5), (5, 6)])
    assert [y[i] for i in range(1, 6)] == [1, 1, 2, 2, 2]


def test_strahler_counts_a_cycle_as_one_node(spark):
    # 3 -> 4 -> 5 -> 3 is fed twice by order-one streams, then leaves to 6
    got = orders(spark, [(1, 3), (2, 4), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7)])
    assert got[1] == 1 and got[6] == 2 and got[7] == 2


def test_strahler_has_no_ceiling(spark):
    """A braid, each level's two nodes fed by both before: the order grows by one a level."""
    levels = int(os.environ.get("BRAID_LEVELS", "5"))
    pairs = [(2 * k + a, 2 * k + 2 + b) for k in range(levels) for a in (1, 2) for b in (1, 2)]
    pairs += [(2 * levels + 1, 900), (900, 901), (901, 902)]
    got = orders(spark, pairs)
    assert [got[i] for i in range(1, 4 * levels, 4)] == list(range(1, levels + 1))
    assert got[len(pairs)] == levels + 1


def brute_orders(pairs):
    import sys

    sys.setrecursionlimit(10_000)
    nodes = {n for p in pairs for n in p}
    out = {n: [d for s, d in pairs if s == n] for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    comp = {n: min([m for m in reach[n] if n in reach[m]] + [n]) for n in nodes}
    preds = {c: set() for c in comp.values()}
    for s, d in pairs:
        if comp[s] != comp[d]:
            preds[comp[d]].add(comp[s])
    memo = {}

    def order(c):
        if c not in memo:
            inc = [order(p) for p in preds[c]]
            top = max(inc, default=0)
            memo[c] = 1 if not inc else top + 1 if inc.count(top) >= 2 else top
        return memo[c]

    return {i: order(comp[s]) for i, (s, _) in enumerate(pairs, 1)}


@pytest.mark.parametrize("seed,back", [(2, 3), (3, 8)])
def test_strahler_random_networks(spark, seed, back):
    r = random.Random(seed)
    pairs = set()
    for n in range(2, 60):
        pairs.add((n, r.randrange(1, n)))
    for _ in range(15):
        a, b = sorted(r.sample(range(1, 60), 2))
        pairs.add((b, a))
    for _ in range(back):
        a, b = sorted(r.sample(range(1, 60), 2))
        pairs.add((a, b))
    pairs = sorted(pairs)
    assert orders(spark, pairs) == brute_orders(pairs)


def test_long_main_stem_closes_in_few_rounds(spark, monkeypatch):
    n = 120
    pairs = [(i, i + 1) for i in range(1, n)] + [(1000 + i, i) for i in range(2, n, 3)]
    calls = []
    real = G.cut
    monkeypatch.setattr(G, "cut", lambda df: calls.append(1) or real(df))
    got = orders(spark, pairs)
    assert got == brute_orders(pairs)
    assert len(calls) < 40


def test_confluences(spark):
    seg = edges(spark, [(i, s, d, 1.0, None, 1) for i, (s, d) in enumerate(
        [(1, 5), (2, 5), (3, 6), (4, 6), (5, 7), (6, 7), (7, 8)], 1)])
    o = G.strahler(G.build_edges(seg))
    nodes = [r["node"] for r in G.confluence_nodes(o).collect()]
    assert nodes == [7]
    assert sorted(r["ogf_id"] for r in G.confluence_segments(o, G.confluence_nodes(o)).collect()) == [5, 6, 7]


def test_station_limit_on_the_y_network(spark):
    e = G.build_edges(edges(spark, [(1, 1, 3, 12.0, None, 1), (2, 2, 3, 12.0, None, 1),
                                    (3, 3, 4, 12.0, None, 1), (4, 4, 5, 1.0, None, 1)]))
    s = spark.createDataFrame([(77, 1)], "station bigint, node bigint")
    assert [(r["ogf_id"], r["station"]) for r in G.from_nearest_source(e, s, "station", 15.0).collect()] == [(1, 77)]


def test_upstream_counts_weigh_shared_nodes(spark):
    e = G.build_edges(edges(spark, [(1, 1, 2, 1.0, None, 1), (2, 2, 3, 1.0, None, 1)]))
    dams = spark.createDataFrame([(1,), (1,), (2,)], "node bigint")
    got = {r["ogf_id"]: r["n"] for r in G.upstream_counts(e, dams, 20.0).collect()}
    assert got == {1: 2, 2: 3}
