"""River network operators as iterative DataFrame jobs.

Every loop cuts its lineage once per round at the reliable checkpoint folder, expands several
hops per round, and keeps one row per (source, node) or per node, so state grows with the part of
the network that is in reach and not with the number of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.session import cut

HOPS_PER_ROUND = 4

# Words that mark strong swimmers and barrier-bound species.
STRONG_SWIMMERS = [
    "salmon", "trout", "bass", "pike", "walleye", "muskie", "muskellunge", "carp", "steelhead",
    "perch", "catfish", "bullhead",
]
LAMPREY = ["lamprey"]


def _named_like(species: Column, words: list[str]) -> Column:
    return geo.any_of(F.lower(species).contains(w) for w in words)


def can_pass(species: Column, barrier: Column) -> Column:
    """Whether a species gets past a barrier; no barrier, and unknown kinds, are open."""
    return (
        F.when(barrier == "Falls", False)
        .when(barrier == "Sea Lamprey Barrier", species.isNull() | ~_named_like(species, LAMPREY))
        .when(barrier == "Rapids", species.isNull() | _named_like(species, STRONG_SWIMMERS))
        .otherwise(True)
    )


def build_edges(segments: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """Directed edges of the network; segments of unverified flow run both ways.

    Parallel edges collapse to the one with the highest segment id, and so do several barriers
    on one segment.
    """
    s = segments
    if barriers is not None:
        label = barriers.where("nearest_segment_ogf_id IS NOT NULL").groupBy(
            F.col("nearest_segment_ogf_id").alias("ogf_id")
        ).agg(F.max_by("barrier_type", F.col("ogf_id")).alias("barrier_type"))
        s = s.join(label, "ogf_id", "left")
    else:
        s = s.withColumn("barrier_type", F.lit(None).cast("string"))
    way = lambda a, b, rev: F.struct(
        F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(rev).alias("rev"))
    forward, back = way("start_node", "end_node", 0), way("end_node", "start_node", 1)
    ways = F.when(F.col("flow_verified"), F.array(forward)).otherwise(F.array(forward, back))
    rows = s.withColumn("way", F.explode(ways)).select(
        "way.src", "way.dst", "ogf_id", "name", (F.col("length_m") / 1000.0).alias("km"),
        "barrier_type", "way.rev").where("src <> dst")
    item = F.struct("ogf_id", "name", "km", "barrier_type", "rev")
    return rows.groupBy("src", "dst").agg(F.max(item).alias("e")).select("src", "dst", "e.*")


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; where both exist the forward one keeps its data."""
    plain = edges.select("src", "dst", "ogf_id", "name", "km", "barrier_type")
    both = plain.withColumn("_p", F.lit(0)).unionByName(
        reversed_edges(plain).withColumn("_p", F.lit(1)))
    item = F.struct("_p", "ogf_id", "name", "km", "barrier_type")
    return both.groupBy("src", "dst").agg(F.min(item).alias("e")).select("src", "dst", "e.*").drop("_p")


def near_sources(edges: DataFrame, positions: DataFrame, sources: DataFrame,
                 buffer_km: float) -> DataFrame:
    """Edges with both ends inside the sources' bounding box widened by the buffer."""
    box = sources.agg(F.min("lat").alias("s"), F.max("lat").alias("n"),
                      F.min("lng").alias("w"), F.max("lng").alias("e"))
    dy, dx = buffer_km / geo.KM_PER_DEGREE, buffer_km / geo.KM_PER_DEGREE_LNG
    edge = lambda c: box.select(c).scalar()
    kept = positions.where(
        F.col("lat").between(edge("s") - dy, edge("n") + dy)
        & F.col("lng").between(edge("w") - dx, edge("e") + dx)).select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(
        kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def _spread(edges: DataFrame, start: DataFrame, keys: list[str], step, allowed: Column | None,
            hops: int = HOPS_PER_ROUND, until=None) -> DataFrame:
    """Smallest label per (keys, node) reachable from ``start`` over the edges.

    ``start`` has keys, node and a struct ``label``; ``step`` makes the next label from ``label``
    and the edge columns. A label is only replaced by a strictly smaller one. ``until`` (round,
    frames with the labels so far) may end the search early, which is right where a node's first label
    is its last, as with hops.
    """
    edges = cut(edges)
    frontier = cut(start)
    parts = [frontier]
    on = [*keys, "node"]
    best = lambda fs: _union(fs).groupBy(*on).agg(F.min("label").alias("label"))
    rounds = 0
    while True:
        wave, waves = frontier, []
        for _ in range(hops):
            moved = wave.join(edges, wave["node"] == edges["src"]).withColumn("label", step())
            if allowed is not None:
                moved = moved.where(allowed)
            wave = moved.groupBy(*keys, F.col("dst").alias("node")).agg(F.min("label").alias("label"))
            waves.append(wave)
        known = best(parts).withColumnRenamed("label", "known")
        found = best(waves).join(known, on, "left")
        frontier = cut(found.where(
            F.col("known").isNull() | (F.col("label") < F.col("known"))).select(*on, "label"))
        if frontier.isEmpty():
            return best(parts)
        parts.append(frontier)
        rounds += 1
        if until is not None and until(rounds, _union(parts).select("node")):
            return best(parts)
        if len(parts) > 8:
            parts = [cut(best(parts))]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reach(edges: DataFrame, sources: DataFrame, max_km: float,
          keys: list[str] | None = None) -> DataFrame:
    """Shortest distance in km from each source (``keys``, node) to every node within range."""
    keys = keys or []
    start = sources.select(*keys, "node").distinct().withColumn("label", F.struct(
        F.lit(0.0).alias("d")))
    step = lambda: F.struct((F.col("label.d") + F.col("km")).alias("d"))
    labels = _spread(edges, start, keys, step, F.col("label.d") <= max_km + 1e-9)
    return labels.select(*keys, "node", F.col("label.d").alias("from_km"))


def reach_edges(edges: DataFrame, sources: DataFrame, max_km: float,
                keys: list[str] | None = None, first_only: bool = False) -> DataFrame:
    """Edges whose near end is in reach and whose far end stays within range, with distance.

    ``first_only`` keeps a single edge per far node: the shortest, then the smallest id.
    """
    keys = keys or []
    labels = reach(edges, sources, max_km, keys)
    out = labels.join(edges, labels["node"] == edges["src"]).withColumn(
        "distance_km", F.col("from_km") + F.col("km")).where(
        F.col("distance_km") <= max_km + 1e-9).drop("from_km", "node")
    if first_only:
        item = F.struct("distance_km", *[c for c in out.columns if c not in (
            *keys, "dst", "distance_km")])
        out = out.groupBy(*keys, "dst").agg(F.min(item).alias("m")).select(*keys, "dst", "m.*")
    per_segment = out.groupBy(*keys, "ogf_id").agg(
        F.min(F.struct("distance_km", "name", "km", "barrier_type")).alias("m"))
    return per_segment.select(*keys, "ogf_id", "m.*")


def upstream_of(edges, sources, max_km=20.0, **kw):
    return reach_edges(reversed_edges(edges), sources, max_km, **kw)


def downstream_of(edges, sources, max_km=20.0, **kw):
    return reach_edges(edges, sources, max_km, **kw)


def reachable_from(edges: DataFrame, sources: DataFrame, species: str | None = None,
                   max_km: float = 20.0, **kw) -> DataFrame:
    """Both directions, edges the species cannot pass left out."""
    name = F.lit(species).cast("string")
    open_edges = undirected(edges).where(can_pass(name, F.col("barrier_type")))
    return reach_edges(open_edges, sources, max_km, **kw)


def from_nearest_source(edges: DataFrame, sources: DataFrame, id_column: str,
                        max_km: float) -> DataFrame:
    """Per segment the nearest upstream source within range: ogf_id, id and distance.

    One label per node is enough, because what is nearest at a node stays nearest beyond it; the
    smallest id wins equal distances.
    """
    start = sources.groupBy("node").agg(F.min(F.struct(
        F.lit(0.0).alias("d"), F.col(id_column).alias("id"))).alias("label"))
    step = lambda: F.struct(
        (F.col("label.d") + F.col("km")).alias("d"), F.col("label.id").alias("id"))
    labels = _spread(edges, start, [], step, F.col("label.d") <= max_km + 1e-9)
    far = F.struct((F.col("label.d") + F.col("km")).alias("d"), F.col("label.id").alias("id"))
    out = labels.join(edges, labels["node"] == edges["src"]).withColumn("m", far).where(
        F.col("m.d") <= max_km + 1e-9)
    return out.groupBy("ogf_id").agg(F.min("m").alias("m")).select(
        "ogf_id", F.col("m.id").alias(id_column), F.col("m.d").alias("distance_km"))


def upstream_counts(edges: DataFrame, sources: DataFrame, max_km: float,
                    name: str = "n") -> DataFrame:
    """Number of sources whose downstream reach covers each segment.

    Sources sharing a node travel as one label with a weight.
    """
    weights = sources.groupBy("node").agg(F.count("*").alias("weight"))
    start = weights.select(F.col("node").alias("origin"), "node")
    covered = reach_edges(edges, start, max_km, ["origin"])
    return covered.join(weights.withColumnRenamed("node", "origin"), "origin").groupBy(
        "ogf_id").agg(F.sum("weight").alias(name))


def tributaries(edges: DataFrame, stem: str, species: str | None = None) -> DataFrame:
    """Segments touching the named stem without belonging to it."""
    on_stem = edges.where(F.lower("name") == stem.lower())
    nodes = on_stem.select(F.col("src").alias("node")).union(on_stem.select("dst")).distinct()
    touching = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(
        edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    out = touching.join(on_stem.select("ogf_id").distinct(), "ogf_id", "left_anti")
    if species:
        out = out.where(can_pass(F.lit(species), F.col("barrier_type")))
    return out.groupBy("ogf_id").agg(F.min(F.struct("name", "km", "barrier_type")).alias("e")).select(
        "ogf_id", "e.*")


def tributary_report(found: DataFrame) -> DataFrame:
    """Named tributaries with their segment counts, the unnamed ones as one row."""
    return found.groupBy(F.coalesce("name", F.lit("(unnamed)")).alias("name")).agg(
        F.count("*").alias("segments"), F.round(F.sum("km"), 3).alias("km"))


# The kinds of barriers that stop some species or all.
BARRIER_KINDS = {"falls": "Falls", "lamprey": "Sea Lamprey Barrier", "rapids": "Rapids"}
PATIENCE = 6


def barrier_labels(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Fewest-hop path from the sources to each connected node: hops, path_km, and for each kind of barrier
    the number of the first edge that has it (``falls``, ``lamprey``, ``rapids``; null for none).

    One search answers for every species: which barrier blocks it first follows from the three numbers
    (``first_blocking``). Flow direction is ignored; among equal hops the shorter path is taken. With
    ``targets`` (node) the search ends once all of them are labelled: a node's first label is its last, as
    hops come first. After ``PATIENCE`` rounds targets in other components than the sources are
    given up, so they never make it walk a whole network.
    """
    both = undirected(edges)
    none = F.lit(None).cast("int")
    start = sources.select("node").distinct().withColumn("label", F.struct(
        F.lit(0).alias("hops"), F.lit(0.0).alias("km"), *[none.alias(k) for k in BARRIER_KINDS]))
    number = F.col("label.hops") + 1
    step = lambda: F.struct(
        number.alias("hops"), (F.col("label.km") + F.col("km")).alias("km"),
        *[F.coalesce(F.col(f"label.{k}"), F.when(F.col("barrier_type") == kind, number)).alias(k)
          for k, kind in BARRIER_KINDS.items()])
    wanted = None if targets is None else [cut(targets.select("node").where("node IS NOT NULL").distinct())]

    def settled(rounds: int, known: DataFrame) -> bool:
        left = wanted[0].join(known, "node", "left_anti")
        if rounds == PATIENCE and not left.isEmpty():
            comp = components(both.select(F.col("src").alias("a"), F.col("dst").alias("b")))
            mine = comp.join(sources.select("node"), "node", "left_semi").select("comp").distinct()
            wanted[0] = cut(wanted[0].join(comp.join(mine, "comp", "left_semi"), "node", "left_semi"))
            left = wanted[0].join(known, "node", "left_anti")
        return left.isEmpty()

    labels = _spread(both, start, [], step, None, until=settled if wanted else None)
    return labels.select("node", F.col("label.hops").alias("hops"), F.col("label.km").alias("path_km"),
                         *[F.col(f"label.{k}").alias(k) for k in BARRIER_KINDS])


def first_blocking(species: Column) -> Column:
    """The first barrier on a path of ``barrier_labels`` that the species cannot pass; null for none."""
    met = [F.when(F.col(k).isNotNull() & ~can_pass(species, F.lit(kind)), F.struct(F.col(k).alias("at"), F.lit(kind).alias("kind")))
           for k, kind in BARRIER_KINDS.items()]
    return F.array_min(F.array_compact(F.array(*met)))["kind"]


def paths_from(edges: DataFrame, sources: DataFrame, species: Column,
               targets: DataFrame | None = None) -> DataFrame:
    """Fewest-hop path from the source to each connected node (to ``targets`` at least, where given): hops,
    km, first blocking barrier."""
    return barrier_labels(edges, sources, targets).select(
        "node", "hops", "path_km", first_blocking(species).alias("blocking_barrier"))


# --- stream order ---------------------------------------------------------------------------

def components(pairs: DataFrame) -> DataFrame:
    """Connected components of undirected pairs (a, b): node, comp (smallest member).

    Smallest-label exchange with pointer jumping, so long chains close in logarithmic rounds.
    """
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(
            F.min("comp").alias("other"))
        hooked = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("was"), F.least("comp", "other").alias("comp"))
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        moved = hooked.join(jump, "comp", "left").select(
            "node", "was", F.least(F.col("comp"), F.coalesce("root", "comp")).alias("comp"))
        new = cut(moved)
        if new.where("comp <> was").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _color(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node that reaches each node: (node, color)."""
    start = nodes.select("node", F.struct(F.col("node").alias("c")).alias("label"))
    labels = _spread(edges.select("src", "dst"), start, [], lambda: F.col("label"), None)
    return labels.select("node", F.col("label.c").alias("color"))


def strong_components(edges: DataFrame) -> DataFrame:
    """Members of directed cycles: (node, comp); nodes on no cycle are absent.

    Two-way edges are merged first by connected components; what still cycles after trimming
    nodes without predecessors or successors is taken apart by forward and backward colors.
    """
    e = edges.select("src", "dst").distinct()
    two_way = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
                     ["src", "dst"], "left_semi")
    merged = cut(components(two_way.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    core = cut(_trim(contract(e, merged)))
    if core.isEmpty():
        return merged
    found = None
    while not core.isEmpty():
        nodes = core.select(F.col("src").alias("node")).union(core.select("dst")).distinct()
        color = cut(_color(core, nodes))
        same = cut(core.join(color.withColumnsRenamed({"node": "src", "color": "c1"}), "src").join(
            color.withColumnsRenamed({"node": "dst", "color": "c2"}), "dst").where("c1 = c2"))
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = color.where("node = color").select("node", F.struct(
            F.col("node").alias("c")).alias("label"))
        group = cut(_spread(back, roots, [], lambda: F.col("label"), None).select(
            "node", F.col("label.c").alias("comp")))
        found = group if found is None else found.unionByName(group)
        done = group.select("node")
        core = cut(_trim(core.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(
            done.withColumnRenamed("node", "dst"), "dst", "left_anti")))
    outer = found.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    lifted = merged.join(outer, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    single = found.join(merged, "node", "left_anti")
    return cut(lifted.unionByName(single))


def _trim(e: DataFrame, rounds: int = 64) -> DataFrame:
    """Remove edges that lie on no cycle, from both ends."""
    e = cut(e)
    for _ in range(rounds):
        kept = e
        for _ in range(2):
            kept = kept.join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            kept = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = cut(kept)
        if kept.count() == e.count():
            break
        e = kept
    return e


def contract(e: DataFrame, comps: DataFrame) -> DataFrame:
    """Edges between components, self-edges dropped."""
    s = comps.withColumnsRenamed({"node": "src", "comp": "cs"})
    d = comps.withColumnsRenamed({"node": "dst", "comp": "cd"})
    return e.join(s, "src", "left").join(d, "dst", "left").select(
        F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst")
    ).where("src <> dst").distinct()


def _from_known(m: Column, k: Column) -> Column:
    """Order of a node from the largest order among its predecessors and how many share it."""
    return F.when(m.isNull(), F.lit(1)).when(k >= 2, m + 1).otherwise(m)


def node_orders(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """Strahler order of every node of an acyclic network: (node, ord).

    Each round resolves nodes whose predecessors are all known. A node with one unknown
    predecessor keeps its order as a table over that predecessor's possible orders, and such
    tables are composed by pointer jumping, so a river main stem of any length closes in
    logarithmic rather than linear rounds.
    """
    pend = cut(dag)
    done, link = None, None
    acc = nodes.select("node").withColumns({"m": F.lit(None).cast("int"), "k": F.lit(0)})
    while True:
        waiting = pend.groupBy(F.col("dst").alias("node")).agg(
            F.count("*").alias("open"), F.min("src").alias("first_open"))
        state = acc.join(waiting, "node", "left")
        if link is not None:
            state = state.join(link, "node", "left")
        else:
            state = state.withColumns({"to": F.lit(None).cast("bigint"),
                                       "f": F.lit(None).cast("array<int>")})
        known = _from_known(F.col("m"), F.col("k"))
        floor = F.coalesce("m", F.lit(0))
        # up to the largest known order; above it the open predecessor's order is the node's own
        table = F.when(floor == 0, F.array().cast("array<int>")).otherwise(F.transform(
            F.sequence(F.lit(1), floor), lambda x: F.when(x == floor, x + 1).otherwise(known)))
        one = F.col("open") == 1
        state = cut(state.select(
            "node", "m", "k", F.when(one, F.coalesce("to", "first_open")).alias("ptr"),
            F.when(one, F.coalesce("f", table)).alias("f"),
            F.when(F.col("open").isNull(), known).alias("ord")))
        # follow pointers: a resolved node gives the order, another pointer composes the tables
        other = state.where("ord IS NOT NULL OR f IS NOT NULL").select(
            F.col("node").alias("ptr"), F.col("ord").alias("o2"), F.col("f").alias("f2"),
            F.col("ptr").alias("p2"))
        if done is not None:
            # a pointer may lead to a node settled in an earlier round
            other = other.unionByName(done.select(
                F.col("node").alias("ptr"), F.col("ord").alias("o2")), allowMissingColumns=True)
        after = lambda x: F.coalesce(F.get("f", x - 1), x)
        longest = F.greatest(F.size("f"), F.size("f2"))
        composed = F.when(longest == 0, F.col("f")).otherwise(F.transform(
            F.sequence(F.lit(1), longest), lambda x: after(F.coalesce(F.get("f2", x - 1), x))))
        out = cut(state.join(other, "ptr", "left").select(
            "node", "m", "k",
            F.coalesce("p2", "ptr").alias("to"),
            F.when(F.col("p2").isNotNull(), composed).otherwise(F.col("f")).alias("f"),
            F.coalesce("ord", F.when(F.col("f").isNotNull(), after(F.col("o2")))).alias("ord"),
        ))
        fresh = out.where("ord IS NOT NULL").select("node", "ord")
        left = out.where("ord IS NULL")
        if fresh.isEmpty():
            return done if done is not None else fresh
        done = fresh if done is None else done.unionByName(fresh)
        if left.isEmpty():
            return done
        news = pend.join(fresh.withColumnRenamed("node", "src"), "src").groupBy(
            F.col("dst").alias("node"), "ord").agg(F.count("*").alias("c"))
        top = news.groupBy("node").agg(F.max(F.struct("ord", "c")).alias("t"))
        lower = F.col("t").isNull() | (F.col("t.ord") < F.col("m"))
        acc = left.select("node", "m", "k").join(top, "node", "left").select(
            "node",
            F.when(lower, F.col("m")).otherwise(F.col("t.ord")).alias("m"),
            F.when(lower, F.col("k")).when(F.col("t.ord") == F.col("m"), F.col("k") + F.col("t.c"))
            .otherwise(F.col("t.c")).cast("int").alias("k"))
        pend = cut(pend.join(fresh.select(F.col("node").alias("src")), "src", "left_anti").join(
            fresh.select(F.col("node").alias("dst")), "dst", "left_anti"))
        link = left.where("f IS NOT NULL").select("node", "to", "f")


def strahler(edges: DataFrame) -> DataFrame:
    """Order per segment: that of its upstream node, with a directed cycle counting as one node.

    Each segment counts once, in its stored direction.
    """
    one = cut(edges.groupBy("ogf_id").agg(F.min(F.struct("rev", "src", "dst")).alias("e")).select(
        "ogf_id", "e.src", "e.dst"))
    pairs = one.select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    by_node = node_orders(pairs, ends)
    stuck = cut(ends.join(by_node, "node", "left_anti"))
    if not stuck.isEmpty():
        # directed cycles, and what lies below them: merge each cycle and order the rest again
        inner = pairs.join(stuck.withColumnRenamed("node", "src"), "src", "left_semi").join(
            stuck.withColumnRenamed("node", "dst"), "dst", "left_semi")
        comps = strong_components(inner)
        owner = ends.join(comps, "node", "left").select(
            "node", F.coalesce("comp", "node").alias("comp"))
        orders = node_orders(contract(pairs, comps), owner.select(
            F.col("comp").alias("node")).distinct())
        by_node = owner.join(orders.withColumnRenamed("node", "comp"), "comp").select("node", "ord")
    return one.join(by_node.withColumnRenamed("node", "src"), "src").select(
        "ogf_id", "src", "dst", F.col("ord").cast("bigint").alias("stream_order"))


def confluence_nodes(orders: DataFrame) -> DataFrame:
    """Nodes where at least three segments meet, two of them of order two or more."""
    ends = orders.select(F.col("src").alias("node"), "ogf_id", "stream_order").unionByName(
        orders.select(F.col("dst").alias("node"), "ogf_id", "stream_order"))
    return ends.groupBy("node").agg(
        F.count("*").alias("degree"), F.count_if(F.col("stream_order") >= 2).alias("big")
    ).where("degree >= 3 AND big >= 2").select("node")


def confluence_segments(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    touch = lambda end: orders.join(
        nodes.withColumnRenamed("node", end), end, "left_semi").select("ogf_id")
    return touch("src").union(touch("dst")).distinct()
