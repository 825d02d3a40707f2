"""River network: traversal, connectivity, stream order."""

from pyspark.sql import functions as F

from riffle.catalog.registry import query
from riffle.operators import graph as G

EDGES = """bl AS (SELECT nearest_segment_ogf_id AS ogf_id, arg_max(barrier_type, ogf_id) AS barrier_type
      FROM barriers GROUP BY 1),
    raw AS (SELECT start_node AS src, end_node AS dst, ogf_id, name, length_m / 1000.0E0 AS km,
        barrier_type FROM segments LEFT JOIN bl USING (ogf_id)
      UNION ALL SELECT end_node, start_node, ogf_id, name, length_m / 1000.0E0, barrier_type
        FROM segments LEFT JOIN bl USING (ogf_id) WHERE NOT flow_verified),
    edges AS (SELECT src, dst, arg_max(raw, ogf_id) AS e FROM raw WHERE src <> dst GROUP BY 1, 2),
    e AS (SELECT src, dst, e.ogf_id AS ogf_id, e.name AS name, e.km AS km,
      e.barrier_type AS barrier_type FROM edges)"""


def edges(t):
    return G.build_edges(t.segments, t.barriers)


def node(t, n):
    return t.spark.range(n, n + 1).withColumnRenamed("id", "node")


@query("h1_edges", f"WITH {EDGES} SELECT src, dst, ogf_id, name, barrier_type, round(km, 6) AS km FROM e")
def _(t):
    return edges(t).select("src", "dst", "ogf_id", "name", "barrier_type", F.round("km", 6).alias("km"))


def _walk(src, dst, start, limit, cond="true", table="e"):
    """Labels within a budget, each node at its shortest distance."""
    return f"""w AS (SELECT CAST({start} AS BIGINT) AS node, 0.0E0 AS d
      UNION ALL SELECT {table}.{dst}, w.d + km FROM w JOIN {table} ON w.node = {table}.{src}
      WHERE w.d + km <= {limit} AND {cond}),
    lab AS (SELECT node, min(d) AS d FROM w GROUP BY 1),
    r AS (SELECT ogf_id, round(min(d + km), 2) AS distance_km FROM lab JOIN {table}
      ON lab.node = {table}.{src} WHERE d + km <= {limit} AND {cond} GROUP BY 1)"""


@query("h2_upstream_within", f"WITH RECURSIVE {EDGES}, {_walk('dst', 'src', 5, 20)} SELECT * FROM r")
def _(t):
    return G.upstream_of(edges(t), node(t, 5), 20.0).select(
        "ogf_id", F.round("distance_km", 2).alias("distance_km")).orderBy("distance_km", "ogf_id")


@query("h2_downstream_within",
       f"WITH RECURSIVE {EDGES}, {_walk('src', 'dst', 190, 20)} SELECT * FROM r")
def _(t):
    return G.downstream_of(edges(t), node(t, 190), 20.0).select(
        "ogf_id", F.round("distance_km", 2).alias("distance_km")).orderBy("distance_km", "ogf_id")


_UND = """u AS (SELECT src, dst, ogf_id, name, km, barrier_type FROM e UNION
      SELECT dst, src, ogf_id, name, km, barrier_type FROM e)"""


@query("h3_reachable_for_species", f"""WITH RECURSIVE {EDGES}, {_UND}, {_walk(
    'src', 'dst', 20, 15, "coalesce(barrier_type, '') NOT IN ('Falls', 'Rapids')", 'u')}
    SELECT * FROM r""")
def _(t):
    return G.reachable_from(edges(t), node(t, 20), "rainbow darter", 15.0).select(
        "ogf_id", F.round("distance_km", 2).alias("distance_km")).orderBy("distance_km", "ogf_id")


@query("h4_tributaries", f"""WITH {EDGES}, stem AS (SELECT * FROM e WHERE lower(name) = 'red widget'),
      n AS (SELECT src AS node FROM stem UNION SELECT dst FROM stem)
    SELECT DISTINCT ogf_id FROM e WHERE (src IN (SELECT node FROM n) OR dst IN (SELECT node FROM n))
      AND ogf_id NOT IN (SELECT ogf_id FROM stem) AND coalesce(barrier_type, '') <> 'Falls'""")
def _(t):
    return G.tributaries(edges(t), "Red Widget", "walleye").select("ogf_id")


@query("h5_paths_and_barriers", f"""WITH RECURSIVE {EDGES}, {_UND},
    p AS (SELECT CAST(9 AS BIGINT) AS node, CAST(-1 AS BIGINT) AS prev, 0 AS hops, 0.0E0 AS d,
        CAST(NULL AS VARCHAR) AS b
      UNION ALL SELECT u.dst, p.node, hops + 1, d + km, coalesce(b, CASE WHEN barrier_type IN
        ('Falls', 'Rapids') THEN barrier_type END) FROM p JOIN u ON u.src = p.node
      WHERE u.dst <> p.prev)
    SELECT node, hops, round(d, 4) AS path_km, b AS blocking_barrier FROM p""")
def _(t):
    return G.paths_from(edges(t), node(t, 9), F.lit("creek chub")).select(
        "node", "hops", F.round("path_km", 4).alias("path_km"), "blocking_barrier")


@query("h6_nearest_upstream_station", f"""WITH RECURSIVE {EDGES},
    w AS (SELECT s_suppkey AS station, s_suppkey * 13 + 1 AS node, 0.0E0 AS d FROM supplier
      UNION ALL SELECT station, e.dst, d + km FROM w JOIN e ON w.node = e.src WHERE d + km <= 15),
    m AS (SELECT station, node, min(d) AS d FROM w GROUP BY 1, 2)
    SELECT ogf_id, station_id, round(dist, 4) AS distance_km FROM (
      SELECT ogf_id, station AS station_id, d + km AS dist, row_number() OVER (PARTITION BY ogf_id
        ORDER BY d + km, station) AS rn FROM m JOIN e ON m.node = e.src WHERE d + km <= 15)
    WHERE rn = 1""")
def _(t):
    stations = t.supplier.select(F.col("s_suppkey").alias("station_id"),
                                 (F.col("s_suppkey") * 13 + 1).alias("node"))
    return G.from_nearest_source(edges(t), stations, "station_id", 15.0).select(
        "ogf_id", "station_id", F.round("distance_km", 4).alias("distance_km"))


@query("h7_upstream_barrier_count", f"""WITH RECURSIVE {EDGES},
    w AS (SELECT ogf_id AS b, node, 0.0E0 AS d FROM barriers
      UNION ALL SELECT b, e.dst, d + km FROM w JOIN e ON w.node = e.src WHERE d + km <= 20),
    m AS (SELECT b, node, min(d) AS d FROM w GROUP BY 1, 2)
    SELECT ogf_id, count(DISTINCT b) AS n FROM m JOIN e ON m.node = e.src WHERE d + km <= 20
    GROUP BY 1""")
def _(t):
    return G.upstream_counts(edges(t), t.barriers.select("node"), 20.0)


ORDER = """fwd AS (SELECT ogf_id, start_node AS src, end_node AS dst FROM segments),
    nodes AS (SELECT node, CASE WHEN node = 0 THEN 0 ELSE 1 + CAST(floor(log2(node)) AS BIGINT) END
        AS depth FROM (SELECT src AS node FROM fwd UNION SELECT dst FROM fwd)),
    s AS (SELECT node, depth, CAST(1 AS BIGINT) AS ord FROM nodes
        WHERE depth = (SELECT max(depth) FROM nodes)
      UNION ALL
      SELECT node, depth, CASE WHEN mx IS NULL THEN 1 WHEN c >= 2 THEN mx + 1 ELSE mx END FROM (
        SELECT p.node, p.depth, max(k.ord) AS mx,
          count(*) FILTER (WHERE k.ord = k.top) AS c FROM nodes p
        JOIN (SELECT DISTINCT depth AS dd FROM s) x ON p.depth = x.dd - 1
        LEFT JOIN (SELECT ord, f.dst, max(ord) OVER (PARTITION BY f.dst) AS top FROM s
          JOIN fwd f ON f.src = s.node) k ON k.dst = p.node GROUP BY 1, 2)),
    o AS (SELECT ogf_id, src, dst, s.ord AS stream_order FROM fwd JOIN s ON s.node = fwd.src)"""


@query("h8_strahler_order", f"WITH RECURSIVE {ORDER} SELECT ogf_id, stream_order FROM o")
def _(t):
    return G.strahler(edges(t)).select("ogf_id", "stream_order")


@query("h9_passability", """
    SELECT barrier_type, sp AS species, CASE barrier_type WHEN 'Falls' THEN false
      WHEN 'Sea Lamprey Barrier' THEN NOT contains(sp, 'lamprey') WHEN 'Rapids' THEN
        contains(sp, 'trout') OR contains(sp, 'walleye') ELSE true END AS passes, count(*) AS n
    FROM (SELECT barrier_type, CASE ogf_id % 3 WHEN 0 THEN 'brook trout' WHEN 1 THEN
      'silver lamprey' ELSE 'creek chub' END AS sp FROM barriers) GROUP BY 1, 2, 3""")
def _(t):
    sp = F.when(F.col("ogf_id") % 3 == 0, "brook trout").when(
        F.col("ogf_id") % 3 == 1, "silver lamprey").otherwise("creek chub")
    return t.barriers.withColumn("species", sp).groupBy(
        "barrier_type", "species", G.can_pass(F.col("species"), F.col("barrier_type")).alias("passes")
    ).agg(F.count("*").alias("n"))


@query("h10_confluences", f"""WITH RECURSIVE {ORDER},
    ends AS (SELECT src AS node, stream_order FROM o UNION ALL SELECT dst, stream_order FROM o),
    c AS (SELECT node FROM ends GROUP BY 1 HAVING count(*) >= 3
      AND count(*) FILTER (WHERE stream_order >= 2) >= 2)
    SELECT ogf_id, src IN (SELECT node FROM c) OR dst IN (SELECT node FROM c) AS is_confluence FROM o""")
def _(t):
    from riffle.session import cut

    orders = cut(G.strahler(edges(t)))
    hit = G.confluence_segments(orders, G.confluence_nodes(orders)).withColumn("hit", F.lit(True))
    return orders.join(hit, "ogf_id", "left").select(
        "ogf_id", F.coalesce("hit", F.lit(False)).alias("is_confluence"))


@query("h11_prune_to_sources", f"""WITH {EDGES},
    wild AS (SELECT clat AS lat, clng AS lng FROM parks),
    box AS (SELECT min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM wild),
    pos AS (SELECT ogf_id AS node, lat, lng FROM segments, box WHERE
      lat BETWEEN s - 15/111.0 AND n + 15/111.0 AND lng BETWEEN w - 15/80.5 AND box.e + 15/80.5)
    SELECT count(*) AS n, CAST(sum(ogf_id) AS BIGINT) AS key_sum FROM e
    WHERE src IN (SELECT node FROM pos) AND dst IN (SELECT node FROM pos)""".replace(
    "FROM segments, box", "FROM segments JOIN box ON true"))
def _(t):
    pos = t.segments.select(F.col("ogf_id").alias("node"), "lat", "lng")
    src = t.parks.select(
        F.col("clat").alias("lat"), F.col("clng").alias("lng"))
    return G.near_sources(edges(t), pos, src, 15.0).agg(
        F.count("*").alias("n"), F.sum("ogf_id").alias("key_sum"))


NODE_POS = "SELECT DISTINCT p_partkey + 1 AS node, {0} AS lat, {1} AS lng FROM part"


def node_positions(t):
    from riffle.domain import lat, lng

    return t.part.selectExpr("p_partkey + 1 AS node", f"{lat('p_partkey + 1', 13)} AS lat",
                             f"{lng('p_partkey + 1', 13)} AS lng")


def _pos_sql():
    from riffle.domain import lat, lng

    return NODE_POS.format(lat("p_partkey + 1", 13), lng("p_partkey + 1", 13))


@query("h12_snap_to_node", f"""WITH pos AS ({_pos_sql()})
    SELECT gbif_key, node FROM (SELECT a.gbif_key, b.node, row_number() OVER
        (PARTITION BY a.gbif_key ORDER BY sqrt(power(a.lat - b.lat, 2) + power(a.lng - b.lng, 2)),
         b.node) AS rn FROM gbif a JOIN pos b
      ON sqrt(power(a.lat - b.lat, 2) + power(a.lng - b.lng, 2)) <= 0.15) WHERE rn = 1""")
def _(t):
    from riffle.operators import spatial as S

    out = S.with_nearest(t.gbif, node_positions(t), S.DEGREES, "node", bound=0.15, how="inner")
    return out.select("gbif_key", F.col("near_node").alias("node"))


_BOX = "lat BETWEEN 44.0 - 60.0 / 111.0 AND 44.0 + 60.0 / 111.0 AND lng BETWEEN -79.5 - 60.0 / 111.0 AND -79.5 + 60.0 / 111.0"


def _connected_sql(chosen: str, blocks: str) -> str:
    """Nearest nodes of the records around, and the path from the question's node: the network is a tree."""
    return f"""WITH RECURSIVE {EDGES}, {_UND}, pos AS ({_pos_sql()}),
    rec AS (SELECT 'i' || observation_id AS obs_id, species, common_name, lat, lng, coalesce(nullif(place_guess, ''), 'nearby') AS place_guess
        FROM observations WHERE {_BOX}
      UNION ALL SELECT 'g' || gbif_key, species, common_name, lat, lng, 'nearby' FROM gbif WHERE {_BOX}),
    asked AS ({chosen}),
    snapped AS (SELECT asked.*, pos.node, row_number() OVER (PARTITION BY obs_id ORDER BY
        sqrt(power(asked.lat - pos.lat, 2) + power(asked.lng - pos.lng, 2)), pos.node) AS rn
      FROM asked JOIN pos ON abs(asked.lat - pos.lat) <= 0.2 AND abs(asked.lng - pos.lng) <= 0.2
        AND sqrt(power(asked.lat - pos.lat, 2) + power(asked.lng - pos.lng, 2)) <= 0.2),
    origin AS (SELECT node FROM pos WHERE sqrt(power(lat - 44.0, 2) + power(lng + 79.5, 2)) <= 0.2
      ORDER BY sqrt(power(lat - 44.0, 2) + power(lng + 79.5, 2)), node LIMIT 1),
    p AS (SELECT node, CAST(-1 AS BIGINT) AS prev, 0.0E0 AS d, CAST([] AS VARCHAR[]) AS met FROM origin
      UNION ALL SELECT u.dst, p.node, d + km, list_append(met, barrier_type) FROM p JOIN u ON u.src = p.node WHERE u.dst <> p.prev),
    connected AS (SELECT s.species, obs_id, lat, lng, place_guess, round(d, 2) AS distance_km,
        list_filter(met, lambda k: {blocks})[1] AS blocking_barrier
      FROM snapped s JOIN p ON s.node = p.node WHERE rn = 1)"""


_TOP = """SELECT * FROM rec WHERE species IN (SELECT species FROM (SELECT species, count(*) AS n FROM rec GROUP BY 1)
      ORDER BY n DESC, species LIMIT 3)"""
_NAMED = """SELECT * REPLACE ('4-NOT SPECIFIED' AS species) FROM rec
      WHERE lower(species) LIKE '%4-not specified%' OR lower(common_name) LIKE '%4-not specified%'"""
#: None of the species' names is a strong swimmer's or a lamprey's.
_WEAK = "k IN ('Falls', 'Rapids')"


@query("h13_watershed", _connected_sql(_TOP, _WEAK) + " SELECT * FROM connected")
def _(t):
    from riffle.plans.watershed import analyze

    return analyze(edges(t), node_positions(t), t.observations, t.gbif, 44.0, -79.5,
                   snap_deg=0.2, radius_km=60.0)


@query("h14_connectivity_text", _connected_sql(_NAMED, _WEAK) + """,
    free AS (SELECT species, distance_km, place_guess FROM connected WHERE blocking_barrier IS NULL ORDER BY distance_km, obs_id LIMIT 1),
    shut AS (SELECT species, distance_km, place_guess, blocking_barrier FROM connected WHERE blocking_barrier IS NOT NULL ORDER BY distance_km, obs_id LIMIT 1),
    g AS (SELECT species, count(*) AS records FROM connected GROUP BY 1)
    SELECT species, records, f.distance_km AS open_km, s.distance_km AS blocked_km, s.blocking_barrier AS nearest_barrier, concat_ws(' ',
      '4-not Specified confirmed ' || printf('%.1f', f.distance_km) || 'km away near ' || f.place_guess ||
        ' — no barriers detected on the connecting reach. Stream connectivity is intact between that record and this location.',
      '4-not Specified also recorded ' || printf('%.1f', s.distance_km) || 'km away near ' || s.place_guess || ', but ' ||
        CASE s.blocking_barrier WHEN 'Falls' THEN 'a waterfall that is impassable for this species'
          ELSE 'rapids that may limit upstream movement for small-bodied fish' END || ' lies on the intervening reach.') AS summary
    FROM g LEFT JOIN free f USING (species) LEFT JOIN shut s USING (species)""")
def _(t):
    from riffle.plans.watershed import analyze, narrative

    found = analyze(edges(t), node_positions(t), t.observations, t.gbif, 44.0, -79.5,
                    species="4-NOT SPECIFIED", snap_deg=0.2, radius_km=60.0)
    return narrative(found)
