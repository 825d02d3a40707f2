"""Domain tables derived from the star-schema test tables.

Each relation is one SELECT over the base tables, written in the SQL that Spark and other ANSI
engines share, so that a query and its cross-check read the same derived data. Coordinates come
from integer arithmetic on the key, which is exact everywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPECIES = [
    "Semotilus atromaculatus", "Lepomis gibbosus", "Perca flavescens", "Ameiurus nebulosus",
    "Catostomus commersonii",
]


def lat(k: str, salt: int) -> str:
    return f"((42000 + (({k}) * 7919 + {salt}) % 4001) / 1000.0E0)"


def lng(k: str, salt: int) -> str:
    return f"((-83000 + (({k}) * 6007 + {salt}) % 7001) / 1000.0E0)"


def at(k: str, salt: int, prefix: str = "") -> str:
    return f"{lat(k, salt)} AS {prefix}lat, {lng(k, salt)} AS {prefix}lng"


def point_text(k: str, salt: int) -> str:
    """'lng lat' with three decimals, spelled from integers."""
    a, o = f"(42000 + (({k}) * 7919 + {salt}) % 4001)", f"(83000 - (({k}) * 6007 + {salt}) % 7001)"
    spell = lambda v: (
        f"CAST(CAST(FLOOR({v} / 1000) AS BIGINT) AS STRING) || '.' || "
        f"LPAD(CAST(({v}) % 1000 AS STRING), 3, '0')"
    )
    return f"'-' || {spell(o)} || ' ' || {spell(a)}"


_UP = "(p_partkey + 1)"
_DOWN = "CAST(FLOOR((p_partkey + 1) / 2) AS BIGINT)"

RELATIONS: dict[str, str] = {
    "segments": f"""
        SELECT p_partkey AS ogf_id, {_UP} AS start_node, {_DOWN} AS end_node,
               p_retailprice * 3 AS length_m,
               CASE WHEN p_size % 3 = 0 THEN p_name END AS name,
               CASE WHEN p_type = 'ECONOMY' THEN 'Virtual Flow' ELSE 'Stream' END
                   AS watercourse_type,
               p_size % 4 <> 0 AS flow_verified, 'CA-ON' AS jurisdiction,
               {at("p_partkey", 11)},
               'LINESTRING (' || {point_text(_UP, 13)} || ', ' || {point_text(_DOWN, 13)} || ')'
                   AS geom_wkt
        FROM part""",
    "barriers": f"""
        SELECT s_suppkey AS ogf_id,
               CASE s_nationkey % 4 WHEN 0 THEN 'Falls' WHEN 1 THEN 'Rapids'
                    WHEN 2 THEN 'Rocks' ELSE 'Sea Lamprey Barrier' END AS barrier_type,
               s_suppkey * 17 AS nearest_segment_ogf_id, s_suppkey * 17 + 1 AS node,
               {at("s_suppkey", 83)}
        FROM supplier""",
    "observations": f"""
        SELECT o_orderkey AS observation_id, o_orderpriority AS species,
               o_orderpriority AS common_name, o_custkey AS taxon_id, {at("o_orderkey", 29)},
               CAST(o_orderdate AS DATE) AS observed_on,
               CASE WHEN o_orderstatus = 'P' THEN 'obscured' ELSE 'open' END AS geoprivacy,
               o_orderstatus = 'P' AS is_obscured,
               CASE WHEN o_custkey % 4 <> 0 THEN 'place ' || CAST(o_custkey AS STRING) END
                   AS place_guess,
               o_totalprice AS amount
        FROM orders""",
    "gbif": f"""
        SELECT c_custkey AS gbif_key,
               CASE c_mktsegment WHEN 'FURNITURE' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-high'
                    WHEN 'BUILDING' THEN '3-MEDIUM' WHEN 'AUTOMOBILE' THEN '4-not specified'
                    ELSE c_mktsegment END AS species,
               CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS common_name,
               {at("c_custkey", 47)},
               CASE WHEN c_nationkey % 5 <> 0
                    THEN DATE '1995-01-01' + CAST(c_custkey % 2000 AS INT) END AS observed_on,
               CASE c_nationkey % 3 WHEN 0 THEN 'PRESERVED_SPECIMEN' WHEN 1 THEN 'OCCURRENCE'
                    ELSE 'HUMAN_OBSERVATION' END AS basis_of_record,
               CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS coordinate_uncertainty_m
        FROM customer""",
    "readings": f"""
        SELECT l_orderkey * 10 + l_linenumber AS record_id, l_suppkey AS station_id,
               'Station ' || CAST(l_suppkey AS STRING) AS station_name, {at("l_suppkey", 83)},
               CAST(l_shipdate AS DATE) AS sampled_at,
               CASE WHEN l_linenumber % 7 <> 0 THEN l_tax * 100 END AS do_mgl,
               5 + l_discount * 50 AS ph, l_quantity / 2 AS temp_c,
               l_extendedprice AS conductivity_us_cm,
               CASE WHEN l_returnflag = 'A' THEN l_quantity END AS turbidity_fnu
        FROM lineitem""",
    "stocking": f"""
        SELECT l_orderkey * 10 + l_linenumber AS record_id, p_name AS waterbody_name,
               p_brand AS species, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS year,
               CAST(l_quantity AS BIGINT) AS quantity,
               CASE l_returnflag WHEN 'A' THEN 'Catchable' WHEN 'N' THEN 'Fry' END AS life_stage,
               l_partkey AS site, {at("l_partkey", 67)}
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "taxa": """
        SELECT l_orderkey AS site_visit_id,
               CASE WHEN l_partkey % 40 < 4 THEN 'Baetidae' WHEN l_partkey % 40 < 8 THEN 'Perlidae'
                    WHEN l_partkey % 40 < 12 THEN 'Limnephilidae' WHEN l_partkey % 40 < 16 THEN ''
                    ELSE 'Family' || CAST(l_partkey % 40 AS STRING) END AS family,
               CASE WHEN l_partkey % 40 < 4 THEN 'Ephemeroptera'
                    WHEN l_partkey % 40 < 8 THEN 'Plecoptera'
                    WHEN l_partkey % 40 < 14 THEN 'Trichoptera' ELSE 'Diptera' END AS taxon_order,
               CASE WHEN l_linenumber = 7 THEN 0.0E0 ELSE l_quantity END AS n
        FROM lineitem""",
    "visits": f"""
        SELECT o_orderkey AS site_visit_id, 'S' || CAST(o_custkey AS STRING) AS site_code,
               'Site ' || CAST(o_custkey AS STRING) AS site_name,
               CASE WHEN o_orderstatus = 'P' THEN 'ON' ELSE 'QC' END AS province,
               {at("o_custkey", 31)}, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS sampled_year,
               CAST(o_custkey % 6 + 1 AS BIGINT) AS stream_order
        FROM orders""",
    "geology": f"""
        SELECT c_custkey AS unit_id,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'coarse' WHEN 'MACHINERY' THEN 'mixed'
                    WHEN 'BUILDING' THEN 'fine' WHEN 'AUTOMOBILE' THEN 'bedrock'
                    ELSE 'organic' END AS substrate_class,
               CAST(c_nationkey AS BIGINT) AS unit_code, {at("c_custkey", 71)}
        FROM customer""",
    "access": f"""
        SELECT c_custkey AS osm_id,
               CASE c_nationkey % 10 WHEN 0 THEN 'road' WHEN 1 THEN 'parking'
                    WHEN 2 THEN 'building' WHEN 3 THEN 'boat_launch' WHEN 4 THEN 'fishing_spot'
                    WHEN 5 THEN 'park' WHEN 6 THEN 'conservation_area' WHEN 7 THEN 'public_land'
                    WHEN 8 THEN 'road' ELSE 'trail_head' END AS access_type,
               CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, {at("c_custkey", 53)}
        FROM customer""",
    "water": f"""
        SELECT s_suppkey AS osm_id,
               CASE s_nationkey % 5 WHEN 0 THEN 'pond' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'lake'
                    WHEN 3 THEN 'river' ELSE 'ditch' END AS feature_type,
               CASE WHEN s_suppkey % 4 <> 3 THEN s_name END AS name, {at("s_suppkey", 59)},
               CASE WHEN s_nationkey % 5 <> 3 THEN ABS(s_acctbal) * 10 END AS area_m2
        FROM supplier""",
    "birds": f"""
        SELECT event_id AS obs_id,
               CASE event_type WHEN 'view' THEN 'grbher3' WHEN 'signup' THEN 'osprey1'
                    WHEN 'click' THEN 'belkin1' WHEN 'purchase' THEN 'commer1'
                    ELSE 'doccor' END AS species_code,
               {at("user_id", 61)}, CAST(ts AS DATE) AS observed_on,
               CASE WHEN event_id % 6 <> 0 THEN CAST(FLOOR(value) AS INT) END AS how_many
        FROM events""",
    "gauges": """
        SELECT event_id AS reading_id, user_id % 20 AS station_id, ts,
               value / 100 AS level_m, CASE WHEN event_id % 9 <> 0 THEN value END AS discharge_cms
        FROM events""",
    "parks": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS park_id, {at("CAST(n_nationkey AS BIGINT)", 101, "c")},
               CASE n_nationkey % 6 WHEN 0 THEN 'Recreational' WHEN 1 THEN 'Waterway'
                    WHEN 2 THEN 'Natural Environment' WHEN 3 THEN 'Cultural Heritage'
                    WHEN 4 THEN 'Nature Reserve' ELSE 'Wilderness' END AS park_type
        FROM nation""",
    "predictions": " UNION ALL ".join(
        f"SELECT p_partkey AS ogf_id, '{s}' AS species, "
        f"((p_partkey * 31 + {i} * 17) % 1000) / 1000.0E0 AS prob, {at('p_partkey', 11)} FROM part"
        for i, s in enumerate(SPECIES)
    ),
    "trips": f"""
        SELECT c_custkey AS trip_id, {lat("c_custkey * 2", 11)} + 0.002E0 AS lat,
               {lng("c_custkey * 2", 11)} AS lng,
               DATE '2001-01-01' - CAST(c_custkey % 900 AS INT) AS trip_date,
               CASE WHEN c_custkey % 3 = 0 THEN 'planned' ELSE 'completed' END AS status,
               c_name AS location_name
        FROM customer""",
    "dismissed": "SELECT s_suppkey * 3 AS ogf_id, s_name AS reason FROM supplier",
    "insights": """
        SELECT event_id AS id, user_id, event_type AS species, value, ts AS created_at,
               CASE WHEN value < 20 THEN 'unverified' WHEN value < 80 THEN 'anecdotal'
                    ELSE 'confirmed' END AS confidence
        FROM events""",
    "feats": f"""
        SELECT p_partkey AS ogf_id, {at("p_partkey", 11, "centroid_")},
               CASE WHEN p_size % 3 = 0 THEN p_name END AS watercourse_name,
               CASE WHEN p_type = 'ECONOMY' THEN 'Virtual Flow' ELSE 'Stream' END
                   AS watercourse_type,
               CAST(p_partkey % 6 + 1 AS BIGINT) AS stream_order, p_retailprice * 3 AS length_m,
               CASE p_size % 4 WHEN 0 THEN 'coarse' WHEN 1 THEN 'mixed' WHEN 2 THEN 'fine'
                    ELSE 'unknown' END AS substrate_category,
               CASE p_size % 3 WHEN 0 THEN 'coldwater' WHEN 1 THEN 'coolwater' ELSE 'unknown' END
                   AS thermal_regime,
               CASE p_size % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'unknown' END
                   AS ept_quality,
               p_partkey % 9 = 0 AS is_confluence_segment,
               (p_partkey % 100) / 50.0E0 AS distance_to_nearest_confluence_km,
               CASE WHEN p_size % 2 = 0 THEN (p_partkey % 500) * 1.0E0 END
                   AS nearest_waterbody_distance_m,
               p_size % 2 = 0 AND p_partkey % 500 <= 200 AS connected_to_waterbody
        FROM part""",
    "scored_access": """
        SELECT p_partkey AS ogf_id, ((p_partkey * 37) % 1000) / 1000.0E0 AS access_score,
               p_partkey % 11 = 0 AS is_crown_land
        FROM part""",
    "moments": """
        SELECT event_id AS moment_id,
               CASE user_id % 9 WHEN 0 THEN 'brook trout' WHEN 1 THEN 'smallmouth bass'
                    WHEN 2 THEN 'northern pike' WHEN 3 THEN 'walleye' WHEN 4 THEN 'channel catfish'
                    WHEN 5 THEN 'bluegill' WHEN 6 THEN 'common carp' WHEN 7 THEN 'rainbow darter'
                    ELSE 'bowfin' END AS species,
               CAST(event_id % 12 + 1 AS INT) AS month,
               CASE WHEN event_id % 7 <> 0 THEN value / 10 END AS temp_c,
               CASE event_id % 4 WHEN 0 THEN 'clear' WHEN 1 THEN 'stained' WHEN 2 THEN 'murky' END
                   AS clarity,
               CASE event_id % 5 WHEN 0 THEN 'falling' WHEN 1 THEN 'rising' WHEN 2 THEN 'steady' END
                   AS pressure,
               CASE event_id % 8 WHEN 0 THEN 'dawn' WHEN 1 THEN 'morning' WHEN 2 THEN 'midday'
                    WHEN 3 THEN 'afternoon' WHEN 4 THEN 'evening' WHEN 5 THEN 'dusk'
                    WHEN 6 THEN 'night' END AS time_of_day
        FROM events""",
    "ranges": """
        SELECT c_name AS species, c_custkey AS scientific_name,
               CASE WHEN c_nationkey % 2 = 0 THEN 'CA-ON' ELSE 'US-NY' END AS jurisdiction,
               CASE c_nationkey % 7 WHEN 0 THEN 'Endangered' WHEN 1 THEN 'Threatened'
                    WHEN 2 THEN 'Special Concern' WHEN 3 THEN 'Extirpated'
                    WHEN 4 THEN 'Not at Risk' WHEN 5 THEN 'No Status' END AS sara_status,
               CASE c_custkey % 5 WHEN 0 THEN 'Threatened' WHEN 1 THEN 'Endangered'
                    WHEN 2 THEN 'Special Concern' END AS ontario_status
        FROM customer""",
}



def with_relations(sql: str) -> str:
    """The query with a WITH entry in front for each derived relation it names."""
    body = sql.strip()
    used = [n for n in RELATIONS if re.search(rf"(?:FROM|JOIN|,)\s+{n}\b", body)]
    if not used:
        return body
    ctes = ", ".join(f"{n} AS ({' '.join(RELATIONS[n].split())})" for n in used)
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{ctes}, {body[head.end():]}"
    return f"WITH {ctes} {body}"


class Tables:
    """Base and derived tables of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        sql = RELATIONS[name]
        needed = [b for b in BASE if re.search(rf"(?:FROM|JOIN)\s+{b}\b", sql)]
        text = re.sub(
            r"((?:FROM|JOIN)\s+)(" + "|".join(needed) + r")\b", r"\1{\2}", sql
        )
        return self.spark.sql(text, **{b: self.base(b) for b in needed})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = self.base(name)
            elif name in RELATIONS:
                self._cache[name] = self.derived(name)
            else:
                raise AttributeError(name)
        return self._cache[name]
