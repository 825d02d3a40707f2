"""Queries written in SQL against the registered functions."""

from riffle.catalog.registry import query
from riffle.functions import geo
from riffle.functions.sql import register


def _boxes(boxes, otherwise="NULL"):
    rules = " ".join(f"WHEN lat BETWEEN {s} AND {n} AND lng BETWEEN {w} AND {e} THEN {label!r}" for label, s, n, w, e in boxes)
    return f"CASE {rules} ELSE {otherwise} END"


def run(t, text, **tables):
    register(t.spark)
    return t.spark.sql(text, **tables)


@query("o1_sql_hav_km", """
    SELECT osm_id, round(2 * 6371.0 * asin(sqrt(least(power(sin(radians(lat - 44.0) / 2), 2) + cos(radians(44.0)) * cos(radians(lat))
      * power(sin(radians(lng + 79.5) / 2), 2), 1))), 6) AS km FROM access""")
def _(t):
    return run(t, "SELECT osm_id, round(hav_km(44.0D, -79.5D, lat, lng), 6) AS km FROM {a}", a=t.access)


@query("o2_sql_bearing8", """
    SELECT direction, count(*) AS n FROM (SELECT (['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'])
      [CAST(floor((((degrees(atan2(lng + 79.5, lat - 44.0)) % 360) + 360) % 360 + 22.5) / 45) AS INT) % 8 + 1] AS direction FROM observations) GROUP BY 1""")
def _(t):
    return run(t, "SELECT bearing8(44.0D, -79.5D, lat, lng) AS direction, count(*) AS n FROM {o} GROUP BY 1", o=t.observations)


@query("o3_sql_zones", f"""
    SELECT zone, place, count(*) AS n, count(DISTINCT species) AS species FROM (SELECT species, {_boxes(geo.FMZ_BOXES)} AS zone,
      {_boxes(geo.JURISDICTION_BOXES, "'UNKNOWN'")} AS place FROM observations) GROUP BY ALL""")
def _(t):
    return run(t, "SELECT fmz(lat, lng) AS zone, jurisdiction(lat, lng) AS place, count(*) AS n, count(DISTINCT species) AS species FROM {o} GROUP BY 1, 2", o=t.observations)


@query("o4_sql_can_pass", """
    SELECT barrier_type, s.species, count(*) AS n, CASE WHEN barrier_type = 'Falls' THEN false
        WHEN barrier_type = 'Rapids' THEN coalesce(regexp_matches(lower(species), 'salmon|trout|bass|pike|walleye|muskie|muskellunge|carp|steelhead|perch|catfish|bullhead'), true)
        WHEN barrier_type = 'Sea Lamprey Barrier' THEN coalesce(NOT contains(lower(species), 'lamprey'), true) ELSE true END AS passes
    FROM barriers, (SELECT unnest(['Brook Trout', 'walleye', 'creek chub', 'Sea Lamprey', NULL]) AS species) s GROUP BY ALL""")
def _(t):
    return run(t, """SELECT barrier_type, species, count(*) AS n, can_pass(species, barrier_type) AS passes
        FROM {b} LATERAL VIEW explode(array('Brook Trout', 'walleye', 'creek chub', 'Sea Lamprey', NULL)) x AS species
        GROUP BY barrier_type, species""", b=t.barriers)
