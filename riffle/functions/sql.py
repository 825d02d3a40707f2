"""The expressions that questions lean on, as temporary SQL functions of a session.

Each is one SQL expression, so Catalyst inlines it where it is called: filters on a box of coordinates still reach the
scan, and nothing runs outside the JVM. The bodies are made from the same tables and constants as the column functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from riffle.functions import geo
from riffle.operators.graph import LAMPREY, STRONG_SWIMMERS


def _text(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "\\'") + "'"


def _first_box(boxes, otherwise=None) -> str:
    rules = " ".join(f"WHEN lat BETWEEN {s!r} AND {n!r} AND lng BETWEEN {w!r} AND {e!r} THEN {_text(label)}" for label, s, n, w, e in boxes)
    return f"CASE {rules} ELSE {_text(otherwise)} END"


def _named_like(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(species), {_text(w)})" for w in words) + ")"


def _points(*names: str) -> str:
    return ", ".join(f"{n} DOUBLE" for n in names)


_PAIR = _points("lat1", "lng1", "lat2", "lng2")
#: name: (parameters, type, body)
FUNCTIONS = {
    "hav_km": (_PAIR, "DOUBLE", f"{2 * geo.EARTH_KM!r}D * asin(sqrt(least(pow(sin(radians(lat2 - lat1) / 2), 2D) + cos(radians(lat1)) * cos(radians(lat2)) "
                                "* pow(sin(radians(lng2 - lng1) / 2), 2D), 1D)))"),
    "bearing8": (_PAIR, "STRING", "element_at(array(" + ", ".join(map(_text, geo.BEARINGS)) + "), "
                 "CAST(floor((pmod(degrees(atan2(lng2 - lng1, lat2 - lat1)), 360D) + 22.5D) / 45D) AS INT) % 8 + 1)"),
    "fmz": (_points("lat", "lng"), "INT", _first_box(geo.FMZ_BOXES)),
    "jurisdiction": (_points("lat", "lng"), "STRING", _first_box(geo.JURISDICTION_BOXES, "UNKNOWN")),
    "can_pass": ("species STRING, barrier STRING", "BOOLEAN", "CASE WHEN barrier = 'Falls' THEN false "
                 f"WHEN barrier = 'Sea Lamprey Barrier' THEN species IS NULL OR NOT {_named_like(LAMPREY)} "
                 f"WHEN barrier = 'Rapids' THEN species IS NULL OR {_named_like(STRONG_SWIMMERS)} ELSE true END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
