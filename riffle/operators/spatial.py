"""Distributed point joins on a grid that refines itself where the data is dense.

Both sides are reduced to distinct locations, counted per grid cell, and matched cell by cell
first. A pair of cells leaves that loop as soon as its answer is known: too far apart (dropped),
wholly within range (answered from the per-cell sums), or few enough point pairs to compare the
points themselves. Only pairs that are still crowded are split into finer cells, so a cell holding
a large share of all rows never turns into an all-pairs join or into one task, and what moves
through the shuffles is the cell tables and bounded candidate sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.functions import geo
from riffle.session import cut, spread

MAX_LEVEL = 24
LEVEL_STEP = 2
PAIR_LIMIT = 250_000
#: A pair of cells of a nearest search is split while both hold more points than this.
CROWD = 64
#: Point pairs of two cells whose points are compared as they are, in a radius search.
BLOCK_PAIRS = 1_000_000
#: Point pairs compared in one step: tables of these stay in a core's cache.
STEP_PAIRS = 1 << 14
#: Up to so many crowded cell pairs are split by two levels at once.
FEW_PAIRS = 20_000
#: Points of one cell beyond this are kept in several rows.
POINTS_PER_ROW = 256
_EPS = 1e-9


@dataclass(frozen=True)
class Metric:
    """How locations map to grid axes, and the exact distance the result is judged by."""

    axes: Callable[[Column, Column], list[Column]]
    distance: Callable[..., Column]
    between: Callable  # the same distance over numpy arrays
    dims: int = 2
    box: bool = False


def _xyz(lat: Column, lng: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lng)
    r = F.lit(geo.EARTH_KM)
    return [r * F.cos(a) * F.cos(o), r * F.cos(a) * F.sin(o), r * F.sin(a)]


def _flat(lat_scale: float, lng_scale: float):
    def between(la, lo, ra, ro):
        dy, dx = la * lat_scale - ra * lat_scale, lo * lng_scale - ro * lng_scale
        dy *= dy
        dx *= dx
        dy += dx
        return np.sqrt(dy, out=dy)

    return between


def _arcs(km: float):
    def between(la, lo, ra, ro):
        la, lo, ra, ro = (np.radians(x) for x in (la, lo, ra, ro))
        a = np.sin((ra - la) / 2) ** 2 + np.cos(la) * np.cos(ra) * np.sin((ro - lo) / 2) ** 2
        return 2 * km * np.arcsin(np.sqrt(np.minimum(a, 1.0)))

    return between


DEGREES = Metric(lambda la, lo: [la, lo], geo.euclid, _flat(1.0, 1.0))
KM_SCALED = Metric(
    lambda la, lo: [la * geo.KM_PER_DEGREE, lo * geo.KM_PER_DEGREE_LNG], geo.scaled_km,
    _flat(geo.KM_PER_DEGREE, geo.KM_PER_DEGREE_LNG),
)
# Chord length never exceeds arc length, so a radius in km is a safe chord bound.
HAVERSINE = Metric(_xyz, geo.haversine_km, _arcs(geo.EARTH_KM), dims=3)


def box_metric(stretch: float) -> Metric:
    """Square neighbourhoods whose longitude half-width is ``stretch`` times the latitude one."""
    return Metric(
        lambda la, lo: [la, lo / stretch],
        lambda a1, o1, a2, o2: F.greatest(
            F.abs(geo.num(a1) - geo.num(a2)), F.abs(geo.num(o1) - geo.num(o2)) / stretch
        ),
        lambda la, lo, ra, ro: np.maximum(np.abs(la - ra), np.abs(lo - ro) / stretch),
        box=True,
    )


def _located(df: DataFrame, metric: Metric, size: float, side: str) -> DataFrame:
    """Finest cell index per axis; coarser cells are this index shifted right."""
    fine = size / (1 << MAX_LEVEL)
    axes = metric.axes(F.col(f"{side}_lat"), F.col(f"{side}_lng"))
    for i, axis in enumerate(axes):
        df = df.withColumn(f"{side}f{i}", F.floor(axis / F.lit(fine)).cast("bigint"))
    return df


def _cell(side: str, i: int, level: int) -> Column:
    return F.shiftright(F.col(f"{side}f{i}"), MAX_LEVEL - level)


def _cells(df: DataFrame, metric: Metric, level: int, side: str, sums: list[str]) -> DataFrame:
    keys = [_cell(side, i, level).alias(f"{side}c{i}") for i in range(metric.dims)]
    return df.groupBy(*keys).agg(
        F.count("*").alias(f"{side}n"), *[F.sum(s).alias(s) for s in sums]
    )


def _gap(metric: Metric, size: float, furthest: bool) -> Column:
    """Smallest (or largest) possible distance between points of two cells."""
    parts = []
    for i in range(metric.dims):
        steps = F.abs(F.col(f"lc{i}") - F.col(f"rc{i}"))
        steps = steps + 1 if furthest else F.greatest(steps - 1, F.lit(0))
        parts.append(steps.cast("double") * size)
    if metric.box:
        return F.greatest(*parts)
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _first_pairs(left: DataFrame, right: DataFrame, metric: Metric, sums: list[str]) -> DataFrame:
    """Neighbouring cell pairs at the coarsest level, whose cells are as wide as the range."""
    dims = range(metric.dims)
    lcells = _cells(left, metric, 0, "l", [])
    offsets = F.explode(F.array(*[
        F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(combo)])
        for combo in product((-1, 0, 1), repeat=metric.dims)
    ]))
    near = lcells.withColumn("o", offsets).select(
        *[f"lc{i}" for i in dims], "ln",
        *[(F.col(f"lc{i}") + F.col(f"o.o{i}")).alias(f"rc{i}") for i in dims],
    )
    return near.join(_cells(right, metric, 0, "r", sums), [f"rc{i}" for i in dims])


def _split(heavy: DataFrame, left: DataFrame, right: DataFrame, metric: Metric, level: int,
           step: int, sums: list[str], keep: list[str]) -> DataFrame:
    """Replace each crowded cell pair by the pairs of its child cells."""
    dims = range(metric.dims)
    out = heavy.select(
        *[F.col(f"lc{i}").alias(f"lp{i}") for i in dims],
        *[F.col(f"rc{i}").alias(f"rp{i}") for i in dims], *keep,
    )
    for side, frame, carried in (("l", left, []), ("r", right, sums)):
        child = _cells(frame, metric, level + step, side, carried)
        for i in dims:
            child = child.withColumn(f"{side}p{i}", F.shiftright(f"{side}c{i}", step))
        out = out.join(child, [f"{side}p{i}" for i in dims]).drop(*[f"{side}p{i}" for i in dims])
    return out


def _point_gap(metric: Metric, size: float, level: int) -> Column:
    """Smallest possible distance between a left point and a point of the right cell."""
    wide, fine = 1 << (MAX_LEVEL - level), size / (1 << MAX_LEVEL)
    parts = []
    for i in range(metric.dims):
        start, at = F.col(f"rc{i}") * wide, F.col(f"lf{i}")
        parts.append(F.greatest(start - at - 1, at - start - wide, F.lit(0)).cast("double") * fine)
    return F.greatest(*parts) if metric.box else F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _at_level(df: DataFrame, metric: Metric, level: int, side: str, keep: bool = False) -> DataFrame:
    """The points of one side, keyed by their cell at ``level``."""
    for i in range(metric.dims):
        df = df.withColumn(f"{side}c{i}", _cell(side, i, level))
    return df if keep else df.drop(*[f"{side}f{i}" for i in range(metric.dims)])


def _pieces(cells: DataFrame, points: DataFrame, metric: Metric, level: int, side: str) -> DataFrame:
    """The points of the named cells as arrays of structs (``{side}items``), few enough to a row."""
    keys = [f"{side}c{i}" for i in range(metric.dims)]
    placed = _at_level(points, metric, level, side)
    held = [c for c in placed.columns if c not in keys]
    held.sort(key=lambda c: c != "best")  # the order in which equal distances are chosen
    piece = F.pmod(F.xxhash64(f"{side}_lat", f"{side}_lng"), F.ceil(F.col(f"{side}n") / POINTS_PER_ROW))
    return placed.join(cells.select(*keys, f"{side}n").distinct(), keys).groupBy(*keys, piece.alias("_piece")).agg(
        F.sort_array(F.collect_list(F.struct(*held))).alias(f"{side}items")).drop("_piece")


def _steps(n: int, m: int):
    """Slices of ``n`` points that meet ``m`` points each."""
    size = max(1, STEP_PAIRS // max(m, 1))
    return (slice(i, i + size) for i in range(0, n, size))


def _close_sums(pairs: DataFrame, left: DataFrame, right: DataFrame, metric: Metric, level: int,
                radius: float, names: list[str]) -> DataFrame:
    """Sums over the points in range of the settled cell pairs: blocks of points against blocks of points."""
    dims = range(metric.dims)
    lk, rk = [f"lc{i}" for i in dims], [f"rc{i}" for i in dims]
    met = pairs.select(*lk, *rk).join(_pieces(pairs, left, metric, level, "l"), lk).drop(*lk)
    blocks = spread(met, *rk).join(_pieces(pairs, right, metric, level, "r"), rk).select(
        "litems.l_lat", "litems.l_lng", "ritems.r_lat", "ritems.r_lng", *[F.col(f"ritems.{n}") for n in names])
    between = metric.between
    fields = [right.schema[n] for n in names]
    shape = T.StructType([left.schema["l_lat"], left.schema["l_lng"], *fields])
    whole = [isinstance(f.dataType, T.LongType) for f in fields]

    def compare(batches):
        for batch in batches:
            bounds = [np.asarray(c.offsets) for c in batch.columns]
            flat = [np.asarray(c.values.to_numpy(zero_copy_only=False)) for c in batch.columns]
            lats, lngs, found = [], [], [[] for _ in names]
            for i in range(batch.num_rows):
                la, lo, ra, ro, *values = (v[b[i]:b[i + 1]] for v, b in zip(flat, bounds))
                same = [exact and (v == v[0]).all() for v, exact in zip(values, whole)]
                for s in _steps(len(la), len(ra)):
                    hit = between(la[s, None], lo[s, None], ra, ro) <= radius
                    n = np.add.reduce(hit.view(np.uint8), axis=1, dtype=np.int64)
                    some = np.flatnonzero(n)
                    if not len(some):
                        continue
                    lats.append(la[s][some])
                    lngs.append(lo[s][some])
                    if not all(same):
                        hit = hit[some]
                    for out, v, exact, one in zip(found, values, whole, same):
                        if one:
                            out.append(n[some] * v[0])
                        elif exact or not np.isfinite(v).all():
                            out.append(np.where(hit, v, v.dtype.type(0)).sum(axis=1))
                        else:
                            out.append(hit @ v)
            if lats:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (lats, lngs)]
                    + [pa.array(np.concatenate(x).astype("int64" if e else "float64")) for x, e in zip(found, whole)],
                    names=["l_lat", "l_lng", *names])

    return blocks.mapInArrow(compare, shape)


def _segment_between(la, lo, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = np.where(len2 > 0, ((lo - x1) * dx + (la - y1) * dy) / np.where(len2 > 0, len2, 1.0), 0.0)
    t = np.minimum(np.maximum(t, 0.0), 1.0)
    ex, ey = lo - (x1 + t * dx), la - (y1 + t * dy)
    return np.sqrt(ex * ex + ey * ey)


def _closest(blocks: DataFrame, right: DataFrame, between: Callable, coords: list[str]) -> DataFrame:
    """l_lat, l_lng, m (distance, best) of each point of ``litems`` and the closest of ``ritems``, which are in order
    of ``best``: the first of equal distances is the smallest."""
    cols = blocks.select("litems.l_lat", "litems.l_lng", *[F.col(f"ritems.{c}") for c in coords], "ritems.best")
    shape = T.StructType([T.StructField("l_lat", T.DoubleType()), T.StructField("l_lng", T.DoubleType()),
                          T.StructField("distance", T.DoubleType()), right.schema["best"]])

    def compare(batches):
        for batch in batches:
            *columns, best = batch.columns
            bounds = [np.asarray(c.offsets) for c in columns]
            flat = [np.asarray(c.values.to_numpy(zero_copy_only=False)) for c in columns]
            lats, lngs, far, at = [], [], [], []
            for i in range(batch.num_rows):
                la, lo, *there = (v[b[i]:b[i + 1]] for v, b in zip(flat, bounds))
                for s in _steps(len(la), len(there[0])):
                    d = between(la[s, None], lo[s, None], *there)
                    d[np.isnan(d)] = np.inf
                    j = d.argmin(axis=1)
                    lats.append(la[s])
                    lngs.append(lo[s])
                    far.append(d[np.arange(len(j)), j])
                    at.append(j + bounds[-1][i])
            if lats:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (lats, lngs, far)] + [best.values.take(pa.array(np.concatenate(at)))],
                    names=["l_lat", "l_lng", "distance", "best"])

    return cols.mapInArrow(compare, shape).select("l_lat", "l_lng", F.struct("distance", "best").alias("m"))


def _sites(df: DataFrame, lat: str, lng: str, side: str, aggs: list[Column]) -> DataFrame:
    usable = df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    keys = [F.col(lat).cast("double").alias(f"{side}_lat"),
            F.col(lng).cast("double").alias(f"{side}_lng")]
    grouped = usable.groupBy(*keys)
    return grouped.agg(*aggs) if aggs else usable.select(*keys).distinct()


def radius_sums(left: DataFrame, right: DataFrame, radius: float, metric: Metric,
                sums: dict[str, Column], left_at=("lat", "lng"), right_at=("lat", "lng"),
                pair_limit: int = BLOCK_PAIRS) -> DataFrame:
    """Per distinct left location, each named sum over the right rows within ``radius``.

    Sums are bigint or double. Locations with nothing in range are absent. Result columns: l_lat, l_lng
    and the sum names.
    """
    names = list(sums)
    kinds = dict(right.select(*[e.alias(n) for n, e in sums.items()]).dtypes)
    exact = {"tinyint", "smallint", "int", "bigint"}
    total = lambda n, e: F.coalesce(F.sum(e.cast("bigint" if kinds[n] in exact else "double")), F.lit(0))
    size = radius * (1 + _EPS)
    # every level reads both sides several times: write them once
    lsites = cut(_located(_sites(left, *left_at, "l", []), metric, size, "l"))
    rsites = cut(_located(
        _sites(right, *right_at, "r", [total(n, e).alias(n) for n, e in sums.items()]),
        metric, size, "r",
    ))
    dims = range(metric.dims)
    level = 0
    pairs = cut(_first_pairs(lsites, rsites, metric, names))
    parts = []
    while True:
        cell = size / (1 << level)
        pairs = pairs.where(_gap(metric, cell, False) <= radius * (1 + _EPS))
        inside = _gap(metric, cell, True) <= radius * (1 - _EPS)
        crowded = (F.col("ln") * F.col("rn") > pair_limit) if level < MAX_LEVEL else F.lit(False)
        if level > 0:
            whole = pairs.where(inside).groupBy(*[f"lc{i}" for i in dims]).agg(
                *[F.sum(n).alias(n) for n in names]
            )
            parts.append(
                _at_level(lsites, metric, level, "l").join(whole, [f"lc{i}" for i in dims])
                .select("l_lat", "l_lng", *names)
            )
            pairs = pairs.where(~inside)
        parts.append(_close_sums(pairs.where(~crowded), lsites, rsites, metric, level, radius, names))
        heavy = pairs.where(crowded)
        n = heavy.count()
        if not n:
            break
        # two levels at once make 256 pairs of one: far more than the rim of the circle needs where many are crowded
        step = min(LEVEL_STEP if n < FEW_PAIRS else 1, MAX_LEVEL - level)
        level += step
        near = _gap(metric, size / (1 << level), False) <= radius * (1 + _EPS)
        pairs = cut(_split(heavy, lsites, rsites, metric, level - step, step, names, []).where(near))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("l_lat", "l_lng").agg(*[F.sum(n).alias(n) for n in names])


def with_radius_sums(left: DataFrame, right: DataFrame, radius: float, metric: Metric,
                     sums: dict[str, Column], left_at=("lat", "lng"), right_at=("lat", "lng"),
                     **kw) -> DataFrame:
    """``left`` with the radius sums added as columns (0 where nothing is in range)."""
    found = radius_sums(left, right, radius, metric, sums, left_at, right_at, **kw)
    lat, lng = left_at
    joined = left.join(
        found, (left[lat] == found["l_lat"]) & (left[lng] == found["l_lng"]), "left"
    ).drop("l_lat", "l_lng")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})


def with_radius_count(left, right, radius, metric, name="n", **kw) -> DataFrame:
    return with_radius_sums(left, right, radius, metric, {name: F.lit(1).cast("bigint")}, **kw)


def _nearest_sites(lsites: DataFrame, rsites: DataFrame, bound: float, metric: Metric,
                   slack: float, pair_limit: int) -> DataFrame:
    """Best right site per left site within ``bound``: l_lat, l_lng, distance and ``best``.

    ``slack`` is how far a right item may reach beyond its listed location. Right items with x1, y1, x2
    and y2 are line pieces.
    """
    size = (bound + slack) * (1 + _EPS)
    lsites, rsites = cut(_located(lsites, metric, size, "l")), cut(_located(rsites, metric, size, "r"))
    dims = range(metric.dims)
    lk, rk = [f"lc{i}" for i in dims], [f"rc{i}" for i in dims]
    coords = [c for c in rsites.columns if c in ("x1", "y1", "x2", "y2")] or ["r_lat", "r_lng"]
    between = _segment_between if len(coords) > 2 else metric.between
    level, parts = 0, []
    pairs = cut(_first_pairs(lsites, rsites, metric, []).withColumn("ub", F.lit(bound)))
    while True:
        cell = size / (1 << level)
        low, high = _gap(metric, cell, False) - slack, _gap(metric, cell, True) + slack
        best = pairs.groupBy(*lk).agg(F.min(F.least(F.col("ub"), high)).alias("_ub"))
        pairs = cut(
            pairs.join(best, lk).withColumn("ub", F.col("_ub")).drop("_ub")
            .where(low <= F.col("ub") * (1 + _EPS) + _EPS)
        )
        crowded = ((F.col("ln") * F.col("rn") > pair_limit) | (F.least("ln", "rn") > CROWD)) if level < MAX_LEVEL else F.lit(False)
        settled = pairs.where(~crowded)
        # the likeliest cell first: what it gives bounds how far each point has to look
        first = settled.groupBy(*lk).agg(F.min_by(F.struct(*rk, "rn"), F.struct(high, low, *rk)).alias("r")).select(*lk, "r.*")
        tried = first.join(_pieces(first, rsites, metric, level, "r"), rk).select(*lk, "ritems")
        tried = spread(tried, *lk).join(_pieces(settled, lsites, metric, level, "l"), lk)
        bounded = _closest(tried, rsites, between, coords).groupBy("l_lat", "l_lng").agg(F.min("m").alias("m"))
        bounded = cut(_at_level(_located(bounded, metric, size, "l"), metric, level, "l", keep=True))
        rest = settled.join(first.select(*lk, *rk), [*lk, *rk], "left_anti").select(*lk, *rk, "ln", "rn")
        reach = F.least(F.col("m.distance"), F.lit(bound)) * (1 + _EPS) + _EPS
        piece = F.pmod(F.xxhash64("l_lat", "l_lng"), F.ceil(F.col("ln") / POINTS_PER_ROW))
        asked = rest.join(bounded, lk).where(_point_gap(metric, size, level) - slack <= reach).groupBy(
            *lk, *rk, piece.alias("_piece")).agg(F.collect_list(F.struct("l_lat", "l_lng")).alias("litems"))
        more = spread(asked, *rk).join(_pieces(rest, rsites, metric, level, "r"), rk)
        parts += [bounded.select("l_lat", "l_lng", "m"), _closest(more, rsites, between, coords)]
        heavy = pairs.where(crowded)
        n = heavy.count()
        if not n:
            break
        step = min(LEVEL_STEP if n < FEW_PAIRS else 1, MAX_LEVEL - level)
        level += step
        near = _gap(metric, size / (1 << level), False) - slack <= F.col("ub") * (1 + _EPS) + _EPS
        pairs = cut(_split(heavy, lsites, rsites, metric, level - step, step, [], ["ub"]).where(near))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.where(F.col("m.distance") <= bound).groupBy("l_lat", "l_lng").agg(F.min("m").alias("m"))
    return out.select("l_lat", "l_lng", "m.distance", "m.best")


def _spread(lsites: DataFrame, rsites: DataFrame, metric: Metric) -> tuple[float, float, int]:
    """Extent of both sides, mean spacing of the right side, and its size: one small row."""
    axes_of = lambda df, s: df.select(
        *[a.alias(f"a{i}") for i, a in enumerate(metric.axes(F.col(f"{s}_lat"), F.col(f"{s}_lng")))],
        F.lit(1 if s == "r" else 0).alias("is_r"),
    )
    both = axes_of(lsites, "l").unionByName(axes_of(rsites, "r"))
    row = both.agg(
        F.sum("is_r").alias("n"),
        *[F.min(f"a{i}").alias(f"lo{i}") for i in range(metric.dims)],
        *[F.max(f"a{i}").alias(f"hi{i}") for i in range(metric.dims)],
    ).first()
    if not row["n"]:
        return 0.0, 0.0, 0
    spans = [row[f"hi{i}"] - row[f"lo{i}"] for i in range(metric.dims)]
    extent = max(sum(s * s for s in spans) ** 0.5, 1e-6)
    top = sorted(spans)[-2:]
    spacing = max((max(top[0], 1e-6) * max(top[1], 1e-6) / row["n"]) ** 0.5, extent * 1e-6)
    return extent, spacing, row["n"]


def nearest(left: DataFrame, right: DataFrame, metric: Metric, key: str,
            carry: list[str] | None = None, bound: float | None = None,
            left_at=("lat", "lng"), right_at=("lat", "lng"),
            pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Nearest right row per distinct left location; ties go to the smallest ``key``.

    Result columns: l_lat, l_lng, distance, ``key`` and ``carry``. Without a bound the search
    widens fourfold per round for the locations still unmatched, starting at twice the mean
    spacing of the right side.
    """
    carry = [c for c in (carry or []) if c != key]
    item = F.struct(F.col(key).alias("k"), *[F.col(c) for c in carry],
                    F.col(right_at[0]).cast("double").alias("at_lat"),
                    F.col(right_at[1]).cast("double").alias("at_lng"))
    lsites = _sites(left, *left_at, "l", [])
    rsites = _sites(right, *right_at, "r", [F.min_by(item, F.col(key)).alias("best")])
    if bound is not None:
        found = _nearest_sites(lsites, rsites, bound, metric, 0.0, pair_limit)
    else:
        found = _widening(lsites, rsites, metric, pair_limit)
    return found.select(
        "l_lat", "l_lng", "distance", F.col("best.k").alias(key),
        *[F.col(f"best.{c}").alias(c) for c in carry],
        F.col("best.at_lat").alias("near_lat"), F.col("best.at_lng").alias("near_lng"),
    )


def _widening(lsites: DataFrame, rsites: DataFrame, metric: Metric, pair_limit: int) -> DataFrame:
    lsites, rsites = cut(lsites), cut(rsites)
    extent, spacing, n = _spread(lsites, rsites, metric)
    if n == 0:
        return _nearest_sites(lsites, rsites, 1.0, metric, 0.0, pair_limit)
    reach, open_sites, found = 2 * spacing, lsites, None
    while True:
        # arc lengths exceed chords, so leave room past the chord extent before stopping
        last = reach >= 2 * extent
        hits = cut(_nearest_sites(open_sites, rsites, reach, metric, 0.0, pair_limit))
        found = hits if found is None else found.unionByName(hits)
        if last:
            return found
        open_sites = open_sites.join(hits, ["l_lat", "l_lng"], "left_anti")
        if open_sites.isEmpty():
            return found
        open_sites = cut(open_sites)
        reach *= 4


def with_nearest(left: DataFrame, right: DataFrame, metric: Metric, key: str,
                 carry: list[str] | None = None, bound: float | None = None,
                 left_at=("lat", "lng"), right_at=("lat", "lng"), distance: str = "distance",
                 prefix: str = "near_", how: str = "left", **kw) -> DataFrame:
    """``left`` with the nearest right row's columns added under ``prefix``."""
    carry = [c for c in (carry or []) if c != key]
    found = nearest(left, right, metric, key, carry, bound, left_at, right_at, **kw)
    found = found.select(
        "l_lat", "l_lng", F.col("distance").alias(distance),
        *[F.col(c).alias(prefix + c) for c in [key, *carry]],
        F.col("near_lat").alias(prefix + "at_lat"), F.col("near_lng").alias(prefix + "at_lng"),
    )
    lat, lng = left_at
    return left.join(
        found, (left[lat] == found["l_lat"]) & (left[lng] == found["l_lng"]), how
    ).drop("l_lat", "l_lng")


def nearest_line(points: DataFrame, lines: DataFrame, bound_deg: float, line_key: str,
                 vertices: str, at=("lat", "lng"), piece_deg: float | None = None,
                 pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Nearest polyline per distinct point location within ``bound_deg`` (planar degrees).

    Lines are cut into short pieces that are found by their midpoints; the true point-to-piece
    distance decides, and the smallest line key breaks ties.
    """
    piece = piece_deg or bound_deg * 10
    whole = lines.select(F.col(line_key).alias("k"), F.explode(geo.edges_of(vertices)).alias("e"))
    dx, dy = F.col("e.x2") - F.col("e.x1"), F.col("e.y2") - F.col("e.y1")
    n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / piece), F.lit(1)).cast("int")
    pieces = whole.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    mid = (F.col("i") - 0.5) / F.col("n")
    rsites = pieces.select(
        (F.col("e.y1") + mid * dy).alias("r_lat"), (F.col("e.x1") + mid * dx).alias("r_lng"),
        F.struct("k").alias("best"),
        F.col("e.x1").alias("x1"), F.col("e.y1").alias("y1"),
        F.col("e.x2").alias("x2"), F.col("e.y2").alias("y2"),
    )
    rsites = rsites.groupBy("r_lat", "r_lng", "x1", "y1", "x2", "y2").agg(
        F.min("best").alias("best")
    )
    found = _nearest_sites(
        _sites(points, *at, "l", []), rsites, bound_deg, DEGREES, piece / 2, pair_limit
    )
    return found.select("l_lat", "l_lng", "distance", F.col("best.k").alias(line_key))


#: Cells along the longer side of a polygon: few for plain ones, more for rings of many vertices.
FEWEST_CELLS, MOST_CELLS = 8, 64
#: Edges of one cell beyond this are kept in several rows.
EDGES_PER_ROW = 4096
#: Where in a cell its reference point lies: off the places that vertices like to have.
_REF_X, _REF_Y = 0.51374692, 0.48710358


def _polygon_edges(polygons: DataFrame, ring: str) -> DataFrame:
    """pg and x1, y1, x2, y2 of every edge of every ring; rings that are not closed get their last edge.

    ``ring`` is one array of vertices, or an array of these: outer rings of all parts and holes alike.
    """
    many = isinstance(polygons.schema[ring].dataType.elementType, T.ArrayType)
    rings = polygons.select("pg", F.explode(ring).alias("v")) if many else polygons.select("pg", F.col(ring).alias("v"))
    rings = rings.where(F.size("v") >= 3)
    open_ = F.element_at("v", 1) != F.element_at("v", -1)
    closed = rings.withColumn("v", F.when(open_, F.concat("v", F.slice("v", 1, 1))).otherwise(F.col("v")))
    return closed.select("pg", F.explode(geo.edges_of("v")).alias("e")).select("pg", "e.*")


def _ring_cells(polygons: DataFrame, ring: str) -> tuple[DataFrame, DataFrame]:
    """Cells of each polygon (pg) at a level (lvl) fitting its size and number of edges.

    The first table has the cells wholly inside: lvl, cx, cy, best. The second has those an edge may cross, with
    the edges that touch the cell and no others, and ``odd``: whether the cell's reference point lies inside, by
    the even-odd rule over all rings. A cell with very many edges has several rows; the first has ``odd``.
    """
    numbered = cut(polygons.withColumn("pg", F.monotonically_increasing_id()))
    edges = cut(_polygon_edges(numbered, ring))
    lo, hi = F.least, F.greatest
    box = edges.groupBy("pg").agg(
        F.min(lo("x1", "x2")).alias("minx"), F.max(hi("x1", "x2")).alias("maxx"), F.min(lo("y1", "y2")).alias("miny"),
        F.max(hi("y1", "y2")).alias("maxy"), F.count("*").alias("n"))
    span = hi(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-6))
    side = lo(hi(F.sqrt("n") / 2, F.lit(float(FEWEST_CELLS))), F.lit(float(MOST_CELLS)))
    size = F.col("size")
    box = cut(box.withColumn("lvl", F.floor(F.log2(span / side)).cast("int")).withColumn("size", F.pow(F.lit(2.0), F.col("lvl").cast("double"))).select(
        "pg", "lvl", "size", "n", *[F.floor(F.col(c) / size).alias(f"c_{c}") for c in ("minx", "maxx", "miny", "maxy")]))
    sized = edges.join(box.select("pg", "lvl", "size", "n"), "pg")

    # columns an edge passes, and in each the rows between where it enters and leaves, taken a little wide
    wide = size * 1e-9
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    columns = F.sequence(F.floor((lo("x1", "x2") - wide) / size), F.floor((hi("x1", "x2") + wide) / size))
    passed = sized.withColumn("cx", F.explode(columns))
    at = lambda x: lo(hi(F.when(dx == 0, F.col("y1")).otherwise(F.col("y1") + (x - F.col("x1")) / dx * dy), lo("y1", "y2")), hi("y1", "y2"))
    left, right = F.col("cx") * size - wide, (F.col("cx") + 1) * size + wide
    low = F.when(dx == 0, lo("y1", "y2")).otherwise(lo(at(left), at(right)))
    high = F.when(dx == 0, hi("y1", "y2")).otherwise(hi(at(left), at(right)))
    rows = F.sequence(F.floor((low - wide) / size), F.floor((high + wide) / size))
    touched = passed.withColumn("cy", F.explode(rows))
    edge = F.struct("x1", "y1", "x2", "y2")
    piece = F.pmod(F.xxhash64("x1", "y1", "x2", "y2"), F.floor(F.col("n") / EDGES_PER_ROW) + 1)
    partial = touched.groupBy("pg", "lvl", "cx", "cy", piece.alias("piece")).agg(F.collect_list(edge).alias("edges"))

    # reference points: edges that cross a row's reference line toggle all cells whose point lies left of the crossing
    first = F.ceil(lo("y1", "y2") / size - _REF_Y - 1e-9)
    lines = sized.withColumn("cy", F.explode(F.when(
        first <= F.floor(hi("y1", "y2") / size - _REF_Y + 1e-9), F.sequence(first, F.floor(hi("y1", "y2") / size - _REF_Y + 1e-9)))))
    ref_y = (F.col("cy") + _REF_Y) * size
    cross = (F.col("x2") - F.col("x1")) * (ref_y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = lines.where((F.col("y1") > ref_y) != (F.col("y2") > ref_y)).select(
        "pg", "cy", (F.ceil(cross / size - _REF_X) - 1).alias("cx")).groupBy("pg", "cy", "cx").agg(F.count("*").alias("t"))
    grid = box.withColumn("cy", F.explode(F.sequence("c_miny", "c_maxy"))).withColumn("cx", F.explode(F.sequence("c_minx", "c_maxx")))
    both = grid.select("pg", "cy", "cx", F.lit(0).cast("long").alias("t"), "lvl").unionByName(crossed.withColumn("lvl", F.lit(None).cast("int")))
    right_of = Window.partitionBy("pg", "cy").orderBy(F.desc("cx")).rangeBetween(Window.unboundedPreceding, 0)
    refs = both.withColumn("odd", F.sum("t").over(right_of) % 2 == 1).where("lvl IS NOT NULL").select("pg", "lvl", "cx", "cy", "odd")

    cells = cut(refs.join(partial, ["pg", "lvl", "cx", "cy"], "left").where("odd OR edges IS NOT NULL").join(
        numbered.select("pg", "best"), "pg"))
    whole = cells.where("edges IS NULL").select("lvl", "cx", "cy", "best")
    one = Window.partitionBy("pg", "cx", "cy").orderBy("piece")
    return whole, cells.where("edges IS NOT NULL").withColumn("odd", F.col("odd") & (F.row_number().over(one) == 1))


def _crossings(lat, lng, size: Column) -> Column:
    """Edges of a cell on the way from a point to the cell's reference point: along the point's latitude first, then
    along the reference's longitude."""
    x, y = geo.num(lng), geo.num(lat)
    rx, ry = (F.col("cx") + _REF_X) * size, (F.col("cy") + _REF_Y) * size

    def crossed(e: Column) -> Column:
        at_x = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        at_y = (e["y2"] - e["y1"]) * (rx - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]
        across = F.when((e["y1"] > y) != (e["y2"] > y), ((x < at_x) != (rx < at_x)).cast("long")).otherwise(0)
        up = F.when((e["x1"] > rx) != (e["x2"] > rx), ((y < at_y) != (ry < at_y)).cast("long")).otherwise(0)
        return across + up

    return F.aggregate("edges", F.lit(0).cast("long"), lambda n, e: n + crossed(e))


def _in_polygons(points: DataFrame, polygons: DataFrame, ring: str, best: Column, at, whole_cells) -> DataFrame:
    """l_lat, l_lng, best of each distinct location and polygon that holds it; cells wholly inside answer by
    ``whole_cells`` of their rows."""
    whole, partial = _ring_cells(polygons.withColumn("best", best), ring)
    # polygon sizes span few powers of two, so the distinct levels are a bounded handful
    levels = sorted({r["lvl"] for r in whole.select("lvl").union(partial.select("lvl")).distinct().collect()})
    whole = whole_cells(whole)
    sites = _sites(points, *at, "l", [])
    if not levels:
        return sites.limit(0).join(whole.select("best").limit(0))
    placed = sites.withColumn("lvl", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = F.pow(F.lit(2.0), F.col("lvl").cast("double"))
    placed = placed.withColumn("cx", F.floor(F.col("l_lng") / size)).withColumn(
        "cy", F.floor(F.col("l_lat") / size)
    )
    keys = ["lvl", "cx", "cy"]
    inside = placed.join(whole, keys).select("l_lat", "l_lng", "best")
    met = placed.join(partial, keys).select(
        "l_lat", "l_lng", "pg", "best", (_crossings("l_lat", "l_lng", size) + F.col("odd").cast("long")).alias("n"))
    edge = met.groupBy("l_lat", "l_lng", "pg").agg(F.sum("n").alias("n"), F.first("best").alias("best")).where("n % 2 = 1")
    return inside.unionByName(edge.select("l_lat", "l_lng", "best"))


def polygon_pairs(points: DataFrame, polygons: DataFrame, ring: str, best: Column, at=("lat", "lng")) -> DataFrame:
    """A row for every distinct location and polygon that holds it: l_lat, l_lng, best. See ``containing_polygons``."""
    return _in_polygons(points, polygons, ring, best, at, lambda cells: cells)


def containing_polygons(points: DataFrame, polygons: DataFrame, ring: str, best: Column,
                        at=("lat", "lng")) -> DataFrame:
    """Largest ``best`` value among the polygons that hold each distinct location.

    ``ring`` holds one ring, or all rings of all parts, holes too: a location is inside where a ray crosses an odd
    number of edges. Cells wholly inside a polygon answer for all their points from one pre-aggregated row; points
    in other cells are held against the edges of their own cell alone, whatever the size of the ring.
    """
    top = lambda cells: cells.groupBy("lvl", "cx", "cy").agg(F.max("best").alias("best"))
    found = _in_polygons(points, polygons, ring, best, at, top)
    return found.groupBy("l_lat", "l_lng").agg(F.max("best").alias("best"))


def thin_by_distance(ranked: DataFrame, limit: int, min_km: float, group: list[str],
                     order: list[Column], key: str, lat="lat", lng="lng") -> DataFrame:
    """Greedy best-first selection per question: keep a row unless a kept one is too close.

    Each round folds the best ``limit`` x 20 rows that are not too close to one kept before, so no task
    holds more than that of a question. A round that fills no question up still keeps its best row and
    clears its surroundings; rounds go on until every question has ``limit`` rows or none is left. The
    lists of kept rows have ``limit`` entries at most for each question.
    """
    pool = limit * 20
    by = group or ["_g"]
    rows = cut((ranked if group else ranked.withColumn("_g", F.lit(1))).withColumn("_id", F.monotonically_increasing_id()))
    place = Window.partitionBy(*by).orderBy(*order, "_id")
    item = F.struct("_rn", F.col("_id").alias("id"), F.col(lat).alias("lat"), F.col(lng).alias("lng"))
    names = {g: f"_b{i}" for i, g in enumerate(by)}
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in names.items()]
    settled = None
    while True:
        left = rows
        if settled is not None:
            left = left.join(settled, same).where(~F.exists("kept", lambda k: geo.haversine_km(
                F.col(lat), F.col(lng), k["lat"], k["lng"]) < min_km) & ~F.col("full")).drop(*names.values(), "full")
        else:
            left = left.withColumn("kept", F.array().cast("array<struct<id:bigint,lat:double,lng:double>>"))
        # rows at the very place of a kept one are too close only if some distance is asked for
        left = left.where(~F.exists("kept", lambda k: k["id"] == F.col("_id")))
        best = left.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= pool)
        pooled = best.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("kept").alias("kept"))

        def take(kept: Column, x: Column) -> Column:
            clash = F.exists(kept, lambda k: geo.haversine_km(x["lat"], x["lng"], k["lat"], k["lng"]) < min_km)
            one = F.struct(x["id"].alias("id"), x["lat"].cast("double").alias("lat"), x["lng"].cast("double").alias("lng"))
            return F.when((F.size(kept) < limit) & ~clash, F.concat(kept, F.array(one))).otherwise(kept)

        fresh = pooled.select(*[F.col(g).alias(n) for g, n in names.items()], F.aggregate("items", F.col("kept"), take).alias("kept"),
                              (F.size("items") < pool).alias("last"))
        fresh = fresh.select(*names.values(), "kept", (F.col("last") | (F.size("kept") >= limit)).alias("full"))
        if settled is not None:  # questions of which nothing was left stay as they were
            was = settled.withColumnsRenamed({n: f"{n}_" for n in names.values()}).withColumnsRenamed({"kept": "kept_", "full": "full_"})
            both = was.join(fresh, [F.col(f"{n}_").eqNullSafe(F.col(n)) for n in names.values()], "left")
            fresh = both.select(*[F.col(f"{n}_").alias(n) for n in names.values()], F.coalesce("kept", "kept_").alias("kept"), F.coalesce("full", F.lit(True)).alias("full"))
        settled = cut(fresh)
        if settled.where(~F.col("full")).isEmpty():
            break
    ranks = settled.select(F.posexplode("kept").alias("pos", "it")).select(F.col("it.id").alias("_kid"), (F.col("pos") + 1).alias("rank"))
    out = rows.join(ranks, F.col("_id") == F.col("_kid")).drop("_id", "_kid")
    return out.drop("_g") if not group else out
