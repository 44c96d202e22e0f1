"""Registered queries around experiments: windows, set-ups, reconciliation, statistics and batches."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.dialect import Duck, Spark
from tessera.operators import index_sql as ix
from tessera.plans.engine import statement
from tessera.plans.queries import chained, points, updated
from tessera.plans.world import MAIN, matrix, render, world

EARTH_METERS = "6371008.8e0"  # fixed value: mean radius
SPANS = (60, 1800, 3600, 14400, 43200, 86400)
BATCHES = (1, 2, 4, 8, 10)  # trajectories that follow the base, in per cent of all
CENTER = "104.045e0", "30.645e0"


def many(d):
    return [*world(d), ("windows", matrix(d)), *ix.fine("windows")]


def cells(d):
    """Dense cells of 0.02 degrees by entries, with their weighted centres, and the widest box around a centre."""
    grid = "SELECT k, (min_lon + max_lon) / 2e0 AS mx, (min_lat + max_lat) / 2e0 AS my, CAST(floor((min_lon + max_lon) / 2e0 / 0.02e0) AS BIGINT) AS cx, CAST(floor((min_lat + max_lat) / 2e0 / 0.02e0) AS BIGINT) AS cy FROM edges JOIN env USING (eid)"
    half_lat = "5 / 2e0 / 111.32e0"
    half_lon = lambda lat: f"5 / 2e0 / (111.32e0 * cos(radians({lat})))"
    return [
        *world(d),
        ("cells", f"SELECT cx, cy, CAST(sum(k) AS BIGINT) AS weight, round(sum(k * mx) / sum(k), 9) AS lon, round(sum(k * my) / sum(k), 9) AS lat FROM ({grid}) c GROUP BY cx, cy"),
        ("area", "SELECT min(min_lon) AS x0, min(min_lat) AS y0, max(max_lon) AS x1, max(max_lat) AS y1 FROM edges"),
        ("centers", f"SELECT c.*, a.*, least(greatest(lat, y0 + {half_lat}), y1 - {half_lat}) AS in_lat, y0 + {half_lat} <= y1 - {half_lat} AS fits_lat FROM cells c CROSS JOIN area a"),
        ("clamped", f"SELECT c.*, {half_lon('lat')} AS dx, {half_lon('in_lat')} AS in_dx, {half_lat} AS dy FROM centers c"),
    ]


def probes(d):
    """Windows of 1 km and a minute around the densest cells, at the minutes in which most entries start."""
    half_lat, half_lon = "0.5e0 / 111.32e0", "0.5e0 / (111.32e0 * cos(radians(c.lat)))"
    return [
        *cells(d),
        ("busy", f"SELECT minute, count(*) AS n FROM (SELECT {d.idiv('start_ts', 60)} * 60 AS minute FROM entries) m GROUP BY minute ORDER BY n DESC, minute LIMIT 6"),
        ("dense", "SELECT cx, cy, lon, lat FROM cells ORDER BY weight DESC, cx, cy LIMIT 10"),
        ("windows", f"SELECT concat(c.cx, '_', c.cy, '_', b.minute) AS query_id, c.lon - {half_lon} AS min_lon, c.lat - {half_lat} AS min_lat, c.lon + {half_lon} AS max_lon, c.lat + {half_lat} AS max_lat, b.minute AS q_start, b.minute + 60 AS q_end FROM dense c CROSS JOIN busy b"),
        *ix.fine("windows"),
        ("probed", "SELECT w.query_id, count(DISTINCT e.tid) AS n_exact, count(DISTINCT c.tid) AS n_coarse FROM windows w LEFT JOIN coarse c ON c.query_id = w.query_id LEFT JOIN exact e ON e.query_id = w.query_id AND e.tid = c.tid GROUP BY w.query_id"),
    ]


def named(d):
    """Trajectory names of which some are numbers; these come first, by value."""
    return [
        *world(d),
        ("names", "SELECT CASE WHEN user_id % 3 = 0 THEN concat('u', user_id) ELSE CAST(user_id AS STRING) END AS name FROM ids"),
        ("keyed_names", "SELECT name, CASE WHEN TRY_CAST(name AS BIGINT) IS NULL THEN 1 ELSE 0 END AS is_text, coalesce(TRY_CAST(name AS BIGINT), 0) AS as_number FROM names"),
        ("name_rank", ix.rank("name, is_text, as_number", "keyed_names", "is_text, as_number, name")),
    ]


def local_time(d, seconds: str) -> str:
    """A time of the zone UTC+8 with its offset."""
    if d is Spark:
        return f"concat(date_format(timestamp_seconds({seconds} + 28800), 'yyyy-MM-dd HH:mm:ss'), ' +0800')"
    return f"strftime(make_timestamp(({seconds} + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') || ' +0800'"


def unpivoted(d) -> str:
    row = f"SELECT w.side, {', '.join(f'count(DISTINCT CASE WHEN w.span = {s} THEN e.tid END) AS s{s}' for s in SPANS)} FROM windows w LEFT JOIN exact e ON e.query_id = w.query_id GROUP BY w.side"
    columns = ", ".join(f"s{s}" for s in SPANS)
    return f"SELECT side, label, n FROM ({row}) m UNPIVOT (n FOR label IN ({columns}))"


def sphere(d) -> str:
    sides = " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS side" for s in (1, 2, 3, 4, 5))
    lat, lon = f"degrees(side * 500e0 / {EARTH_METERS})", f"degrees(side * 500e0 / ({EARTH_METERS} * greatest(1e-12, cos(radians({CENTER[1]})))))"
    corner = lambda x, step, name: f"round({x} {step}, 9) AS {name}"
    return f"SELECT side, {corner(CENTER[0], '- ' + lon, 'min_lon')}, {corner(CENTER[0], '+ ' + lon, 'max_lon')}, {corner(CENTER[1], '- ' + lat, 'min_lat')}, {corner(CENTER[1], '+ ' + lat, 'max_lat')} FROM ({sides}) s"


def tree_stats(d) -> str:
    own = [("lon", "lon"), ("lat", "lat"), ("time", "ts"), ("box", "rt")]
    return " UNION ALL ".join(f"SELECT '{name}' AS dim, max(h) + 1 AS height, count(CASE WHEN h = 0 THEN 1 END) AS n_leaves, count(*) AS n_nodes, (SELECT count(*) FROM points) AS n_points FROM {key}_nodes" for name, key in own)


def batches(d) -> str:
    return " UNION ALL ".join(f"SELECT CAST({p} AS BIGINT) AS pct, count(DISTINCT e.tid) AS n_trajectories, count(*) AS n_entries, count(DISTINCT e.eid) AS n_edges FROM entries e JOIN ordinal USING (user_id) CROSS JOIN cutoff WHERE o > n_base AND o <= n_base + greatest(1, {d.idiv(f'n * {p}', 100)})" for p in BATCHES)


INSIDE = "x.lon BETWEEN w.min_lon AND w.max_lon AND x.lat BETWEEN w.min_lat AND w.max_lat AND x.ts BETWEEN w.q_start AND w.q_end"

#: name: (expressions, body by dialect)
BODIES = {
    "sphere_windows": (world, sphere),
    "center_validity": (cells, lambda d: "SELECT cx, cy, lon, lat, lon - dx >= x0 AND lon + dx <= x1 AND lat - dy >= y0 AND lat + dy <= y1 AS valid, CASE WHEN fits_lat AND x0 + in_dx <= x1 - in_dx THEN round(least(greatest(lon, x0 + in_dx), x1 - in_dx), 9) END AS in_lon, CASE WHEN fits_lat AND x0 + in_dx <= x1 - in_dx THEN round(in_lat, 9) END AS in_lat FROM clamped"),
    "local_times": (world, lambda d: f"SELECT user_id, {local_time(d, 'min(start_ts)')} AS first_time, {local_time(d, 'max(end_ts)')} AS last_time FROM segments GROUP BY user_id"),
    "trajectory_order": (named, lambda d: "SELECT name, r FROM name_rank"),
    "setup_row": (lambda d: [*world(d), ("windows", MAIN)], lambda d: f"SELECT a.*, w.*, (SELECT CAST(sum(v.k) AS BIGINT) FROM edges e JOIN env v ON v.eid = e.eid JOIN windows w ON {ix.segment_hits('e.alon', 'e.alat', 'e.blon', 'e.blat', 'w')}) AS weight, s.first_ts, s.last_ts FROM (SELECT min(min_lon) AS road_min_lon, min(min_lat) AS road_min_lat, max(max_lon) AS road_max_lon, max(max_lat) AS road_max_lat, count(*) AS n_edges FROM edges) a CROSS JOIN windows w CROSS JOIN (SELECT min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM segments) s"),
    "matrix_cells": (many, unpivoted),
    "engine_reconciliation": (many, lambda d: f"SELECT query_id, CAST(sum(edge) AS BIGINT) AS n_edge, CAST(sum(point) AS BIGINT) AS n_point, CAST(sum(edge * point) AS BIGINT) AS n_both FROM (SELECT query_id, tid, max(edge) AS edge, max(point) AS point FROM (SELECT query_id, tid, 1 AS edge, 0 AS point FROM coarse UNION ALL SELECT w.query_id, x.tid, 0, 1 FROM windows w JOIN points x ON {INSIDE}) a GROUP BY query_id, tid) b GROUP BY query_id"),
    "points_only_candidates": (many, lambda d: f"SELECT p.query_id, p.tid FROM (SELECT DISTINCT w.query_id, x.tid FROM windows w JOIN points x ON {INSIDE}) p LEFT JOIN coarse c ON c.query_id = p.query_id AND c.tid = p.tid WHERE c.tid IS NULL"),
    "index_stats": (points, tree_stats),
    "entry_order_violations": (chained, lambda d: "SELECT eid, rank FROM (SELECT eid, rank, start_ts, lag(start_ts) OVER (PARTITION BY eid ORDER BY rank) AS before FROM ranked) r WHERE before > start_ts"),
    "catalogue_missing": (lambda d: [*world(d), ("windows", MAIN), *ix.fine("windows")], lambda d: "SELECT tid FROM coarse EXCEPT SELECT tid FROM ids WHERE user_id % 5 <> 0"),
    "density_probes": (probes, lambda d: "SELECT query_id, n_exact, n_coarse FROM probed"),
    "densest_probe": (probes, lambda d: "SELECT query_id, n_exact, n_coarse FROM probed ORDER BY n_exact DESC, n_coarse DESC, query_id LIMIT 1"),
    "update_batches": (updated, batches),
}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ctes, body = BODIES[name]
    return statement(spark, sf_dir, ctes(Spark), body(Spark))


QUERIES = {name: partial(run, name=name) for name in BODIES}
ORACLE = {name: render(ctes(Duck), body(Duck)) for name, (ctes, body) in BODIES.items()}
