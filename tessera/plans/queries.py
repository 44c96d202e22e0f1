"""Registered queries: one body each, run by Spark and, as the oracle, by DuckDB."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.dialect import Duck, Spark
from tessera.operators import chains, packed_proofs
from tessera.operators import index_sql as ix
from tessera.plans.engine import statement
from tessera.plans.world import MAIN, matrix, render, world

CAP, FANOUT = 128, 64
LEVELS, MMR_LEVELS = 9, 30  # of the oracle's text: 128 * 64^9 points, 2^30 entries an edge; the operators have no bound
EMPTY_ROOT = packed_proofs.EMPTY_ROOT


RANKED = "SELECT eid, tid, start_ts, end_ts, CAST(row_number() OVER (PARTITION BY eid ORDER BY start_ts, user_id, seq) AS BIGINT) AS rank, count(*) OVER (PARTITION BY eid) AS total FROM entries"


def windowed(d):
    return [*world(d), ("windows", MAIN), *ix.fine("windows")]


def many(d):
    return [*world(d), ("windows", matrix(d)), *ix.fine("windows")]


def with_mmr(d):
    return [*world(d), *ix.mmr(d, MMR_LEVELS)]


def chained(d):
    """Sorted lists of edges: rank by start with ties in order of arrival, and the main window's prefix."""
    return [
        *world(d), ("windows", MAIN),
        ("ranked", RANKED),
        ("open_edges", f"SELECT e.* FROM edges e JOIN windows w ON {ix.segment_hits('e.alon', 'e.alat', 'e.blon', 'e.blat', 'w')}"),
        ("prefix", "SELECT r.eid, r.tid, r.start_ts, r.end_ts, r.rank, r.total FROM ranked r JOIN open_edges o ON o.eid = r.eid CROSS JOIN windows w WHERE r.start_ts <= w.q_end"),
        ("cut", "SELECT o.eid, coalesce(max(p.rank), 0) AS k FROM open_edges o LEFT JOIN prefix p ON p.eid = o.eid GROUP BY o.eid"),
    ]


def points(d, cap: int = CAP, fanout: int = FANOUT):
    return [*world(d), ("windows", MAIN), *(x for key in ("lon", "lat", "ts") for x in ix.btree(d, key, cap, fanout, LEVELS)), *ix.morton(d),
            ("morton_rank", ix.rank("point_id, tid, ts, lon, lat, morton", "keyed", "morton, point_id")), *ix.rtree(d, cap, fanout, LEVELS)]


def pointwise(d, candidates: str):
    """The exact answers of the point indexes for all windows of the matrix."""
    return [*world(d), ("windows", matrix(d)), *ix.point_candidates(), *ix.fine_points(d, candidates)]


REVERSED = "SELECT query_id, max_lon AS min_lon, max_lat AS min_lat, min_lon AS max_lon, min_lat AS max_lat, q_start, q_end"
ONE_KM = "SELECT 'center' AS query_id, 104.045e0 - 0.5e0 / (111.32e0 * cos(radians(30.645e0))) AS min_lon, 30.645e0 - 0.5e0 / 111.32e0 AS min_lat, 104.045e0 + 0.5e0 / (111.32e0 * cos(radians(30.645e0))) AS max_lon, 30.645e0 + 0.5e0 / 111.32e0 AS max_lat, CAST(0 AS BIGINT) AS q_start, CAST(4102444800 AS BIGINT) AS q_end"


def updated(d):
    """A base of the trajectories with the 60 % least user ids, the rest as a delta, and time-safe parts of it."""
    return [
        *world(d),
        ("cutoff", f"SELECT count(*) AS n, greatest(1, {d.idiv('count(*) * 60', 100)}) AS n_base FROM ids"),
        ("user_rank", ix.rank("user_id", "ids", "user_id")),
        ("ordinal", "SELECT user_id, r + 1 AS o FROM user_rank"),
        ("base", "SELECT e.eid, e.tid, e.start_ts, e.end_ts FROM entries e JOIN ordinal USING (user_id) CROSS JOIN cutoff WHERE o <= n_base"),
        ("delta", "SELECT e.eid, e.tid, e.start_ts, e.end_ts, e.user_id, e.seq FROM entries e JOIN ordinal USING (user_id) CROSS JOIN cutoff WHERE o > n_base"),
        ("tails", "SELECT eid, max(start_ts) AS tail FROM base GROUP BY eid"),
        ("safe", "SELECT d.eid, d.tid, d.start_ts, d.end_ts, d.user_id, d.seq FROM (SELECT d.*, max(d.start_ts) OVER (PARTITION BY d.eid ORDER BY d.user_id, d.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM delta d) d LEFT JOIN tails t ON t.eid = d.eid WHERE d.start_ts >= coalesce(t.tail, 0) AND d.start_ts >= coalesce(d.before, 0)"),
        ("grown", "SELECT * FROM base UNION ALL SELECT eid, tid, start_ts, end_ts FROM safe"),
        *ix.mmr(d, MMR_LEVELS, "grown"),
    ]


DISTANCE = "sqrt(power((n.lon - 104.045e0) * 111320e0 * cos(radians(30.645e0)), 2) + power((n.lat - 30.645e0) * 110540e0, 2))"

#: Distinct users a minute without a row for each: their merged intervals, then running sums over the
#: minutes at which one begins or ends, of which only the first 20 of a plateau can be among the top 20.
SWEEP = """
SELECT minute, n FROM (SELECT 60 * m AS minute, n FROM (SELECT n, explode(sequence(at, least(next - 1, at + 19))) AS m FROM (
  SELECT at, sum(step) OVER (ORDER BY at) AS n, lead(at) OVER (ORDER BY at) AS next FROM (SELECT at, sum(step) AS step FROM (
    SELECT user_id, explode(array(struct(min(s) AS at, 1L AS step), struct(max(e) + 1 AS at, -1L AS step))) AS x FROM (
      SELECT user_id, s, e, count(CASE WHEN before IS NULL OR s > before THEN 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
          SELECT user_id, (start_ts - 60) div 60 AS s, end_ts div 60 AS e FROM segments))) GROUP BY user_id, island) LATERAL VIEW inline(array(x)) AS at, step GROUP BY at))
  WHERE n > 0 AND next IS NOT NULL)) ORDER BY n DESC, minute LIMIT 20"""

#: Suffix states of the sorted lists, from the tail to the front, a step of all edges at a time.
CHAIN = f"""WITH RECURSIVE states AS (
  SELECT eid, total AS pos, '{chains.LIST_TAIL}' AS state FROM ranked WHERE rank = 1
  UNION ALL SELECT s.eid, s.pos - 1, {Duck.sha(Duck.text_hex(chains.LIST), Duck.sha(Duck.text_hex(chains.ENTRY), 'r.tid', Duck.u32('r.start_ts'), Duck.u32('r.end_ts')), 's.state')}
  FROM states s JOIN ranked r ON r.eid = s.eid AND r.rank = s.pos) SELECT eid, pos, state FROM states"""

#: name: (expressions, body by dialect)
BODIES = {
    "road_nodes": (world, lambda d: "SELECT node_id, lon, lat FROM nodes"),
    "road_node_gaps": (world, lambda d: "SELECT count(*) AS n_nodes, max(node_id) AS max_node, max(node_id) + 1 - count(*) AS n_gaps FROM nodes"),
    "road_edges": (world, lambda d: "SELECT eid, a, b, min_lon, min_lat, max_lon, max_lat FROM edges"),
    "road_mbr": (world, lambda d: "SELECT min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat, count(*) AS n_edges, max(eid) AS max_eid FROM edges"),
    "segments": (world, lambda d: "SELECT user_id, seq, eid, u, v, start_ts, end_ts FROM segments"),
    "segments_next_start": (world, lambda d: "SELECT user_id, seq, eid, start_ts, greatest(end_ts, start_ts + 1) AS end_ts FROM segments"),
    "trajectory_ids": (world, lambda d: "SELECT user_id, tid FROM ids"),
    "entries": (world, lambda d: "SELECT eid, tid, start_ts, end_ts FROM entries"),
    "edge_time_envelope": (world, lambda d: "SELECT eid, k, min_start, max_end FROM env"),
    "edge_distinct_trajectories": (world, lambda d: "SELECT eid, count(DISTINCT tid) AS n FROM entries GROUP BY eid"),
    "vertex_degree_weight": (world, lambda d: "SELECT node_id, count(*) AS weight FROM (SELECT a AS node_id FROM edges UNION ALL SELECT b FROM edges) ends GROUP BY node_id"),
    "vertex_load_weight": (world, lambda d: "SELECT node_id, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT a AS node_id, n FROM edges JOIN (SELECT eid, count(DISTINCT tid) AS n FROM entries GROUP BY eid) c USING (eid) UNION ALL SELECT b, n FROM edges JOIN (SELECT eid, count(DISTINCT tid) AS n FROM entries GROUP BY eid) c USING (eid)) ends GROUP BY node_id"),
    "time_violations": (world, lambda d: "SELECT count(*) AS n, count(DISTINCT user_id) AS n_trajectories FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ev) s WHERE before > t"),
    "missing_edges": (world, lambda d: "SELECT s.user_id, s.seq FROM segments s LEFT JOIN (SELECT a, b FROM edges WHERE eid % 7 <> 0) e ON e.a = least(s.u, s.v) AND e.b = greatest(s.u, s.v) WHERE e.a IS NULL"),
    "dataset_counters": (world, lambda d: "SELECT count(*) AS raw, count(CASE WHEN v IS NULL THEN 1 END) AS last_points, count(CASE WHEN u = v THEN 1 END) AS stationary, count(CASE WHEN u <> v THEN 1 END) AS kept, min(start_ts) AS first_ts, max(start_ts) AS last_ts FROM seg"),
    "points_densified": (world, lambda d: f"SELECT user_id, seq, CAST(step AS BIGINT) AS step, p.lon + (q.lon - p.lon) * step / 10e0 AS lon, p.lat + (q.lat - p.lat) * step / 10e0 AS lat, start_ts + (end_ts - start_ts) * step / 10e0 AS ts FROM (SELECT user_id, seq, u, coalesce(v, u) AS v, start_ts, coalesce(end_ts, start_ts) AS end_ts, {d.series('0', 'CASE WHEN v IS NULL THEN 0 ELSE 9 END')} AS step FROM seg) s JOIN nodes p ON p.node_id = s.u JOIN nodes q ON q.node_id = s.v"),
    "brute_force_entries": (windowed, lambda d: f"SELECT x.eid, x.tid, x.start_ts, x.end_ts FROM windows w CROSS JOIN edges e JOIN entries x ON x.eid = e.eid WHERE {ix.coarse()}"),
    "coarse_candidates": (windowed, lambda d: "SELECT tid FROM coarse"),
    "exact_result": (windowed, lambda d: "SELECT tid FROM exact"),
    "coarse_fine_counts_by_window": (many, lambda d: "SELECT w.query_id, count(DISTINCT c.tid) AS n_coarse, count(DISTINCT e.tid) AS n_exact FROM windows w LEFT JOIN coarse c ON c.query_id = w.query_id LEFT JOIN exact e ON e.query_id = w.query_id AND e.tid = c.tid GROUP BY w.query_id"),
    "window_matrix_pivot": (many, lambda d: "SELECT w.side, " + ", ".join(f"count(DISTINCT CASE WHEN w.span = {s} THEN e.tid END) AS s{s}" for s in (60, 1800, 3600, 14400, 43200, 86400)) + " FROM windows w LEFT JOIN exact e ON e.query_id = w.query_id GROUP BY w.side"),
    "all_time_window": (world, lambda d: f"SELECT count(DISTINCT x.tid) AS n FROM (SELECT m.query_id, m.min_lon, m.min_lat, m.max_lon, m.max_lat, t.q_start, t.q_end FROM ({MAIN}) m CROSS JOIN (SELECT min(min_start) AS q_start, max(max_end) AS q_end FROM env) t) w CROSS JOIN edges e JOIN entries x ON x.eid = e.eid WHERE {ix.coarse()}"),
    "mmr_leaves": (with_mmr, lambda d: "SELECT eid, j, hash FROM mmr WHERE h = 0"),
    "mmr_nodes": (with_mmr, lambda d: "SELECT eid, h, j, pos, hash, lo, hi FROM mmr"),
    "mmr_peaks": (with_mmr, lambda d: "SELECT eid, k, h, j, hash, lo, hi FROM peaks"),
    "mmr_roots": (with_mmr, lambda d: "SELECT eid, k, root, lo, hi FROM roots"),
    "mmr_size_law": (with_mmr, lambda d: f"SELECT m.eid, n, 2 * k - {d.bits('k')} AS law FROM (SELECT eid, count(*) AS n FROM mmr GROUP BY eid) m JOIN mmr_k USING (eid)"),
    "sorted_prefix_scan": (chained, lambda d: "SELECT eid, rank, total, tid, start_ts, end_ts FROM prefix"),
    "boundary_witness": (chained, lambda d: "SELECT c.eid, c.k, r.tid, r.start_ts, r.end_ts FROM cut c JOIN ranked r ON r.eid = c.eid AND r.rank = c.k + 1"),
    "sorted_list_candidates": (chained, lambda d: "SELECT DISTINCT p.tid FROM prefix p CROSS JOIN windows w WHERE p.end_ts >= w.q_start"),
    "list_chain_states": (chained, lambda d: "SELECT eid, pos, state FROM {chain}" if d is Spark else f"SELECT eid, pos, state FROM ({CHAIN}) c"),
    "list_chain_roots": (chained, lambda d: "SELECT eid, state AS root FROM {chain} WHERE pos = 0" if d is Spark else f"SELECT eid, state AS root FROM ({CHAIN}) c WHERE pos = 0"),
    "btree_leaves_lon": (points, lambda d: "SELECT idx, hash, lo, hi FROM lon_level0"),
    "btree_leaves_lat": (points, lambda d: "SELECT idx, hash, lo, hi FROM lat_level0"),
    "btree_leaves_time": (points, lambda d: "SELECT idx, hash, lo, hi FROM ts_level0"),
    "btree_root": (points, lambda d: f"SELECT {d.sha(d.text_hex('THREE-MBT-ROOT-v1'), *(f'coalesce((SELECT hash FROM {k}_rootnode), {EMPTY_ROOT!r})' for k in ('lon', 'lat', 'ts')))} AS root"),
    "btree_visited_leaves": (points, lambda d: "SELECT 'lon' AS dim, count(*) AS n FROM lon_level0 CROSS JOIN windows w WHERE hi >= w.min_lon AND lo <= w.max_lon UNION ALL SELECT 'lat', count(*) FROM lat_level0 CROSS JOIN windows w WHERE hi >= w.min_lat AND lo <= w.max_lat UNION ALL SELECT 'time', count(*) FROM ts_level0 CROSS JOIN windows w WHERE hi >= w.q_start AND lo <= w.q_end"),
    "three_way_candidates": (points, lambda d: "SELECT DISTINCT tid FROM points CROSS JOIN windows w WHERE lon BETWEEN w.min_lon AND w.max_lon INTERSECT SELECT tid FROM points CROSS JOIN windows w WHERE lat BETWEEN w.min_lat AND w.max_lat INTERSECT SELECT tid FROM points CROSS JOIN windows w WHERE ts BETWEEN w.q_start AND w.q_end"),
    "rtree_candidates": (points, lambda d: "SELECT DISTINCT tid FROM points CROSS JOIN windows w WHERE lon BETWEEN w.min_lon AND w.max_lon AND lat BETWEEN w.min_lat AND w.max_lat AND ts BETWEEN w.q_start AND w.q_end"),
    "morton_order": (points, lambda d: "SELECT point_id, morton, r FROM morton_rank"),
    "rtree_leaves": (points, lambda d: f"SELECT {d.idiv('r', CAP)} AS leaf, count(*) AS n, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM morton_rank GROUP BY {d.idiv('r', CAP)}"),
    "rtree_nodes": (points, lambda d: "SELECT h, idx, hash, x0, y0, x1, y1 FROM rt_nodes"),
    "btree_nodes": (points, lambda d: " UNION ALL ".join(f"SELECT '{dim}' AS dim, h, idx, hash, lo, hi FROM {key}_nodes" for dim, key in (("lon", "lon"), ("lat", "lat"), ("time", "ts")))),
    "rtree_root": (points, lambda d: "SELECT root FROM rt_root"),
    "rtree_visited_leaves": (points, lambda d: f"SELECT count(*) AS n FROM (SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM morton_rank GROUP BY {d.idiv('r', CAP)}) l CROSS JOIN windows w WHERE x1 >= w.min_lon AND x0 <= w.max_lon AND y1 >= w.min_lat AND y0 <= w.max_lat"),
    "time_safe_delta": (updated, lambda d: "SELECT eid, tid, start_ts, end_ts FROM safe"),
    "append_roots": (updated, lambda d: "SELECT eid, k, root FROM roots"),
    "scaling_prefix_counts": (updated, lambda d: " UNION ALL ".join(f"SELECT CAST({p} AS BIGINT) AS pct, count(DISTINCT e.tid) AS n_trajectories, count(*) AS n_entries FROM entries e JOIN ordinal USING (user_id) CROSS JOIN cutoff WHERE o <= {d.idiv(f'n * {p}', 100)}" for p in (20, 40, 60, 80, 100))),
    "dense_cells_topk": (world, lambda d: "SELECT cx, cy, CAST(sum(k) AS BIGINT) AS weight, sum(k * mx) / sum(k) AS lon, sum(k * my) / sum(k) AS lat FROM (SELECT k, (min_lon + max_lon) / 2e0 AS mx, (min_lat + max_lat) / 2e0 AS my, CAST(floor((min_lon + max_lon) / 2e0 / 0.02e0) AS BIGINT) AS cx, CAST(floor((min_lat + max_lat) / 2e0 / 0.02e0) AS BIGINT) AS cy FROM edges JOIN env USING (eid)) c GROUP BY cx, cy ORDER BY weight DESC, cx, cy LIMIT 30"),
    "dense_minutes_topk": (world, lambda d: SWEEP if d is Spark else f"SELECT minute, count(DISTINCT user_id) AS n FROM (SELECT user_id, 60 * m AS minute FROM (SELECT user_id, {d.series(d.idiv('start_ts - 60', 60), d.idiv('end_ts', 60))} AS m FROM segments) s) t GROUP BY minute ORDER BY n DESC, minute LIMIT 20"),
    "center_weight": (lambda d: [*world(d), ("windows", ONE_KM)], lambda d: f"SELECT CAST(coalesce(sum(v.k), 0) AS BIGINT) AS weight, count(*) AS n_edges FROM windows w CROSS JOIN edges e JOIN env v ON v.eid = e.eid WHERE {ix.segment_hits('e.alon', 'e.alat', 'e.blon', 'e.blat', 'w')}"),
    "normalized_windows": (lambda d: [("windows", MAIN), ("reversed", f"{REVERSED} FROM windows")], lambda d: f"{ix.NORMAL} FROM reversed"),
    "exact_result_points": (lambda d: pointwise(d, "three_way"), lambda d: "SELECT query_id, tid FROM exact_points"),
    "exact_result_boxes": (lambda d: pointwise(d, "in_box"), lambda d: "SELECT query_id, tid FROM exact_points"),
    "clipped_points": (lambda d: pointwise(d, "in_box"), lambda d: "SELECT query_id, tid, round(lon0, 9) AS lon0, round(lat0, 9) AS lat0, round(lon1, 9) AS lon1, round(lat1, 9) AS lat1 FROM clipped_paths"),
    "arrival_roots": (lambda d: [*world(d), *ix.mmr(d, MMR_LEVELS, order="user_id, seq")], lambda d: "SELECT eid, k, root, lo, hi FROM roots"),
    "nearest_nodes_topk": (world, lambda d: f"SELECT n.node_id, round({DISTANCE}, 3) AS meters FROM nodes n ORDER BY {DISTANCE}, n.node_id LIMIT 64"),
    "new_edge_candidates": (world, lambda d: f"SELECT p.node_id AS u, q.node_id AS v FROM (SELECT n.node_id FROM nodes n ORDER BY {DISTANCE}, n.node_id LIMIT 64) p JOIN (SELECT n.node_id FROM nodes n ORDER BY {DISTANCE}, n.node_id LIMIT 64) q ON p.node_id < q.node_id LEFT JOIN edges e ON e.a = p.node_id AND e.b = q.node_id WHERE e.eid IS NULL ORDER BY u, v LIMIT 10"),
    "catalog_time_range": (world, lambda d: "SELECT min(start_ts) AS first_ts, max(end_ts) AS last_ts, count(*) AS n_segments, count(DISTINCT user_id) AS n_trajectories FROM segments"),
    "repeat_statistics": (world, lambda d: "SELECT eid, round(avg(end_ts - start_ts), 6) AS mean, round(coalesce(stddev_pop(end_ts - start_ts), 0), 6) AS deviation, round(coalesce(stddev_samp(end_ts - start_ts), 0), 6) AS sample_deviation FROM entries GROUP BY eid"),
}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registered body over events."""
    ctes, body = BODIES[name]
    own, text, given = ctes(Spark), body(Spark), {}
    if "{chain}" in text:
        lists = statement(spark, sf_dir, own, "SELECT eid, rank, total, tid, start_ts, end_ts FROM ranked")
        own, given = [*own, ("chain", "")], {"chain": chains.list_states(lists)}
        text = text.replace("{chain}", "chain")
    return statement(spark, sf_dir, own, text, given)


QUERIES = {name: partial(run, name=name) for name in BODIES}
ORACLE = {name: render(ctes(Duck), body(Duck)) for name, (ctes, body) in BODIES.items()}
