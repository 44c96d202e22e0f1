"""Authenticated indexes as grouped, ordered aggregations: SQL for any dialect.

Edge MMR: a node (h, j) of an edge with k entries exists if (j + 1) * 2^h <= k, so
each level pairs the nodes of the level below. Points: packed B-trees and a Morton
R-tree take rank // capacity as leaf and group upward by fan-out. The domain tags
in the hashes are fixed values of the record formats.
"""

from __future__ import annotations

from collections.abc import Callable

from tessera.functions.dialect import overlaps, segment_hits


class Made(str):
    """SQL of an expression that in Spark an operator makes, from the expression that source names."""

    source: str


class Rank(Made):
    """Ranks r from 0 by a total order: tables.ranked."""

    select: str
    order: str


class Mmr(Made):
    """Nodes of the edges' MMRs over the entries in source, in an order: mmr.ordered_nodes."""

    order: str


class Levels(Made):
    """All levels of a packed tree over the leaves in source, up to that with one node."""

    up: Callable[[str], str]


def made(kind: type, sql: str, **parts) -> str:
    out = kind(sql)
    for name, value in parts.items():
        setattr(out, name, value)
    return out


def rank(select: str, source: str, order: str) -> str:
    """The select with ranks r from 0 by a total order."""
    return made(Rank, f"SELECT {select}, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS r FROM {source}", select=select, source=source, order=order)


def mmr(d, levels: int, source: str = "entries", prefix: str = "", order: str = "start_ts, end_ts, tid") -> list[tuple[str, str]]:
    """Nodes, peaks and roots of the edges' MMRs; order: of an edge's entries, by default the sorted one."""
    p = prefix
    out = [(f"{p}leaf0", f"SELECT eid, row_number() OVER (PARTITION BY eid ORDER BY {order}) - 1 AS j, {d.sha('tid', d.u32('start_ts'), d.u32('end_ts'))} AS hash, start_ts AS lo, end_ts AS hi FROM {source}")]
    for h in range(1, levels + 1):
        pair = lambda c: f"max(CASE WHEN j % 2 = 0 THEN {c} END)", lambda c: f"max(CASE WHEN j % 2 = 1 THEN {c} END)"
        parts = [f(x) for f in pair for x in ("hash", d.u32("lo"), d.u32("hi"))]
        out.append((f"{p}leaf{h}", f"SELECT eid, {d.idiv('j', 2)} AS j, {d.sha(*parts)} AS hash, min(lo) AS lo, max(hi) AS hi FROM {p}leaf{h - 1} GROUP BY eid, {d.idiv('j', 2)} HAVING count(*) = 2"))
    every = " UNION ALL ".join(f"SELECT eid, CAST({h} AS BIGINT) AS h, j, hash, lo, hi FROM {p}leaf{h}" for h in range(levels + 1))
    last = f"((j + 1) * {d.pow2('h')} - 1)"
    out.append((f"{p}mmr", made(Mmr, f"SELECT eid, h, j, 2 * {last} - {d.bits(last)} + h AS pos, hash, lo, hi FROM ({every}) every_level", source=source, order=order)))
    out.append((f"{p}mmr_k", f"SELECT eid, count(*) AS k FROM {source} GROUP BY eid"))
    out.append((f"{p}peaks", f"SELECT m.eid, k, h, j, hash, lo, hi FROM {p}mmr m JOIN {p}mmr_k USING (eid) WHERE {d.shift('k', 'h')} % 2 = 1 AND j = {d.shift('k', 'h + 1')} * 2"))
    out.append((f"{p}roots", f"SELECT eid, k, {d.sha(d.u32('k'), d.ordered(f'concat(hash, {d.u32("lo")}, {d.u32("hi")})', '-h'))} AS root, min(lo) AS lo, max(hi) AS hi FROM {p}peaks GROUP BY eid, k"))
    return out


def coarse(w: str = "w") -> str:
    """Condition of an edge e and an entry x for a window."""
    return f"{overlaps('x.start_ts', 'x.end_ts', f'{w}.q_start', f'{w}.q_end')} AND e.min_lon <= {w}.max_lon AND e.max_lon >= {w}.min_lon AND e.min_lat <= {w}.max_lat AND e.max_lat >= {w}.min_lat AND {segment_hits('e.alon', 'e.alat', 'e.blon', 'e.blat', w)}"


def fine(windows: str) -> list[tuple[str, str]]:
    """Exact answer: candidates whose segments, clipped to the window in time, meet the rectangle."""
    at = lambda c, t: f"CASE WHEN s.end_ts = s.start_ts THEN p.{c} ELSE p.{c} + (q.{c} - p.{c}) * (({t} - s.start_ts) / CAST(s.end_ts - s.start_ts AS DOUBLE)) END"
    low, high = "greatest(s.start_ts, w.q_start)", "least(s.end_ts, w.q_end)"
    ends = ", ".join(f"{at(c, t)} AS {c}{k}" for k, t in ((0, low), (1, high)) for c in ("lon", "lat"))
    stop = "CASE WHEN c.start_ts = c.end_ts THEN c.lon0 ELSE c.lon1 END", "CASE WHEN c.start_ts = c.end_ts THEN c.lat0 ELSE c.lat1 END"
    return [
        ("coarse", f"SELECT DISTINCT w.query_id, x.tid, x.user_id FROM {windows} w JOIN edges e ON e.min_lon <= w.max_lon AND e.max_lon >= w.min_lon AND e.min_lat <= w.max_lat AND e.max_lat >= w.min_lat JOIN entries x ON x.eid = e.eid AND {coarse()}"),
        ("clipped", f"SELECT w.*, s.user_id, c.tid, s.start_ts, s.end_ts, {ends} FROM coarse c JOIN {windows} w ON w.query_id = c.query_id JOIN segments s ON s.user_id = c.user_id AND {overlaps('s.start_ts', 's.end_ts', 'w.q_start', 'w.q_end')} JOIN nodes p ON p.node_id = s.u JOIN nodes q ON q.node_id = s.v"),
        ("exact", f"SELECT DISTINCT query_id, tid FROM clipped c WHERE {segment_hits('c.lon0', 'c.lat0', stop[0], stop[1], 'c')}"),
    ]


def btree(d, key: str, cap: int, fanout: int, levels: int, leaf: str | None = None) -> list[tuple[str, str]]:
    """Merkle B-tree over points by (key, point_id, tid); level 0 are the leaves; the root is the node of the first level that has one.

    leaf: expression of a rank's leaf, by default ranks divided by cap.
    """
    leaf = leaf or d.idiv("r", cap)
    tid = f"concat({d.u64(32)}, tid)"
    entry = f"concat(kx, {d.u64('point_id')}, {tid})"
    out = [
        (f"{key}_rank", rank(f"point_id, tid, {key}, {d.f64(f'CAST({key} AS DOUBLE)')} AS kx", "points", f"{key}, point_id, tid")),
        (f"{key}_records", f"SELECT {leaf} AS idx, r, tid, {entry} AS record FROM {key}_rank"),
        (f"{key}_level0", f"SELECT {leaf} AS idx, {d.sha(d.text_hex('THREE-MBT-LEAF-v1'), d.u64('count(*)'), d.ordered(entry, 'r'))} AS hash, min(CAST({key} AS DOUBLE)) AS lo, max(CAST({key} AS DOUBLE)) AS hi FROM {key}_rank GROUP BY {leaf}"),
    ]
    child = f"concat(lox, hix, {d.u64(32)}, hash)"
    up = lambda below: f"SELECT {d.idiv('idx', fanout)} AS idx, {d.sha(d.text_hex('THREE-MBT-INTERNAL-v1'), d.u64('count(*)'), d.ordered(child, 'idx'))} AS hash, min(lo) AS lo, max(hi) AS hi FROM (SELECT idx, hash, lo, hi, {d.f64('lo')} AS lox, {d.f64('hi')} AS hix FROM {below}) children GROUP BY {d.idiv('idx', fanout)}"
    return [*out, *tree_top(key, levels, "idx, hash, lo, hi", up)]


def tree_top(prefix: str, levels: int, columns: str, up: Callable[[str], str]) -> list[tuple[str, str]]:
    """Nodes up to the first level that has one node, which is the root's; up: SQL of the level above the one named.

    DuckDB's text has a fixed number of levels; Spark goes up until one node is left.
    """
    every = " UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS h, {columns} FROM {prefix}_level{h}" for h in range(levels + 1))
    return [
        *((f"{prefix}_level{h}", up(f"{prefix}_level{h - 1}")) for h in range(1, levels + 1)),
        (f"{prefix}_levels", made(Levels, every, source=f"{prefix}_level0", up=up)),
        (f"{prefix}_top", f"SELECT min(h) AS top FROM (SELECT h FROM {prefix}_levels GROUP BY h HAVING count(*) = 1) single"),
        (f"{prefix}_nodes", f"SELECT l.* FROM {prefix}_levels l JOIN {prefix}_top ON l.h <= top"),
        (f"{prefix}_rootnode", f"SELECT l.* FROM {prefix}_levels l JOIN {prefix}_top ON l.h = top"),
    ]


def morton(d, bits: int = 32) -> list[tuple[str, str]]:
    """16-digit hex Morton keys, whose text order is the unsigned order; longitude has the even bits."""
    x = lambda c: f"CAST(floor(least(1e0, greatest(0e0, ({c} - min_{c}) / greatest(max_{c} - min_{c}, 1e-15))) * 4294967295e0) AS BIGINT)"
    spread = lambda v, n: f"{d.shift(v, n)} % 2"
    half = lambda low: " + ".join(f"({spread('gx', low + k)}) * {1 << (2 * k)} + ({spread('gy', low + k)}) * {1 << (2 * k + 1)}" for k in range(bits // 2))
    return [
        ("bounds", "SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM points"),
        ("gridded", f"SELECT point_id, tid, ts, lon, lat, {x('lon')} AS gx, {x('lat')} AS gy FROM points CROSS JOIN bounds"),
        ("keyed", f"SELECT point_id, tid, ts, lon, lat, concat({d.u32(half(bits // 2))}, {d.u32(half(0))}) AS morton FROM gridded"),
    ]


def rtree(d, cap: int, fanout: int, levels: int, leaf: str | None = None) -> list[tuple[str, str]]:
    """Merkle R-tree over points in Morton order; numbers enter its hashes little-endian.

    Record of a point: u64 point_id, trajectory id, f64 lon, lat, ts. Leaf: H("L", u32 n, records);
    internal: H("I", u16 n, box and hash of each child); root: H("R", box, hash).
    """
    box = "min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1"
    f = lambda c: d.little(d.f64(c))
    corners = ", ".join(f(c) for c in ("x0", "y0", "x1", "y1"))
    record = f"concat({d.little(d.u64('point_id'))}, tid, {f('lon')}, {f('lat')}, {f('CAST(ts AS DOUBLE)')})"
    out = [
        ("rt_records", f"SELECT {leaf or d.idiv('r', cap)} AS idx, r, tid, ts, {record} AS record, lon AS x0, lat AS y0, lon AS x1, lat AS y1 FROM morton_rank"),
        ("rt_level0", f"SELECT idx, {d.sha(d.text_hex('L'), d.little(d.u32('count(*)')), d.ordered('record', 'r'))} AS hash, {box} FROM rt_records GROUP BY idx"),
    ]
    over = d.idiv("idx", fanout)
    up = lambda below: f"SELECT {over} AS idx, {d.sha(d.text_hex('I'), d.little(d.u16('count(*)')), d.ordered('child', 'idx'))} AS hash, {box} FROM (SELECT idx, concat({corners}, hash) AS child, x0, y0, x1, y1 FROM {below}) children GROUP BY {over}"
    out += tree_top("rt", levels, "idx, hash, x0, y0, x1, y1", up)
    out.append(("rt_root", f"SELECT {d.sha(d.text_hex('R'), *map(f, ('x0', 'y0', 'x1', 'y1')), 'hash')} AS root FROM rt_rootnode"))
    return out


def fine_points(d, candidates: str) -> list[tuple[str, str]]:
    """Exact answer over points: candidates (query_id, tid) whose path between their points, clipped to the window in time, meets the rectangle.

    Points are in order of time; where a clipped end is a point itself, it's that point, also of
    pairs without duration. A trajectory of one point is that point.
    """
    at = lambda c, t: f"p.{c}0 + (p.{c}1 - p.{c}0) * ({d.ratio(f'{t} - p.t0', 'p.t1 - p.t0')})"
    low, high = "greatest(p.t0, w.q_start)", "least(p.t1, w.q_end)"
    ends = ", ".join([*(f"CASE WHEN {low} = p.t0 THEN p.{c}0 ELSE {at(c, low)} END AS {c}0" for c in ("lon", "lat")), *(f"CASE WHEN {high} = p.t1 THEN p.{c}1 ELSE {at(c, high)} END AS {c}1" for c in ("lon", "lat"))])
    nxt = lambda c: f"lead({c}) OVER (PARTITION BY tid ORDER BY ts, point_id)"
    return [
        ("path_pairs", f"SELECT tid, ts AS t0, lon AS lon0, lat AS lat0, {nxt('ts')} AS t1, {nxt('lon')} AS lon1, {nxt('lat')} AS lat1, count(*) OVER (PARTITION BY tid) AS n FROM points"),
        ("paths", "SELECT tid, t0, lon0, lat0, coalesce(t1, t0) AS t1, coalesce(lon1, lon0) AS lon1, coalesce(lat1, lat0) AS lat1 FROM path_pairs WHERE t1 IS NOT NULL OR n = 1"),
        ("clipped_paths", f"SELECT w.*, p.tid, {ends} FROM {candidates} c JOIN windows w ON w.query_id = c.query_id JOIN paths p ON p.tid = c.tid AND {overlaps('p.t0', 'p.t1', 'w.q_start', 'w.q_end')}"),
        ("exact_points", f"SELECT DISTINCT query_id, tid FROM clipped_paths c WHERE {segment_hits('c.lon0', 'c.lat0', 'c.lon1', 'c.lat1', 'c')}"),
    ]


def point_candidates() -> list[tuple[str, str]]:
    """Candidates of the point indexes: a point in each of the three ranges, and one point in all of them."""
    within = lambda *keys: " AND ".join(f"p.{k} BETWEEN w.{a} AND w.{b}" for k, a, b in keys)
    lon, lat, ts = ("lon", "min_lon", "max_lon"), ("lat", "min_lat", "max_lat"), ("ts", "q_start", "q_end")
    one = lambda *keys: f"SELECT w.query_id, p.tid FROM windows w JOIN points p ON {within(*keys)}"
    return [
        ("three_way", " INTERSECT ".join(one(k) for k in (lon, lat, ts))),
        ("in_box", f"SELECT DISTINCT * FROM ({one(lon, lat, ts)}) x"),
    ]


NORMAL = "SELECT query_id, least(min_lon, max_lon) AS min_lon, least(min_lat, max_lat) AS min_lat, greatest(min_lon, max_lon) AS max_lon, greatest(min_lat, max_lat) AS max_lat, q_start, q_end"
