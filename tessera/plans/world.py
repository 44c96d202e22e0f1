"""The relations every engine works on, derived from the events table.

A trajectory is a user; its nodes lie on a grid. Written once and rendered for
Spark and for DuckDB. Edge and node tables are the road network.
"""

from __future__ import annotations

import re

from tessera.operators.index_sql import rank

#: Query windows: the main one, and squares of 1 to 5 km around a centre by six durations.
MAIN = "SELECT 'main' AS query_id, 104.0137e0 AS min_lon, 30.6141e0 AS min_lat, 104.0463e0 AS max_lon, 30.6459e0 AS max_lat, CAST(1704844800 AS BIGINT) AS q_start, CAST(1704931200 AS BIGINT) AS q_end"


def matrix(d) -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({side} AS BIGINT) AS side, CAST({span} AS BIGINT) AS span" for side in (1, 2, 3, 4, 5) for span in (60, 1800, 3600, 14400, 43200, 86400))
    half_lat, half_lon = "side / 2e0 / 111.32e0", "side / 2e0 / (111.32e0 * cos(radians(30.645e0)))"
    return f"SELECT side, span, concat(side, 'km_', span, 's') AS query_id, 104.045e0 - {half_lon} AS min_lon, 30.645e0 - {half_lat} AS min_lat, 104.045e0 + {half_lon} AS max_lon, 30.645e0 + {half_lat} AS max_lat, CAST(1704844800 AS BIGINT) AS q_start, 1704844800 + span AS q_end FROM ({rows}) sides"


def world(d, n: int = 10) -> list[tuple[str, str]]:
    """Common table expressions in order: ev, nodes, seg, pairs, numbered, edges, segments, ids, entries, env, points."""
    return [
        ("ev", f"SELECT event_id, user_id, {d.epoch('ts')} AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % {n * n} AS node_id FROM {d.tables('events')}"),
        ("nodes", f"SELECT DISTINCT node_id, (10400 + node_id % {n}) / 100e0 AS lon, (3060 + {d.idiv('node_id', n)}) / 100e0 AS lat FROM ev"),
        ("seg", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS seq, node_id AS u, lead(node_id) OVER (PARTITION BY user_id ORDER BY t, event_id) AS v, t AS start_ts, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS end_ts FROM ev"),
        ("pairs", "SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM seg WHERE v IS NOT NULL AND u <> v"),
        ("numbered", rank("a, b", "pairs", "a, b")),
        ("edges", "SELECT r AS eid, a, b, p.lon AS alon, p.lat AS alat, q.lon AS blon, q.lat AS blat, least(p.lon, q.lon) AS min_lon, least(p.lat, q.lat) AS min_lat, greatest(p.lon, q.lon) AS max_lon, greatest(p.lat, q.lat) AS max_lat FROM numbered JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b"),
        ("segments", "SELECT user_id, seq, eid, u, v, start_ts, end_ts FROM seg JOIN edges ON a = least(u, v) AND b = greatest(u, v) WHERE v IS NOT NULL AND u <> v"),
        ("ids", f"SELECT user_id, {d.sha(d.ordered(d.u32('eid'), 'seq'), d.u32('min(start_ts)'), d.u32('max(end_ts)'))} AS tid FROM segments GROUP BY user_id"),
        ("entries", "SELECT s.eid, i.tid, s.start_ts, s.end_ts, s.user_id, s.seq FROM segments s JOIN ids i ON i.user_id = s.user_id"),
        ("env", "SELECT eid, count(*) AS k, min(start_ts) AS min_start, max(end_ts) AS max_end FROM entries GROUP BY eid"),
        ("points", "SELECT event_id AS point_id, i.tid, t AS ts, lon, lat FROM ev JOIN nodes USING (node_id) JOIN ids i USING (user_id)"),
    ]


def render(ctes: list[tuple[str, str]], body: str) -> str:
    """The statement with those expressions that the body needs, directly or not."""
    need, text = [], body
    for name, sql in reversed(ctes):
        if re.search(rf"\b{name}\b", text):
            need.append((name, sql))
            text += " " + sql
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in reversed(need)) + " " + body if need else body
