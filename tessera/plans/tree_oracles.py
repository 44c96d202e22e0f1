"""DuckDB SQL of the spatial trees, their proof tokens and reports, written apart from the operators.

The trees are split in a fixed number of levels, more than the test networks need; hashes
are taken from the deepest level upwards, tokens from the nodes that a walk visits.
"""

from __future__ import annotations

from tessera.functions.dialect import Duck as d
from tessera.functions.dialect import overlaps, segment_hits
from tessera.operators import chains
from tessera.operators import index_sql as ix
from tessera.plans.queries import MMR_LEVELS, RANKED, updated
from tessera.plans.world import MAIN, matrix, render, world

DEPTH = 14
BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
NO_LO, NO_HI = 4294967295, 0


def split(theta: int, weight: str, doubled: bool) -> list[tuple[str, str]]:
    """p0 .. pDEPTH: node_id, lon, lat and path; weight: SQL of (eid, weight)."""
    out = [("weighted", f"SELECT e.eid, e.a AS u, e.b AS v, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight FROM edges e LEFT JOIN ({weight}) w USING (eid)"), ("p0", "SELECT node_id, lon, lat, '' AS path FROM nodes")]
    needs = "" if doubled else " AND sum(n) > 0"
    for i in range(DEPTH):
        out += [
            (f"in{i}", f"SELECT e.u, e.v, e.weight FROM weighted e JOIN p{i} x ON x.node_id = e.u JOIN p{i} y ON y.node_id = e.v WHERE x.path = y.path AND length(x.path) = {i}"),
            (f"load{i}", f"SELECT node_id, sum(weight) AS w, count(*) AS n FROM (SELECT u AS node_id, weight FROM in{i} UNION ALL SELECT v, weight FROM in{i}) ends GROUP BY node_id"),
            (f"at{i}", f"SELECT p.*, CAST(coalesce(w, 0) AS BIGINT) AS w, CAST(coalesce(n, 0) AS BIGINT) AS n FROM p{i} p LEFT JOIN load{i} USING (node_id) WHERE length(path) = {i}"),
            (f"wide{i}", f"SELECT path, count(*) AS size, sum(w) AS total, max(lon) - min(lon) >= max(lat) - min(lat) AS by_lon FROM at{i} GROUP BY path HAVING count(*) > {theta}{needs}"),
            (f"line{i}", f"SELECT node_id, path, size, total, sum(w) OVER o AS prefix, row_number() OVER o AS pos FROM at{i} JOIN wide{i} USING (path) WINDOW o AS (PARTITION BY path ORDER BY CASE WHEN by_lon THEN lon ELSE lat END, node_id)"),
            (f"cut{i}", f"SELECT path, CASE WHEN max(total) = 0 THEN max(size) // 2 ELSE arg_min(pos, abs(2 * prefix - total) * 1000000 + pos) END AS cut FROM line{i} WHERE pos < size GROUP BY path"),
            (f"p{i + 1}", f"SELECT p.node_id, p.lon, p.lat, p.path || CASE WHEN l.pos IS NULL THEN '' WHEN l.pos <= c.cut THEN '0' ELSE '2' END AS path FROM p{i} p LEFT JOIN line{i} l USING (node_id) LEFT JOIN cut{i} c ON c.path = l.path"),
        ]
    parts = "list_filter(range(1, greatest(length(x.path), length(y.path)) + 1), lambda i: substr(x.path, i, 1) <> substr(y.path, i, 1))[1]"
    out.append(("ends", f"SELECT e.eid, x.path AS u_path, y.path AS v_path, substr(x.path, 1, {parts} - 1) AS shared FROM weighted e JOIN p{DEPTH} x ON x.node_id = e.u JOIN p{DEPTH} y ON y.node_id = e.v"))
    return out


def hashed(children: str, internal: str) -> list[tuple[str, str]]:
    """tree: full with hashes; full: path, leaf, own (hash of a leaf) and what the expressions read."""
    out = []
    for k in range(DEPTH + 1, -1, -1):
        below = f"(SELECT substr(path, 1, {k}) AS up, string_agg({children}, '' ORDER BY path) AS parts FROM hashed{k + 1} GROUP BY 1) c" if k <= DEPTH else "(SELECT '' AS up, '' AS parts WHERE false) c"
        out.append((f"hashed{k}", f"SELECT f.*, CASE WHEN leaf THEN own ELSE {internal} END AS hash FROM full_nodes f LEFT JOIN {below} ON c.up = f.path WHERE length(f.path) = {k}"))
    return [*out, ("tree", " UNION ALL ".join(f"SELECT * FROM hashed{k}" for k in range(DEPTH + 2)))]


def of_paths(source: str, columns: str) -> str:
    """A row for each prefix of a row's path."""
    return f"SELECT substr(path, 1, CAST(unnest(range(0, length(path) + 1)) AS BIGINT)) AS node, {columns} FROM {source}"


META = " || ".join([*(d.f64(c) for c in BOX), d.u32("lo"), d.u32("hi")])


def sem(theta: int) -> list[tuple[str, str]]:
    empty = d.sha(d.u32("0"))
    record = d.sha(d.u32("eid"), d.f64("ulon"), d.f64("ulat"), d.f64("vlon"), d.f64("vlat"), d.u32("k"), d.u32("lo"), d.u32("hi"), "root")
    low = ", ".join(f"min({x}) AS {c}" for c, x in (("e0", "least(ulon, vlon)"), ("e1", "least(ulat, vlat)"))) + ", " + ", ".join(f"max({x}) AS {c}" for c, x in (("e2", "greatest(ulon, vlon)"), ("e3", "greatest(ulat, vlat)")))
    return [
        *ix.mmr(d, MMR_LEVELS), *split(theta, "SELECT eid, 1 AS weight FROM edges", False),
        ("rec", f"SELECT s.*, {record} AS record FROM (SELECT e.eid, CASE WHEN u_path = v_path THEN u_path ELSE shared || '1' END AS path, alon AS ulon, alat AS ulat, blon AS vlon, blat AS vlat, coalesce(k, 0) AS k, coalesce(lo, {NO_LO}) AS lo, coalesce(hi, {NO_HI}) AS hi, coalesce(root, {empty}) AS root FROM edges e JOIN ends USING (eid) LEFT JOIN roots USING (eid)) s"),
        ("inner_paths", f"SELECT DISTINCT node AS path FROM ({of_paths(f'p{DEPTH}', 'length(path) AS n')}) x WHERE length(node) < n"),
        ("shape", f"SELECT path, true AS leaf, 'normal' AS origin, min(lon) AS v0, min(lat) AS v1, max(lon) AS v2, max(lat) AS v3 FROM p{DEPTH} GROUP BY path UNION ALL SELECT path || '1', true, 'middle', 0e0, 0e0, 0e0, 0e0 FROM inner_paths UNION ALL SELECT path, false, 'internal', 0e0, 0e0, 0e0, 0e0 FROM inner_paths"),
        ("under", f"SELECT node AS path, {low}, min(lo) AS lo, max(hi) AS hi FROM ({of_paths('rec', 'ulon, ulat, vlon, vlat, lo, hi')}) x GROUP BY node"),
        ("blocks", "SELECT path, count(*) AS n_edges, string_agg(record, '' ORDER BY eid) AS records FROM rec GROUP BY path"),
        ("boxed", f"SELECT path, leaf, origin, coalesce(e0, v0) AS min_lon, coalesce(e1, v1) AS min_lat, coalesce(e2, v2) AS max_lon, coalesce(e3, v3) AS max_lat, coalesce(lo, {NO_LO}) AS lo, coalesce(hi, {NO_HI}) AS hi, coalesce(n_edges, 0) AS n_edges, sha256(unhex(coalesce(records, ''))) AS block FROM shape LEFT JOIN under USING (path) LEFT JOIN blocks USING (path)"),
        ("full_nodes", f"SELECT *, {META} AS meta, sha256(unhex({META} || block)) AS own FROM boxed"),
        *hashed("hash || meta", "sha256(unhex(meta || c.parts))"),
    ]


def sem_tokens(windows: str) -> list[tuple[str, str]]:
    """tokens: every row of the proofs of the windows over the three-way tree."""
    apart = f"NOT (t.min_lon <= w.max_lon AND t.max_lon >= w.min_lon AND t.min_lat <= w.max_lat AND t.max_lat >= w.min_lat) OR t.lo > t.hi OR NOT {overlaps('t.lo', 't.hi', 'w.q_start', 'w.q_end')}"
    no = "CAST(NULL AS VARCHAR) AS tid, CAST(NULL AS BIGINT) AS start_ts, CAST(NULL AS BIGINT) AS end_ts"
    row = lambda of_node, eid, phase, pos, token, body, rest=no: f"SELECT query_id, path || '3' AS place, {of_node} AS of_node, CAST({eid} AS BIGINT) AS eid, {phase} AS phase, CAST({pos} AS BIGINT) AS pos, {token} AS token, lower({body}) AS body, {rest}"
    geometry = f"{d.u32('eid')} || {d.f64('ulon')} || {d.f64('ulat')} || {d.f64('vlon')} || {d.f64('vlat')} || {d.u32('k')} || {d.u32('lo')} || {d.u32('hi')}"
    return [
        ("asked", windows),
        ("walk", f"SELECT w.query_id, w.q_start, w.q_end, t.*, t.path = '' OR NOT ({apart}) AS open FROM tree t CROSS JOIN asked w"),
        ("visited", "SELECT a.* FROM walk a LEFT JOIN walk b ON b.query_id = a.query_id AND a.path <> '' AND b.path = substr(a.path, 1, length(a.path) - 1) WHERE a.path = '' OR (b.open AND NOT b.leaf)"),
        ("laid", f"SELECT v.query_id, r.*, v.q_start, v.q_end, r.k > 0 AND {overlaps('r.lo', 'r.hi', 'v.q_start', 'v.q_end')} AND {segment_hits('r.ulon', 'r.ulat', 'r.vlon', 'r.vlat', 'w')} AS needed FROM visited v JOIN rec r ON r.path = v.path JOIN asked w ON w.query_id = v.query_id WHERE v.open AND v.leaf"),
        ("range_nodes", f"SELECT l.query_id, l.path, m.*, l.k, {overlaps('m.lo', 'm.hi', 'l.q_start', 'l.q_end')} AS meets FROM laid l JOIN mmr m ON m.eid = l.eid WHERE l.needed"),
        ("shown", "SELECT a.* FROM range_nodes a LEFT JOIN range_nodes b ON b.query_id = a.query_id AND b.eid = a.eid AND b.h = a.h + 1 AND b.j = a.j // 2 WHERE b.eid IS NULL OR b.meets"),
        ("sorted_entries", "SELECT eid, tid, start_ts, end_ts, row_number() OVER (PARTITION BY eid ORDER BY start_ts, end_ts, tid) - 1 AS j FROM entries"),
        ("tokens", " UNION ALL ".join([
            row(1, 0, 0, 0, "CASE WHEN NOT open THEN 1 WHEN leaf THEN 3 ELSE 4 END", f"CASE WHEN NOT open THEN hash || meta WHEN leaf THEN meta || {d.u32('n_edges')} ELSE meta END") + " FROM visited",
            row(0, "eid", 2, 0, "CASE WHEN needed THEN 11 ELSE 10 END", f"{geometry} || CASE WHEN needed THEN '' ELSE root END") + " FROM laid",
            row(0, "eid", 1, 0, 24, d.u32("k")) + " FROM laid WHERE needed",
            row(0, "eid", 0, "pos", "CASE WHEN NOT meets THEN 20 ELSE 23 END", f"CASE WHEN NOT meets THEN hash || {d.u32('lo')} || {d.u32('hi')} ELSE '' END") + " FROM shown WHERE NOT meets OR h > 0",
            "SELECT s.query_id, s.path || '3', 0, s.eid, 0, s.pos, 22, '', e.tid, e.start_ts, e.end_ts FROM shown s JOIN sorted_entries e ON e.eid = s.eid AND e.j = s.j WHERE s.meets AND s.h = 0",
        ])),
    ]


def binary(theta: int, weight: str, lists: str) -> list[tuple[str, str]]:
    """tree and placed of the two-way tree; lists: SQL of eid, tid, start_ts, end_ts, rank, total."""
    entry = d.sha(d.text_hex(chains.ENTRY), "r.tid", d.u32("r.start_ts"), d.u32("r.end_ts"))
    step = d.sha(d.text_hex(chains.LIST), entry, "s.state")
    states = f"SELECT * FROM (WITH RECURSIVE st AS (SELECT eid, total AS pos, '{chains.LIST_TAIL}' AS state FROM lists WHERE rank = 1 UNION ALL SELECT s.eid, s.pos - 1, {step} FROM st s JOIN lists r ON r.eid = s.eid AND r.rank = s.pos) SELECT eid, pos, state FROM st) x"
    own = d.sha(d.text_hex(chains.EDGE), d.u32("eid"), d.u32("k"), "root")
    fold = d.sha(d.text_hex(chains.GROUP), "s.state", "o.edge")
    groups = f"SELECT * FROM (WITH RECURSIVE gr AS (SELECT DISTINCT path, CAST(0 AS BIGINT) AS n, '{chains.GROUP_INIT}' AS state FROM in_order UNION ALL SELECT s.path, s.n + 1, {fold} FROM gr s JOIN in_order o ON o.path = s.path AND o.n = s.n + 1) SELECT path, max(n) AS n_edges, arg_max(state, n) AS grp FROM gr GROUP BY path) x"
    box = " || ".join(d.f64(c) for c in BOX)
    return [
        ("lists", lists), ("states", states), *split(theta, weight, True),
        ("placed", f"SELECT *, {own} AS edge FROM (SELECT e.eid, CASE WHEN u_path = v_path THEN u_path ELSE shared END AS path, coalesce(k, 0) AS k, coalesce(state, '{chains.LIST_TAIL}') AS root FROM ends e LEFT JOIN (SELECT eid, total AS k, state FROM lists JOIN states USING (eid) WHERE rank = 1 AND pos = 0) h USING (eid)) x"),
        ("in_order", "SELECT path, edge, row_number() OVER (PARTITION BY path ORDER BY eid) AS n FROM placed"),
        ("groups", groups),
        ("under", f"SELECT node AS path, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, max(n) = length(node) AS leaf FROM ({of_paths(f'p{DEPTH}', 'lon, lat, length(path) AS n')}) x GROUP BY node"),
        ("boxed", f"SELECT u.path, leaf, CASE WHEN leaf THEN 'normal' ELSE 'internal' END AS origin, min_lon, min_lat, max_lon, max_lat, coalesce(n_edges, 0) AS n_edges, coalesce(grp, '{chains.GROUP_INIT}') AS grp, {box} AS meta FROM under u LEFT JOIN groups USING (path)"),
        ("full_nodes", f"SELECT *, {d.sha(d.text_hex('BL-SPATIAL-LEAF-v2'), 'meta', d.u32('n_edges'), 'grp')} AS own FROM boxed"),
        *hashed("hash", d.sha(d.text_hex("BL-SPATIAL-INTERNAL-v2"), "meta", "c.parts", d.u32("n_edges"), "grp")),
    ]


def binary_tokens(windows: str) -> list[tuple[str, str]]:
    """tokens: every row of the proofs of the windows over the sorted lists."""
    row = lambda of_node, eid, phase, pos, token, body, tid="CAST(NULL AS VARCHAR)": f"SELECT query_id, path || '3' AS place, {of_node} AS of_node, CAST({eid} AS BIGINT) AS eid, {phase} AS phase, CAST({pos} AS BIGINT) AS pos, {token} AS token, lower({body}) AS body, {tid} AS tid"
    n = d.u32("n_edges")
    return [
        ("asked", windows),
        ("walk", "SELECT w.query_id, w.q_start, w.q_end, t.*, t.min_lon <= w.max_lon AND t.max_lon >= w.min_lon AND t.min_lat <= w.max_lat AND t.max_lat >= w.min_lat AS open FROM tree t CROSS JOIN asked w"),
        ("visited", "SELECT a.*, l.hash AS h0, r.hash AS h2 FROM walk a LEFT JOIN walk b ON b.query_id = a.query_id AND a.path <> '' AND b.path = substr(a.path, 1, length(a.path) - 1) LEFT JOIN tree l ON l.path = a.path || '0' LEFT JOIN tree r ON r.path = a.path || '2' WHERE a.path = '' OR (b.open AND NOT b.leaf)"),
        ("laid", f"SELECT v.query_id, p.eid, p.path, p.k, p.root, v.q_start, v.q_end, {segment_hits('e.alon', 'e.alat', 'e.blon', 'e.blat', 'w')} AS hit FROM visited v JOIN placed p ON p.path = v.path JOIN edges e ON e.eid = p.eid JOIN asked w ON w.query_id = v.query_id WHERE v.open"),
        ("opened", "SELECT l.query_id, l.eid, l.path, l.k, l.q_start, l.q_end, count(x.eid) AS n_shown FROM laid l LEFT JOIN lists x ON x.eid = l.eid AND x.start_ts <= l.q_end WHERE hit GROUP BY ALL"),
        ("rested", "SELECT *, CASE WHEN n_shown < k THEN 1 ELSE 0 END AS more, n_shown + CASE WHEN n_shown < k THEN 1 ELSE 0 END AS rest FROM opened"),
        ("tokens", " UNION ALL ".join([
            row(1, 0, 0, 0, "CASE WHEN open AND leaf THEN 3 WHEN open THEN 4 WHEN leaf THEN 1 ELSE 2 END", f"meta || CASE WHEN open THEN {n} WHEN leaf THEN {n} || grp ELSE h0 || h2 || {n} || grp END") + " FROM visited",
            row(0, "eid", 0, 0, 10, f"{d.u32('eid')} || {d.u32('k')} || root") + " FROM laid WHERE NOT hit",
            row(0, "r.eid", 1, 0, 11, f"{d.u32('r.eid')} || {d.u32('r.k')} || {d.u32('n_shown')} || printf('%02X', more) || coalesce(s.state, '{chains.LIST_TAIL}')") + " FROM rested r LEFT JOIN states s ON s.eid = r.eid AND s.pos = r.rest",
            row(0, "r.eid", 2, "-x.rank", 12, f"{d.u32('r.eid')} || x.tid || {d.u32('x.start_ts')} || {d.u32('x.end_ts')}", "CASE WHEN x.start_ts <= r.q_end AND x.end_ts >= r.q_start THEN x.tid END") + " FROM rested r JOIN lists x ON x.eid = r.eid AND x.rank <= r.rest",
        ])),
    ]


def oracles(theta: int) -> dict[str, str]:
    one, many = MAIN, matrix(d)
    tree = [*world(d), *sem(theta)]
    weight = "SELECT eid, count(DISTINCT tid) AS weight FROM entries GROUP BY eid"
    two = [*world(d), *binary(theta, weight, RANKED)]
    of_base = [*updated(d), *[c for c in binary(theta, "SELECT eid, count(DISTINCT tid) AS weight FROM base GROUP BY eid", RANKED)]]
    shown = lambda ctes, windows, tokens, body: render([*ctes, *tokens(windows)], body)
    size = "1 + length(body) // 2"
    nodes = "SELECT path, leaf, origin, min_lon, min_lat, max_lon, max_lat, {} n_edges, {} hash FROM tree"
    report = "SELECT query_id, true AS accepted, CAST(NULL AS VARCHAR) AS reason, count(*) AS n_tokens, count(tid) AS n_results FROM tokens GROUP BY query_id"
    points = [*world(d), ("windows", many)]
    inside = lambda key, low, high: f"(SELECT count(*) FROM points p WHERE p.{key} BETWEEN w.{low} AND w.{high})"
    held = "SELECT query_id, true AS accepted, CAST(NULL AS VARCHAR) AS reason, {} AS n_results FROM windows w"
    return {
        "sem_tree": render(tree, nodes.format("lo, hi,", "")),
        "sem_leaf_edges": render(tree, "SELECT eid, path, record FROM rec"),
        "l0_root": render(tree, "SELECT hash AS root FROM tree WHERE path = ''"),
        "sem_origins": render(tree, "SELECT origin, count(*) AS n, min(CASE WHEN leaf THEN n_edges END) AS min_edges, max(CASE WHEN leaf THEN n_edges END) AS max_edges, avg(CASE WHEN leaf THEN n_edges END) AS avg_edges, count(CASE WHEN leaf AND n_edges > 0 THEN 1 END) AS n_filled FROM tree GROUP BY origin"),
        "edge_partition_problems": render(tree, "SELECT eid, 'in no leaf' AS problem FROM edges WHERE eid NOT IN (SELECT eid FROM rec)"),
        "vo_tokens": shown(tree, one, sem_tokens, "SELECT * FROM tokens"),
        "vo_token_histogram": shown(tree, one, sem_tokens, "SELECT token, count(*) AS n FROM tokens GROUP BY token"),
        "vo_sizes": shown(tree, many, sem_tokens, f"SELECT query_id, CAST(16 + sum({size}) AS BIGINT) AS proof_bytes, count(*) AS n_tokens, 16 + 44 * count(tid) AS result_bytes, count(tid) AS n_results FROM tokens GROUP BY query_id"),
        "verify_report": shown(tree, many, sem_tokens, report),
        "append_equals_rebuild": render(tree, "SELECT count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_differing FROM tree"),
        "binary_tree": render(two, nodes.format("", "grp,")),
        "binary_tree_root": render(two, "SELECT hash AS root FROM tree WHERE path = ''"),
        "list_vo_tokens": shown(two, one, binary_tokens, "SELECT * FROM tokens"),
        "list_vo_sizes": shown(two, many, binary_tokens, f"SELECT query_id, CAST(28 + sum(CASE WHEN token = 12 THEN 44 ELSE {size} END) AS BIGINT) AS proof_bytes, count(CASE WHEN token <> 12 THEN 1 END) AS n_tokens, count(CASE WHEN token = 12 THEN 1 END) AS n_entries FROM tokens GROUP BY query_id"),
        "list_verify_report": shown(two, many, binary_tokens, report),
        "query_counters": shown(two, one, binary_tokens, "SELECT query_id, count(CASE WHEN token IN (1, 2, 3, 4) THEN 1 END) AS n_visited, count(CASE WHEN token IN (1, 2) THEN 1 END) AS n_pruned, count(CASE WHEN token IN (10, 11) THEN 1 END) AS n_checked, count(CASE WHEN token = 11 THEN 1 END) AS n_opened, count(CASE WHEN token = 12 THEN 1 END) AS n_scanned, CAST((SELECT sum(more) FROM rested r WHERE r.query_id = t.query_id) AS BIGINT) AS n_boundary, count(tid) AS n_matched FROM tokens t GROUP BY query_id"),
        "list_update_equals_rebuild": render(of_base, "SELECT count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_differing FROM tree"),
        "rtree_verify_report": render(points, held.format("(SELECT count(*) FROM points p WHERE p.lon BETWEEN w.min_lon AND w.max_lon AND p.lat BETWEEN w.min_lat AND w.max_lat)")),
        "btree_verify_report": render(points, held.format(" + ".join(inside(*x) for x in (("lon", "min_lon", "max_lon"), ("lat", "min_lat", "max_lat"), ("ts", "q_start", "q_end"))))),
    }
