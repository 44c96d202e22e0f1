"""Road trees, files of list proofs, JSON sizes and list updates against plain models."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark
from tessera.operators import list_proofs, proofs, road_tree
from tessera.plans import authenticated as auth
from tessera.plans.queries import QUERIES
from tessera.plans.engine import statement
from tessera.plans.world import MAIN, matrix, world
from tests.test_authenticated import halves, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def road(spark):
    own = auth.Road(spark, SF)
    return own.nodes.persist(), own.edges.persist()


def road_model(xy, edges, theta):
    def box(points):
        return (*(min(p[k] for p in points) for k in (0, 1)), *(max(p[k] for p in points) for k in (0, 1))) if points else (0.0,) * 4

    def leaf(es, corners, origin):
        hashes = b"".join(sha(b"ROAD-EDGE-v1" + struct.pack(">qqqdddd", e, *es[e], *xy[es[e][0]], *xy[es[e][1]])) for e in sorted(es))
        return sha(b"ROAD-LEAF-v1" + struct.pack(">ddddiI", *corners, origin, len(es)) + hashes)

    def node(ns, es):
        inside = box([xy[n] for e in es for n in es[e]])
        if not es or len(ns) <= theta:
            return leaf(es, inside if es else box([xy[n] for n in ns]), 0)
        left, right = halves({n: xy[n] for n in ns}, es, {}, False)
        part = [{e: p for e, p in es.items() if set(p) <= side} for side in (left, right)]
        cross = {e: p for e, p in es.items() if e not in part[0] and e not in part[1]}
        below = node(left, part[0]) + leaf(cross, box([xy[n] for e in cross for n in cross[e]]), 1) + node(right, part[1])
        return sha(b"ROAD-INTERNAL-v1" + struct.pack(">dddd", *inside) + below)

    return node(set(xy), edges).hex()


def test_road_proof(spark, road):
    nodes, edges = road
    xy = {r["node_id"]: (r["lon"], r["lat"]) for r in nodes.collect()}
    ends = {r["eid"]: (r["u"], r["v"]) for r in edges.collect()}
    tree, placed = (df.persist() for df in road_tree.road_tree(nodes, edges, auth.THETA))
    root = tree.where("path = ''").first()["hash"]
    assert root == road_model(xy, ends, auth.THETA)
    tokens = road_tree.proof_tokens(tree, placed).persist()
    shown = lambda df, n=len(ends), trusted=root: road_tree.verify_report(df, trusted, n).first()
    assert tuple(shown(tokens)) == (True, None, len(ends))
    some = tokens.where("token = 'E'").first()["body"]
    bad = {
        "an edge dropped": shown(tokens.where(F.col("body") != some)),
        "an edge moved": shown(tokens.withColumn("body", F.when(F.col("body") == some, F.concat(F.expr("substr(body, 1, length(body) - 2)"), F.lit("00"))).otherwise(F.col("body")))),
        "an edge twice": shown(tokens.unionByName(tokens.where(F.col("body") == some))),
        "no leaves": shown(tokens.where("token <> 'L'")),
        "another root": shown(tokens, trusted="00" * 32),
        "another number": shown(tokens, n=len(ends) + 1),
    }
    assert not any(r["accepted"] for r in bad.values()), bad
    size = road_tree.payload_bytes(tokens).first()
    assert size["proof_bytes"] == 44 * size["n_edges"] + 41 * size["n_leaves"] + 45 * size["n_internal"]


def test_road_update(spark, road):
    nodes, edges = road
    xy = {r["node_id"]: (r["lon"], r["lat"]) for r in nodes.collect()}
    ends = {r["eid"]: (r["u"], r["v"]) for r in edges.collect()}
    have = {tuple(sorted(p)) for p in ends.values()}
    added = road_tree.new_edges(nodes, edges, 12)
    pairs = [tuple(sorted(x[1:3])) for x in added]
    assert len(set(pairs)) == 12 and not have & set(pairs) and all(u in xy and v in xy for u, v in pairs)
    assert [x[0] for x in added] == list(range(12)) and all(x[3] <= 2000 for x in added)
    grown = road_tree.with_new_edges(nodes, edges, added)
    now = {r["eid"]: (r["u"], r["v"]) for r in grown.collect()}
    assert sorted(set(now) - set(ends)) == [max(ends) + 1 + k for k in range(12)]
    assert road_tree.road_tree(nodes, grown, auth.THETA)[0].where("path = ''").first()["hash"] == road_model(xy, now, auth.THETA)


def test_road_that_lacks_few_edges(spark, tmp_path):
    """A complete network gets no edge, one that lacks three gets these; a full pool of near nodes is widened."""
    xy = [(k, 104.0 + k % 5 / 100, 30.0 + k // 5 / 100) for k in range(20)]
    nodes = spark.createDataFrame(xy, "node_id long, lon double, lat double")
    every = [(a, b) for a in range(20) for b in range(a + 1, 20)]
    lacking = {(0, 1), (2, 9), (4, 19)}
    table = lambda pairs: spark.createDataFrame([(k, a, b, *xy[a][1:], *xy[b][1:]) for k, (a, b) in enumerate(pairs)], "eid long, u long, v long, ulon double, ulat double, vlon double, vlat double")
    whole = table(every)
    assert road_tree.new_edges(nodes, whole, 10) == []
    assert road_tree.with_new_edges(nodes, whole, []).count() == len(every)
    added = road_tree.new_edges(nodes, table([p for p in every if p not in lacking]), 10)
    assert {tuple(sorted(x[1:3])) for x in added} == lacking and len({x[0] for x in added}) == 3
    far = spark.createDataFrame([*xy, *((k, 120.0 + k, 40.0) for k in range(20, 22))], "node_id long, lon double, lat double")
    road_tree.WIDE_POOL, old = 4, road_tree.WIDE_POOL
    try:
        added = road_tree.new_edges(far, whole, 10)
    finally:
        road_tree.WIDE_POOL = old
    assert len({tuple(sorted(x[1:3])) for x in added}) == 10 and all(max(x[1:3]) >= 20 for x in added)
    events = spark.createDataFrame([(4 * k + i, 1_704_000_000 + 100 * (4 * k + i), k, f'{{"k": {n}}}') for k, (a, b) in enumerate((a, b) for a in range(9) for b in range(a + 1, 9)) for i, n in enumerate((a, b))], "event_id long, t long, user_id long, props string")
    events.selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "props").write.parquet(f"{tmp_path}/events.parquet")
    assert auth.road_new_edges(spark, str(tmp_path)).count() == 0
    report = {r["state"]: r for r in auth.road_update_report(spark, str(tmp_path)).collect()}
    assert report["before"]["root"] == report["after"]["root"] and report["before"]["accepted"] and report["after"]["accepted"]


def test_list_proof_file(spark, tmp_path):
    built = auth.list_tree(spark, SF)
    root = built[0].where("path = ''").first()["hash"]
    tokens = list_proofs.proof_tokens(*built, spark.sql(MAIN)).persist()
    window = tuple(spark.sql(MAIN).first())[1:]
    copy = {r["eid"]: (r["ulon"], r["ulat"], r["vlon"], r["vlat"]) for r in built[4].collect()}
    path = f"{tmp_path}/p"
    list_proofs.save(tokens, "main", path)
    assert list_proofs.verify_file(path, window, copy, root) == {r["tid"] for r in QUERIES["coarse_candidates"](spark, SF).collect()}
    raw = (tmp_path / "p").read_bytes()
    size = list_proofs.sizes(tokens).first()
    assert len(raw) == size["proof_bytes"] and struct.unpack(">8sIQQ", raw[:28]) == (b"BLVO0002", 2, size["n_tokens"], size["n_entries"])
    for where in (4, 11, 27, 60, len(raw) // 2, len(raw) - 50, len(raw) - 2):
        (tmp_path / "q").write_bytes(raw[:where] + bytes([raw[where] ^ 1]) + raw[where + 1 :])
        with pytest.raises((proofs.Rejected, struct.error)):
            list_proofs.verify_file(f"{tmp_path}/q", window, copy, root)
    for data in (raw[:-44], raw + b"x", raw[:20]):
        (tmp_path / "q").write_bytes(data)
        with pytest.raises((proofs.Rejected, struct.error)):
            list_proofs.verify_file(f"{tmp_path}/q", window, copy, root)
    with pytest.raises(proofs.Rejected):
        list_proofs.verify_file(path, window, {}, root)


def test_backwards(tmp_path):
    (tmp_path / "f").write_bytes(b"xx" + bytes(range(20)))
    with open(tmp_path / "f", "rb") as f:
        assert [list(x) for x in list_proofs._backwards(f, 2, 10, 2, block=3)] == [[k, k + 1] for k in range(18, -1, -2)]
        assert list(list_proofs._backwards(f, 2, 0, 2)) == []


def test_json_sizes(spark):
    """Lengths of the proofs as json.dumps writes them, for all windows."""
    rows = statement(spark, SF, world(Spark), "SELECT point_id, tid, lon, lat, CAST(ts AS DOUBLE) AS ts FROM points").collect()

    def packed(key):
        level = sorted((r[key], r["point_id"], r["tid"]) for r in rows)
        level = [{"lo": x[0][0], "hi": x[-1][0], "entries": x} for x in (level[i : i + 128] for i in range(0, len(level), 128))]
        while len(level) > 1:
            level = [{"lo": x[0]["lo"], "hi": x[-1]["hi"], "children": x} for x in (level[i : i + 64] for i in range(0, len(level), 64))]
        return level[0]

    def walk(n, low, high):
        ends = {"min_token": n["lo"], "max_token": n["hi"]}
        if n["hi"] < low or n["lo"] > high:
            return {"type": "stub", **ends, "hash": "0" * 64}
        if "entries" in n:
            return {"type": "leaf", **ends, "entries": [list(e) for e in n["entries"]]}
        return {"type": "internal", **ends, "children": [walk(c, low, high) for c in n["children"]]}

    trees = {k: packed(k) for k in ("lon", "lat", "ts")}
    size = lambda x: len(json.dumps(x, separators=(",", ":")))
    want = {}
    for w in spark.sql(matrix(Spark)).collect():
        parts = [{"version": 1, "dimension": name, "low": float(low), "high": float(high), "root": walk(trees[k], float(low), float(high))} for k, name, low, high in (("lon", "lon", w["min_lon"], w["max_lon"]), ("lat", "lat", w["min_lat"], w["max_lat"]), ("ts", "time", w["q_start"], w["q_end"]))]
        query = {"min_lon": w["min_lon"], "max_lon": w["max_lon"], "min_lat": w["min_lat"], "max_lat": w["max_lat"], "start_time": w["q_start"], "end_time": w["q_end"]}
        whole = {"version": 2, "query": query, "trusted_global_root": "0" * 64, **dict(zip(("vo_lon", "vo_lat", "vo_time"), parts, strict=True))}
        want[w["query_id"]] = (*map(size, parts), size(whole))
    got = {r["query_id"]: (r["lon_bytes"], r["lat_bytes"], r["time_bytes"], r["json_bytes"]) for r in auth.btree_json_sizes(spark, SF).collect()}
    assert got == want


def test_list_update(spark):
    ours, full = auth.updated_lists(spark, SF)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, full.select(ours.columns).collect()))
