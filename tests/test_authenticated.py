"""Trees, proofs and chains against recursive models; tampered proofs are refused."""

import bisect
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tessera.operators import inserts, list_proofs, packed_proofs, proofs, spatial_tree
from tessera.plans import authenticated as auth
from tessera.plans.queries import ORACLE, QUERIES
from tessera.plans.world import MAIN

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).digest()


@pytest.fixture(scope="module")
def built(spark):
    return tuple(df.persist() for df in auth.main_tree(spark, SF))


@pytest.fixture(scope="module")
def windows(spark):
    return spark.sql(MAIN)


@pytest.fixture(scope="module")
def tokens(built, windows):
    return proofs.proof_tokens(*built, windows).persist()


def halves(xy, edges, weight, doubled):
    """The sides of a set of nodes, by the rule in plain Python."""
    nodes = sorted(xy)
    span = [max(xy[n][k] for n in nodes) - min(xy[n][k] for n in nodes) for k in (0, 1)]
    order = sorted(nodes, key=lambda n: (xy[n][0 if span[0] >= span[1] else 1], n))
    load = dict.fromkeys(nodes, 0)
    for e, (u, v) in edges.items():
        for end in (u, v) if doubled else {u, v}:
            load[end] += weight.get(e, 1)
    total = sum(load.values())
    cut = len(order) // 2
    if total:
        cut = min(range(1, len(order)), key=lambda p: (abs(2 * sum(load[n] for n in order[:p]) - total), p))
    return set(order[:cut]), set(order[cut:])


def sem_model(xy, edges, records, theta):
    """(hash, packed box and times) of a node, recursively."""
    def times(es):
        return min((records[e][0] for e in es), default=2**32 - 1), max((records[e][1] for e in es), default=0)

    def box(points):
        return (*(min(p[k] for p in points) for k in (0, 1)), *(max(p[k] for p in points) for k in (0, 1))) if points else (0.0,) * 4

    def leaf(es, corners):
        meta = struct.pack(">ddddII", *corners, *times(es))
        return sha(meta + sha(b"".join(records[e][2] for e in sorted(es)))), meta

    def node(ns, es):
        inside = box([xy[n] for e in es for n in es[e]])
        if not es or len(ns) <= theta:
            return leaf(es, inside if es else box([xy[n] for n in ns]))
        left, right = halves({n: xy[n] for n in ns}, es, {}, False)
        part = [{e: p for e, p in es.items() if set(p) <= side} for side in (left, right)]
        cross = {e: p for e, p in es.items() if e not in part[0] and e not in part[1]}
        below = [node(left, part[0]), leaf(cross, box([xy[n] for e in cross for n in cross[e]])), node(right, part[1])]
        meta = struct.pack(">ddddII", *inside, *times(es))
        return sha(meta + b"".join(h + m for h, m in below)), meta

    return node(set(xy), edges)[0].hex()


def test_sem_root(spark, built):
    road = auth.Road(spark, SF)
    xy = {r["node_id"]: (r["lon"], r["lat"]) for r in road.nodes.collect()}
    edges = {r["eid"]: (r["u"], r["v"]) for r in road.edges.collect()}
    records = {r["eid"]: (r["lo"], r["hi"], bytes.fromhex(r["record"])) for r in built[1].collect()}
    r = built[1].where("eid = 5").first()
    packed = struct.pack(">IddddIII32s", 5, r["ulon"], r["ulat"], r["vlon"], r["vlat"], r["k"], r["lo"], r["hi"], bytes.fromhex(r["root"]))
    assert sha(packed).hex() == r["record"] and set(records) == set(edges)
    assert built[0].where("path = ''").first()["hash"] == sem_model(xy, edges, records, auth.THETA)


@pytest.mark.parametrize("theta", [2, 3])
def test_small_networks(spark, theta):
    """Gaps, a loop, an edge without entries, nodes without edges, an empty middle, one node."""
    xy = {0: (0.0, 0.0), 1: (1.0, 0.0), 2: (2.0, 0.0), 3: (3.0, 0.0), 7: (9.0, 1.0), 8: (9.0, 2.0), 9: (9.0, 3.0), 12: (10.0, 1.0)}
    ends = {0: (0, 1), 2: (1, 2), 5: (3, 3), 6: (2, 3)}
    nodes = spark.createDataFrame([(n, *p) for n, p in xy.items()], "node_id long, lon double, lat double")
    edges = spark.createDataFrame([(e, u, v, *xy[u], *xy[v]) for e, (u, v) in ends.items()], "eid long, u long, v long, ulon double, ulat double, vlon double, vlat double")
    roots = spark.createDataFrame([(0, 1, "ab" * 32, 10, 20), (2, 2, "cd" * 32, 5, 9)], "eid long, k long, root string, lo long, hi long")
    tree, records = spatial_tree.sem_tree(nodes, edges, roots, theta)
    found = {r["eid"]: (r["lo"], r["hi"], bytes.fromhex(r["record"])) for r in records.collect()}
    assert found[5][:2] == (2**32 - 1, 0)
    assert tree.where("path = ''").first()["hash"] == sem_model(xy, ends, found, theta)
    one = spatial_tree.sem_tree(nodes.limit(1), edges.limit(0), roots, theta)[0].collect()
    assert len(one) == 1 and one[0]["origin"] == "normal"
    assert spatial_tree.sem_tree(nodes.limit(0), edges.limit(0), roots, theta)[0].count() == 0


def test_binary_root(spark):
    road = auth.Road(spark, SF)
    xy = {r["node_id"]: (r["lon"], r["lat"]) for r in road.nodes.collect()}
    edges = {r["eid"]: (r["u"], r["v"]) for r in road.edges.collect()}
    weight = {r["eid"]: r["n"] for r in QUERIES["edge_distinct_trajectories"](spark, SF).collect()}
    lists: dict = {}
    for r in road.sql("SELECT * FROM ranked ORDER BY eid, rank", (("ranked", auth.RANKED),)).collect():
        lists.setdefault(r["eid"], []).append(r)
    hashes = {}
    for eid in edges:
        state = sha(b"BL-SORTED-LIST-TAIL-v2")
        for r in reversed(lists[eid]):
            state = sha(b"BL-SORTED-LIST-CHAIN-v2" + sha(b"BL-ENTRY-v2" + bytes.fromhex(r["tid"]) + struct.pack(">II", r["start_ts"], r["end_ts"])) + state)
        hashes[eid] = sha(b"BL-EDGE-v2" + struct.pack(">II", eid, len(lists[eid])) + state)

    def node(ns, es):
        box = struct.pack(">dddd", *(f(xy[n][k] for n in ns) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1))))
        inner = len(ns) > auth.THETA
        below, own = b"", es
        if inner:
            left, right = halves({n: xy[n] for n in ns}, es, weight, True)
            part = [{e: p for e, p in es.items() if set(p) <= side} for side in (left, right)]
            own = [e for e in es if e not in part[0] and e not in part[1]]
            below = node(left, part[0]) + node(right, part[1])
        group = sha(b"BL-EDGE-GROUP-INIT-v2")
        for e in sorted(own):
            group = sha(b"BL-EDGE-GROUP-v2" + group + hashes[e])
        return sha((b"BL-SPATIAL-INTERNAL-v2" if inner else b"BL-SPATIAL-LEAF-v2") + box + below + struct.pack(">I", len(own)) + group)

    assert auth.binary_tree_root(spark, SF).first()["root"] == node(set(xy), edges).hex()


def test_proofs_hold_and_disclose_the_candidates(spark, built, tokens):
    report = auth.verify_report(spark, SF).collect()
    assert len(report) == 30 and all(r["accepted"] for r in report), report
    want = {r["tid"] for r in QUERIES["coarse_candidates"](spark, SF).collect()}
    assert {r["tid"] for r in tokens.where("tid is not null").collect()} == want
    assert ORACLE["coarse_candidates"]


def test_tampered_proofs(spark, built, tokens, windows, tmp_path):
    root = built[0].where("path = ''").first()["hash"]
    window = tuple(windows.first())[1:]
    proofs.save(tokens, "main", f"{tmp_path}/p", f"{tmp_path}/r")
    assert len(proofs.verify_files(f"{tmp_path}/p", f"{tmp_path}/r", window, root)) == 11
    size = proofs.sizes(tokens).first()
    proof, result = (tmp_path / "p").read_bytes(), (tmp_path / "r").read_bytes()
    assert (len(proof), len(result)) == (size["proof_bytes"], size["result_bytes"])
    shown = lambda df: proofs.verify_report(df, windows, root).first()
    assert shown(tokens)["accepted"]
    last = tokens.where("tid is not null").agg(F.max("end_ts")).first()[0]
    bad = {
        "a later end": tokens.withColumn("end_ts", F.when(F.col("end_ts") == last, F.col("end_ts") + 1).otherwise(F.col("end_ts"))),
        "another trajectory": tokens.withColumn("tid", F.when(F.col("end_ts") == last, F.sha2("tid", 256)).otherwise(F.col("tid"))),
        "no results": tokens.where("token <> 22"),
        "a wrong hash": tokens.withColumn("body", F.when(F.col("token") == 20, F.regexp_replace("body", "^..", "00")).otherwise(F.col("body"))),
        "no nodes": tokens.where("token < 1 or token > 4"),
    }
    for name, df in bad.items():
        assert not shown(df)["accepted"], name
    for where in (40, len(proof) // 2, len(proof) - 3):
        (tmp_path / "q").write_bytes(proof[:where] + bytes([proof[where] ^ 1]) + proof[where + 1 :])
        with pytest.raises(proofs.Rejected):
            proofs.verify_files(f"{tmp_path}/q", f"{tmp_path}/r", window, root)
    (tmp_path / "s").write_bytes(result + b"x")
    with pytest.raises(proofs.Rejected):
        proofs.verify_files(f"{tmp_path}/p", f"{tmp_path}/s", window, root)
    wider = (window[0] - 0.01, *window[1:])
    with pytest.raises(proofs.Rejected):
        proofs.verify_files(f"{tmp_path}/p", f"{tmp_path}/r", wider, root)


def test_list_proofs(spark, windows):
    built = tuple(df.persist() for df in auth.list_tree(spark, SF))
    root = built[0].where("path = ''").first()["hash"]
    tokens = list_proofs.proof_tokens(*built, windows).persist()
    shown = lambda df: list_proofs.verify_report(df, built[4], windows, root).first()
    assert shown(tokens)["accepted"], shown(tokens)
    assert {r["tid"] for r in tokens.where("tid is not null").collect()} == {r["tid"] for r in QUERIES["coarse_candidates"](spark, SF).collect()}
    assert tokens.where("token = 12").count() >= tokens.where("tid is not null").count() > 0
    many = auth.list_verify_report(spark, SF).collect()
    assert len(many) == 30 and all(r["accepted"] for r in many), many
    one = tokens.where("token = 12").first()["body"]
    bad = {
        "a later end": tokens.withColumn("body", F.when(F.col("body") == one, F.concat(F.expr("substr(body, 1, length(body) - 1)"), F.lit("f"))).otherwise(F.col("body"))),
        "an entry dropped": tokens.where(F.col("body") != one),
        "an edge dropped": tokens.where("token <> 10"),
        "a wrong suffix": tokens.withColumn("body", F.when(F.col("token") == 11, F.regexp_replace("body", "..$", "00")).otherwise(F.col("body"))),
        "a box moved": tokens.withColumn("body", F.when(F.col("token") < 3, F.regexp_replace("body", "^.{16}", "405a0000000000ff")).otherwise(F.col("body"))),
    }
    for name, df in bad.items():
        assert not shown(df)["accepted"], name


def test_packed_proofs(spark):
    proof, asked, root = auth.box_proofs(spark, SF, MAIN)
    assert root == QUERIES["rtree_root"](spark, SF).first()["root"]
    boxes = lambda df: packed_proofs.verify_boxes(df, asked, root).first()
    assert boxes(proof)["accepted"], boxes(proof)
    one = proof.where("token = 3").first()["body"]
    moved = proof.withColumn("body", F.when(F.col("body") == one, F.concat(F.lit("00"), F.expr("substr(body, 3)"))).otherwise(F.col("body")))
    assert not boxes(moved)["accepted"] and not boxes(proof.where(F.col("body") != one))["accepted"]
    assert {r["tid"] for r in auth.rtree_disclosed_candidates(spark, SF).collect()} == {r["tid"] for r in QUERIES["rtree_candidates"](spark, SF).collect()}
    proofs_, windows, root = auth.key_proofs(spark, SF, MAIN)
    assert root == QUERIES["btree_root"](spark, SF).first()["root"]
    keys = lambda p: packed_proofs.verify_keys(p, windows, root).first()
    assert keys(proofs_)["accepted"], keys(proofs_)
    cut = proofs_["lon"].where("token <> 0")
    assert not keys({**proofs_, "lon": cut})["accepted"]
    assert all(r["accepted"] for r in auth.rtree_verify_report(spark, SF).collect())


@pytest.mark.parametrize("last_of_equal", [True, False])
def test_inserts_against_a_loop(spark, last_of_equal):
    """Ties across leaves, keys below the first and above the last leaf, an empty tree, no new rows."""
    old = sorted([(k, i) for i, k in enumerate([1.0, 2.0, 2.0, 2.0, 2.0, 2.0, 5.0, 7.0, 7.0, 9.0])])
    new = [(k, 100 + i) for i, k in enumerate([0.0, 2.0, 2.0, 3.0, 7.0, 7.5, 9.0, 12.0, 13.0, 2.0])]
    schema, cap = "k double, id long", 2

    def model(rows, more):
        leaves = [rows[i : i + cap] for i in range(0, len(rows), cap)]
        tops, extra = [leaf[-1][0] for leaf in leaves], [[] for _ in leaves]
        for row in more:
            at = bisect.bisect_left(tops, row[0])
            if last_of_equal and at < len(tops) and tops[at] == row[0]:
                at = bisect.bisect_right(tops, row[0]) - 1
            extra[min(at, len(tops) - 1)].append(row)
        full = [sorted(a + b) for a, b in zip(leaves, extra, strict=True)]
        return [tuple(x[i : i + cap]) for x in full for i in range(0, len(x), cap)]

    def ours(rows, more):
        placed = spark.createDataFrame([(*r, i // cap, i % cap) for i, r in enumerate(rows)], f"{schema}, idx long, r long")
        got: dict = {}
        for r in inserts.insert(placed, spark.createDataFrame(more, schema), "k", ["k", "id"], cap, last_of_equal=last_of_equal).orderBy("idx", "r").collect():
            got.setdefault(r["idx"], []).append((r["k"], r["id"]))
        assert sorted(got) == list(range(len(got)))
        return [tuple(v) for v in got.values()]

    assert ours(old, new) == model(old, new)
    assert ours(old, []) == model(old, [])
    assert ours([], new) == [tuple(sorted(new)[i : i + cap]) for i in range(0, len(new), cap)]


def test_insert_roots(spark):
    for key, order in (("lon", ("lon", "point_id", "tid")), ("morton", ("morton", "point_id"))):
        rows = auth.insert_points(spark, SF, key).collect()
        assert len(rows) == QUERIES["morton_order"](spark, SF).count()
        by: dict = {}
        for r in sorted(rows, key=lambda r: (r["idx"], r["r"])):
            by.setdefault(r["idx"], []).append(tuple(r[c] for c in order))
        keys = [x[0] for v in by.values() for x in v]
        assert max(map(len, by.values())) <= 128 and keys == sorted(keys) and all(v == sorted(v) for v in by.values())
    assert len(auth.btree_insert_root(spark, SF).first()["root"]) == len(auth.rtree_insert_root(spark, SF).first()["root"]) == 64


def test_update_equals_rebuild(spark, built):
    ours, full = auth.updated_trees(spark, SF)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, full.select(ours.columns).collect()))
    few = spark.createDataFrame([(3, 1, "ab" * 32, 5, 2000000000)], "eid long, k long, root string, lo long, hi long")
    tree, records = spatial_tree.updated_tree(built[0], built[1], few)
    assert records.where("eid = 3").first()["root"] == "ab" * 32
    before = {r["path"]: r["hash"] for r in built[0].collect()}
    after = {r["path"]: r["hash"] for r in tree.collect()}
    leaf = records.where("eid = 3").first()["path"]
    assert set(after) == set(before) and {p for p in before if after[p] != before[p]} == {leaf[:k] for k in range(len(leaf) + 1)}
    delta = spark.createDataFrame([(3, 10, 20), (99999, 10, 20), (4, 20, 10)], "eid long, start_ts long, end_ts long")
    assert sorted(map(tuple, spatial_tree.delta_problems(built[1], delta).collect())) == [(4, "ends before its start"), (99999, "unknown edge")]
