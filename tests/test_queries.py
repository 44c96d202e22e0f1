"""Queries against DuckDB, the known counts of the fixtures, and a byte-level model of the hashes."""

import glob
import hashlib
import os
import struct

import duckdb
import pytest

from pyspark.sql import functions as F

from tessera.functions.dialect import Spark
from tessera.operators import mmr, packed_proofs
from tessera.plans import analytics, authenticated
from tessera.plans.engine import statement
from tessera.plans.queries import ORACLE, QUERIES, points
from tessera.plans.world import MAIN, world
from tessera.sources import road, trajectories
from tessera.streaming import mmr_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE | analytics.ORACLE | authenticated.ORACLE))
def test_oracle(spark, duck, name):
    found = duck.sql((ORACLE | analytics.ORACLE | authenticated.ORACLE)[name])
    df = (QUERIES | analytics.QUERIES | authenticated.QUERIES)[name](spark, SF)
    assert sorted(df.columns) == sorted(found.columns)
    key = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(key(r) for r in df.select(found.columns).collect()) == sorted(key(r) for r in found.fetchall())


def test_fixture_counts(spark):
    n = {q: QUERIES[q](spark, SF).count() for q in ("road_nodes", "road_edges", "trajectory_ids", "entries", "coarse_candidates", "exact_result")}
    assert n == {"road_nodes": 100, "road_edges": 879, "trajectory_ids": 15, "entries": 973, "coarse_candidates": 11, "exact_result": 9}
    assert min(r["tid"] for r in QUERIES["trajectory_ids"](spark, SF).collect()).startswith("09dbb5637898")


def test_roots_against_appends(spark):
    """Bulk roots equal those of leaves appended one by one."""
    by: dict = {}
    for r in QUERIES["entries"](spark, SF).collect():
        by.setdefault(r["eid"], []).append((r["start_ts"], r["end_ts"], r["tid"]))
    true = {}
    for eid, rows in by.items():
        peaks = []
        for k, (s, e, t) in enumerate(sorted(rows)):
            mmr_stream.append(peaks, k, t, s, e)
        true[eid] = mmr_stream.root(peaks, len(rows))
    assert {r["eid"]: r["root"] for r in QUERIES["mmr_roots"](spark, SF).collect()} == true


def test_rtree_hashes_against_packed_records(spark):
    """Leaves of up to 128 points, then one level of up to 64 children, packed with struct."""
    points = {r["point_id"]: r for r in statement(spark, SF, world(Spark), "SELECT point_id, tid, ts, lon, lat FROM points").collect()}
    order = [points[r["point_id"]] for r in QUERIES["morton_order"](spark, SF).orderBy("r").collect()]
    sha = lambda b: hashlib.sha256(b).digest()
    leaves = []
    for i in range(0, len(order), 128):
        part = order[i : i + 128]
        raw = b"".join(struct.pack("<Q32sddd", p["point_id"], bytes.fromhex(p["tid"]), p["lon"], p["lat"], p["ts"]) for p in part)
        lon, lat = [p["lon"] for p in part], [p["lat"] for p in part]
        leaves.append(struct.pack("<dddd", min(lon), min(lat), max(lon), max(lat)) + sha(b"L" + struct.pack("<I", len(part)) + raw))
    nodes = QUERIES["rtree_nodes"](spark, SF)
    assert len(order) == len(points)
    assert [struct.pack("<dddd", r["x0"], r["y0"], r["x1"], r["y1"]) + bytes.fromhex(r["hash"]) for r in nodes.where("h = 0").orderBy("idx").collect()] == leaves
    assert [bytes.fromhex(r["hash"]) for r in nodes.where("h = 1").collect()] == [sha(b"I" + struct.pack("<H", len(leaves)) + b"".join(leaves))]


@pytest.mark.parametrize("k", range(0, 70, 7))
def test_peaks(k):
    peaks = []
    for i in range(k):
        mmr_stream.append(peaks, i, "00" * 32, i, i + 1)
    assert [p[0] for p in peaks] == [h for h in range(31, -1, -1) if k >> h & 1]
    assert k or mmr_stream.root(peaks, 0) == hashlib.sha256(bytes(4)).hexdigest()


def streamed(spark, folder, rows, name, time_safe):
    """The last k and root of each edge after three micro-batches of rows in their order of arrival."""
    for part in range(3):
        spark.createDataFrame(rows.iloc[part * 400 : (part + 1) * 400]).coalesce(1).write.parquet(f"{folder}/in", mode="append")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = mmr_stream.stream_roots(source, time_safe=time_safe).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table(name).collect():
        if r["k"] >= last.get(r["eid"], (0,))[0]:
            last[r["eid"]] = (r["k"], r["root"])
    return last


def test_stream_equals_batch(spark, tmp_path):
    """Roots after the stream are those of the batch in the same order; late entries of an edge are dropped if asked."""
    rows = QUERIES["entries"](spark, SF).orderBy("start_ts", "end_ts", "tid").toPandas()
    rows["arrival_seq"] = range(len(rows))
    want = {r["eid"]: (r["k"], r["root"]) for r in QUERIES["mmr_roots"](spark, SF).collect()}
    assert streamed(spark, tmp_path / "a", rows, "mmr_roots_stream", False) == want
    late = rows.iloc[[i ^ 1 if i ^ 1 < len(rows) else i for i in range(len(rows))]].reset_index(drop=True)
    late["arrival_seq"] = range(len(late))
    kept, tail = {}, {}
    for r in late.itertuples():
        if r.start_ts >= tail.get(r.eid, 0):
            peaks = kept.setdefault(r.eid, [])
            mmr_stream.append(peaks, sum(1 << p[0] for p in peaks), r.tid, r.start_ts, r.end_ts)
            tail[r.eid] = r.start_ts
    model = {e: (sum(1 << p[0] for p in peaks), mmr_stream.root(peaks, sum(1 << p[0] for p in peaks))) for e, peaks in kept.items()}
    assert streamed(spark, tmp_path / "b", late, "mmr_late_stream", True) == model


def test_append_or_rebuild(spark):
    """MMRs that grow at their end, or anew where an entry comes earlier, equal a build of all."""
    entries = QUERIES["entries"](spark, SF).withColumn("base", F.expr("xxhash64(eid, tid, start_ts) % 3 <> 0")).persist()
    base, delta = (entries.where(c).drop("base") for c in ("base", "NOT base"))
    nodes = mmr.mmr_nodes(base)
    grown, how = mmr.append_or_rebuild(nodes, base, delta)
    touched = delta.select("eid").distinct()
    whole = mmr.mmr_nodes(entries.drop("base")).join(touched, "eid", "left_semi")
    row = lambda df: sorted(map(tuple, df.select("eid", "h", "j", "pos", "hash", "lo", "hi").collect()))
    assert row(grown) == row(whole)
    assert {r["rebuilt"] for r in how.collect()} == {True, False}


@pytest.mark.parametrize("cap, fanout", [(4, 4), (3, 2)])
def test_trees_of_many_levels(spark, cap, fanout):
    """B-trees and the R-tree go up to one node whatever their height, against recursive models; their proofs hold."""
    sha = lambda b: hashlib.sha256(b).digest()
    rows = statement(spark, SF, world(Spark), "SELECT point_id, tid, ts, lon, lat FROM points").collect()
    roots = []
    for key in ("lon", "lat", "ts"):
        order = sorted(rows, key=lambda p: (p[key], p["point_id"], p["tid"]))
        leaves = [order[i : i + cap] for i in range(0, len(order), cap)]
        level = [(struct.pack(">dd", x[0][key], x[-1][key]), sha(b"THREE-MBT-LEAF-v1" + struct.pack(">Q", len(x)) + b"".join(struct.pack(">dQQ", p[key], p["point_id"], 32) + bytes.fromhex(p["tid"]) for p in x))) for x in leaves]
        height = 1
        while len(level) > 1:
            groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            level = [(x[0][0][:8] + x[-1][0][8:], sha(b"THREE-MBT-INTERNAL-v1" + struct.pack(">Q", len(x)) + b"".join(b + struct.pack(">Q", 32) + h for b, h in x))) for x in groups]
            height += 1
        assert height > 4
        found = statement(spark, SF, points(Spark, cap, fanout), f"SELECT h, hash FROM {key}_nodes").collect()
        assert max(r["h"] for r in found) == height - 1 and [r["hash"] for r in found if r["h"] == height - 1] == [level[0][1].hex()]
        roots.append(level[0][1])
    proofs_, asked, root = authenticated.key_proofs(spark, SF, MAIN, cap, fanout)
    assert root == sha(b"THREE-MBT-ROOT-v1" + b"".join(roots)).hex()
    claimed = {k: packed_proofs.disclosed(proofs_[k], asked[k], packed_proofs.KEYS) for k in ("lon", "lat", "ts")}
    claimed["all"] = QUERIES["three_way_candidates"](spark, SF).selectExpr("'main' AS query_id", "tid")
    assert packed_proofs.verify_keys(proofs_, asked, root, claimed).first()["accepted"]
    report = packed_proofs.verify_keys(proofs_, asked, root, {"lat": claimed["lat"].limit(1)}).first()
    assert not report["accepted"] and report["reason"] == "the claimed candidates differ"
    proof, windows, root = authenticated.box_proofs(spark, SF, MAIN, cap, fanout)
    assert packed_proofs.verify_boxes(proof, windows, root).first()["accepted"]
    assert authenticated.btree_insert_root(spark, SF, cap, fanout).count() == authenticated.rtree_insert_root(spark, SF, cap, fanout).count() == 1


def test_trees_without_points(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").where("false").write.parquet(f"{tmp_path}/events.parquet")
    empty = hashlib.sha256(b"THREE-MBT-ROOT-v1" + bytes(96)).hexdigest()
    assert QUERIES["btree_root"](spark, str(tmp_path)).first()["root"] == empty
    assert QUERIES["rtree_root"](spark, str(tmp_path)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "n.txt").write_text("0 1.0 2.0\n\n1  1.5 2.5\n5 3 4\n")
    (tmp_path / "e.txt").write_text("0 0 1\n3 1 0\n2 1 5\n")
    nodes = road.read_nodes(spark, str(tmp_path / "n.txt"))
    edges = road.read_edges(spark, str(tmp_path / "e.txt"), nodes, parallel="least")
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 1, 1.0, 2.0, 1.5, 2.5), (2, 1, 5, 1.5, 2.5, 3.0, 4.0)]
    assert road.violations(nodes, edges).count() == 0
    assert road.violations(nodes.where("node_id < 5"), edges).collect()[0]["id"] == 2
    (tmp_path / "traj-10-7.json").write_text("[[[0,1,5],[[0,1],[1,5]],[[[100,2,1],[110,2,1]],[[112,3,2],[120,4,3]]],0]]]")
    rows = trajectories.read_city_json(spark, str(tmp_path / "traj-10-7.json"))
    assert [tuple(r)[2:] for r in trajectories.city_segments(rows).orderBy("seq").collect()] == [(0, 0, 1, 100, 110), (1, 1, 5, 110, 120)]
    (tmp_path / "p.csv").write_text('source_traj_id,points_data\na,"[[1,116,39,100],[2,117,40,110],[2,117,40,115],[3,118,41,120]]"\nb,"[[1,1,1,1]]"\n')
    csv = trajectories.read_points_csv(spark, str(tmp_path / "p.csv"))
    assert [tuple(r)[2:] for r in trajectories.csv_segments(csv).orderBy("seq").collect()] == [(1, 2, 100, 110), (2, 3, 115, 120)]
    names = spark.createDataFrame([("traj-10-10",), ("traj-10-7",)], "f string")
    assert [r[0] for r in names.orderBy(trajectories.natural_key("f")).collect()] == ["traj-10-7", "traj-10-10"]
    three = spark.createDataFrame([(1, "t", 100.0, 39.0, 116.0), (2, "t", 110.0, 40.0, 117.0), (3, "t", 120.0, 41.0, 118.0)], "point_id long, tid string, ts double, lat double, lon double")
    dense = trajectories.densify(three).orderBy("ordinal").collect()
    assert len(dense) == 21 and dense[0]["lon"] == 116 and dense[-1]["ts"] == 120


def test_points_at_one_second(spark, tmp_path):
    """Pairs of points without duration, most of them outside the windows."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.where("event_id % 2 = 0").withColumn("event_id", F.col("event_id") + 10_000_000)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("exact_result_points", "exact_result_boxes"):
        want = sorted(c.sql(ORACLE[name]).fetchall())
        assert want and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select("query_id", "tid").collect())) == want
