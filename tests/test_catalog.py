"""Catalogue lookups and audits, raw road data, SQL functions, minutes over a stream, command line."""

import hashlib
import struct

from tessera.__main__ import main
from tessera.functions.register import register_functions
from tessera.sources import catalog
from tessera.streaming.minutes import minute_counts


def test_catalog(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "tid string, x int")
    found, missing = catalog.lookup(rows, spark.createDataFrame([("b",), ("c",), ("c",)], "tid string"))
    assert found.count() == 2 and [r["tid"] for r in missing.collect()] == ["c"]
    assert [tuple(r) for r in catalog.repeated(rows).collect()] == [("b", 2)]
    tid = hashlib.sha256(struct.pack(">4I", 7, 8, 100, 140)).hexdigest()
    segments = [(t, s, e, a, b) for t in (tid, "00" * 32) for s, e, a, b in ((1, 7, 100, 120), (2, 8, 120, 140))]
    wrong = catalog.audit_ids(spark.createDataFrame(segments, "tid string, seq long, eid long, start_ts long, end_ts long")).collect()
    assert [tuple(r) for r in wrong] == [("00" * 32, tid)]
    side = spark.createDataFrame([(0, tid), (1, "zz"), (1, tid), (5, tid)], "ordinal long, trajectory_id string")
    got = catalog.audit_sidecar(side, spark.createDataFrame([(0,), (1,), (2,)], "ordinal long"), "ordinal").collect()
    assert sorted(map(tuple, got)) == [(1, "given twice"), (1, "not an id"), (2, "missing"), (5, "extra")]


def test_renumber(spark):
    raw = spark.createDataFrame([(0, 10, 50, 40), (1, 11, 40, 50), (2, 12, 40, 30), (3, 13, 50, 30)], "pos long, edge_id long, start_node long, end_node long")
    nodes, edges = catalog.renumber(raw)
    assert sorted(map(tuple, nodes.collect())) == [(0, 50), (1, 40), (2, 30)]
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 1, 10), (1, 1, 2, 12), (2, 0, 2, 13)]
    rows = spark.createDataFrame([("a", [[1.0]]), ("a", [[1.0]]), ("b", [[1.0]]), ("b", [[2.0]])], "source_traj_id string, points array<array<double>>")
    one, clash = catalog.distinct_trajectories(rows)
    assert one.count() == 3 and [r["source_traj_id"] for r in clash.collect()] == ["b"]


def test_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT u32be(258) a, u64be(258) b, f64be(1.5D) c, segment_hits(0, 0, 2, 2, 1, 0, 3, 1) d, segment_hits(0, 0, 2, 2, 1, 0, 3, 0.5) e, mmr_leaf(repeat('ab', 32), 1, 2) f").first()
    leaf = hashlib.sha256(bytes.fromhex("ab" * 32) + struct.pack(">II", 1, 2)).hexdigest()
    assert tuple(r) == ("00000102", "0000000000000102", struct.pack(">d", 1.5).hex(), True, False, leaf)


def test_minutes(spark, tmp_path):
    rows = [("a", 600, 610), ("a", 615, 640), ("b", 659, 700), ("c", 1200, 1201)]
    spark.createDataFrame(rows, "tid string, start_ts long, end_ts long").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("tid string, start_ts long, end_ts long").parquet(f"{tmp_path}/in")
    query = minute_counts(source).writeStream.outputMode("update").format("memory").queryName("minute_counts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {int(r["at"]): r["n"] for r in spark.sql("SELECT unix_timestamp(window.start) at, n FROM minute_counts").collect()}
    assert got == {540: 2, 600: 2, 660: 1, 1140: 1, 1200: 1}


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "l0_root" in capsys.readouterr().out
    assert main(["prove", "/root/testdata/sf0.001", f"{tmp_path}/p", f"{tmp_path}/r"]) == 0
    root = capsys.readouterr().out.strip()
    window = ["104.0137", "30.6141", "104.0463", "30.6459", "1704844800", "1704931200"]
    assert main(["check", f"{tmp_path}/p", f"{tmp_path}/r", root, *window]) == 0
    assert len(capsys.readouterr().out.split()) == 11
    assert main(["check", f"{tmp_path}/p", f"{tmp_path}/r", "00" * 32, *window]) == 1
    assert main(["run", "no such query", "a", "b"]) == 2
