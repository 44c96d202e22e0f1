"""Readers of all accepted shapes and their rejects, catalogues, indexes on disk, settings and matrices."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tessera import config, experiments
from tessera.operators import index_store, list_proofs, proofs
from tessera.plans import authenticated as auth
from tessera.plans.engine import statement
from tessera.functions.dialect import Spark
from tessera.plans.world import MAIN, world
from tessera.sources import catalog, road, trajectories

SF = "/root/testdata/sf0.001"
ONE = [[0, 1, 5], [[0, 1], [1, 5]], [[[100, 2, 1], [110, 2, 1]], [[112, 3, 2], [120, 4, 3]]], 0]


def test_elements():
    read = lambda *pieces: list(trajectories.elements(iter(pieces)))
    assert read("[[1,", "2], {\"a\": \"]\"} ", ",\n3]") == [("[1,2]", None), ('{"a": "]"}', None), ("3", None)]
    assert read("[[1]]]] \n") == [("[1]", None)]
    assert read("[[1]] x")[-1] == (None, "text after the list")
    assert read("[[1], [2")[-1] == (None, "the list is cut short")
    assert read("['a', (1, 2)]")[-1][1] == "the list is cut short" and read("[('a', 1)]") == [("('a', 1)", None)]
    assert read('{"data": [[1], [2]]}') == [("[1]", None), ("[2]", None)] and read('{"x": 1}') == [('{"x": 1}', None)]
    assert read("nothing")[0][0] is None and read("") == [] and read("[]") == []


def test_city_files(spark, tmp_path):
    (tmp_path / "t-20161001123456789-2.json").write_text(json.dumps([ONE, [[1], [], []], "x"]))
    (tmp_path / "t-20161001123456788-10.json").write_text(json.dumps({"trajectories": [{"node_path": [4, 5], "points": [[4, 104.0, 30.0, 7], [5, 104.5, 30.5, 9]]}, {"trajectory": ONE}]}))
    (tmp_path / "t-9.jsonl").write_text(json.dumps(ONE) + "\n\n" + str(tuple(ONE)) + "\n{broken\n")
    (tmp_path / "t-10.json").write_text("[[1, 2")
    rows = trajectories.read_city(spark, "Xian", str(tmp_path)).persist()
    found = {(r["file"], r["ordinal"]): r for r in rows.collect()}
    assert sorted((f, o) for (f, o), r in found.items() if r["problem"] is None) == [("t-20161001123456788-10.json", 0), ("t-20161001123456788-10.json", 1), ("t-20161001123456789-2.json", 0), ("t-9.jsonl", 0), ("t-9.jsonl", 1)]
    assert found["t-20161001123456788-10.json", 0]["groups"] == [[[7.0, 30.0, 104.0], [9.0, 30.5, 104.5]]]
    assert found["t-9.jsonl", 1]["node_path"] == [0, 1, 5]
    assert {(r["file"], r["problem"]) for r in trajectories.problems(rows).collect()} >= {("t-10.json", "the list is cut short"), ("t-20161001123456789-2.json", "no points")}
    files = [r[0] for r in rows.select("file", "file_key").distinct().orderBy("file_key").collect()]
    assert files == ["t-9.jsonl", "t-10.json", "t-20161001123456788-10.json", "t-20161001123456789-2.json"]
    assert {r["file"]: r["n"] for r in trajectories.count_elements(spark, str(tmp_path)).collect()} == {"t-9.jsonl": 3, "t-20161001123456788-10.json": 2, "t-20161001123456789-2.json": 3}
    assert trajectories.city_points(rows).count() == 4 * 4 + 2
    assert [(r["file"], r["ordinal"]) for r in trajectories.ordinal_slice(rows.where("problem is null"), 1, 3).collect()] == [("t-9.jsonl", 1), ("t-20161001123456788-10.json", 0)]
    with pytest.raises(ValueError):
        trajectories.read_city_json(spark, str(tmp_path), refuse=True)
    with pytest.raises(ValueError):
        trajectories.read_city(spark, "nowhere", str(tmp_path))
    times = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 4.0), ("b", 0, 1.0), ("b", 1, 1.0)], "tid string, pos int, ts double")
    assert [r["tid"] for r in trajectories.unordered(times).collect()] == ["a"]


def test_points_csv(spark, tmp_path):
    lines = ["source_traj_id,points_data", 'a,"[[1,116,39,100],[1,116,39,105],[2,117,40,110]]"', 'b,"[[1,1,1,1]]"', 'c,"[[1,1,1,9],[2,1,1,8]]"', 'd,"oops"', ',"[[1,1,1,1]]"', 'e,"[[1,1,1]]"', 'f,"[(1, 1, 1, 1), (1, 1, 1, 2)]"', 'g,"[[1,1,1,1]]"', 'g,"[[1,1,1,1]]"']
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    rows = trajectories.read_city(spark, "beijing", str(tmp_path / "p.csv"))
    got = {r["source_traj_id"]: r["problem"] for r in rows.collect()}
    assert got == {"a": None, "b": None, "c": "times decrease", "d": "points that can't be read", None: "no id", "e": "a point lacks a value", "f": None, "g": "an id given twice"}
    assert tuple(trajectories.csv_counters(rows).first()) == (3, 1, 1, 2, 1, 1, 110)
    assert trajectories.csv_segments(rows).count() == 1
    (tmp_path / "q.csv").write_text("id,points\n1,2\n")
    with pytest.raises(ValueError, match="needs source_traj_id"):
        trajectories.read_points_csv(spark, str(tmp_path / "q.csv"))


def test_parallel_edges(spark, tmp_path):
    (tmp_path / "n.txt").write_text("0 1.0 2.0\n1 1.5 2.5\n")
    (tmp_path / "e.txt").write_text("0 0 1\n3 1 0\n")
    nodes = road.read_nodes(spark, str(tmp_path / "n.txt"))
    with pytest.raises(ValueError, match="parallel"):
        road.read_edges(spark, str(tmp_path / "e.txt"), nodes)
    edges = road.read_edges(spark, str(tmp_path / "e.txt"), nodes, parallel="all")
    assert sorted(r["eid"] for r in edges.collect()) == [0, 3]
    asked = spark.createDataFrame([(1, 0), (0, 7)], "u long, v long")
    assert {(r["u"], r["v"]): r["eid"] for r in road.find_edges(edges, asked).collect()} == {(1, 0): 0, (0, 7): None}
    (tmp_path / "f.txt").write_text("0 0 9\n")
    with pytest.raises(ValueError, match="without node"):
        road.read_edges(spark, str(tmp_path / "f.txt"), nodes, parallel="all")
    paths = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 9)], "source_traj_id string, seq int, node_id long")
    assert [(r["u"], r["v"]) for r in catalog.path_problems(paths, edges).collect()] == [(1, 9)]
    (tmp_path / "l.txt").write_text("a b  c\n\nd e f\n")
    assert [r[0] for r in catalog.without_last_column(spark, str(tmp_path / "l.txt")).collect()] == ["a b", "d e"]


def tid(nodes, first, last):
    return hashlib.sha256(struct.pack(f">{len(nodes) + 2}I", *nodes, first, last)).hexdigest()


def test_catalogues(spark, tmp_path):
    ids = [tid([1, 2], 100, 140), tid([7], 5, 9)]
    segments = spark.createDataFrame([(ids[0], 0, 1, 100, 2, 120), (ids[0], 1, 2, 120, 3, 140), (ids[1], 0, 7, 5, 8, 9)], "tid string, seq long, u long, start_ts long, v long, end_ts long")
    assert catalog.write_segments(segments, f"{tmp_path}/s") == 2
    assert sorted(map(tuple, catalog.read_segments(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, segments.collect()))
    text = spark.read.text(f"{tmp_path}/s").where("value like '%,2,%'")
    text.unionByName(text).unionByName(spark.createDataFrame([("trajectory_id,segment_count,segments",)], "value string")).coalesce(1).orderBy(F.desc("value")).write.text(f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="more than once"):
        catalog.read_segments(spark, f"{tmp_path}/twice")
    records = spark.createDataFrame([(ids[0], "a", [1, 2], "time_lat_lon", [[100.0, 30.0, 104.0], [140.0, 30.2, 104.2]]), (tid([4, 5], 1, 3), "b", [], "node_lon_lat_time", [[4.0, 104.0, 30.0, 1.0], [5.0, 104.1, 30.1, 3.0]])], "tid string, source_traj_id string, node_path array<bigint>, points_format string, points array<array<double>>")
    catalog.write_plain(records, f"{tmp_path}/p")
    back = catalog.read_plain(spark, f"{tmp_path}/p").persist()
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))
    assert catalog.wrong_ids(back).count() == 0
    window = spark.createDataFrame([("w", 104.05, 30.05, 104.15, 30.15, 90, 130), ("x", 0.0, 0.0, 1.0, 1.0, 0, 1000)], "query_id string, min_lon double, min_lat double, max_lon double, max_lat double, q_start long, q_end long")
    asked = spark.createDataFrame([("w", ids[0]), ("x", ids[0])], "query_id string, tid string")
    assert [tuple(r) for r in catalog.plaintext_stage(back, asked, window).collect()] == [("w", ids[0])]
    with pytest.raises(ValueError, match="lacks"):
        catalog.plaintext_stage(back, spark.createDataFrame([("w", "ab" * 32)], "query_id string, tid string"), window)
    forged = back.withColumn("points", F.expr("transform(points, p -> transform(p, x -> x + 1))"))
    with pytest.raises(ValueError, match="id isn't"):
        catalog.plaintext_stage(forged, asked, window)


def clipped(points, lo, hi):
    """The path between points within a time, in plain Python."""
    if len(points) == 1:
        return points if lo <= points[0][0] <= hi else []
    out = []
    for a, b in zip(points, points[1:], strict=False):
        if b[0] < lo or a[0] > hi:
            continue
        for t, own in ((max(lo, a[0]), a), (min(hi, b[0]), b)):
            r = 0 if a[0] == b[0] else (t - a[0]) / (b[0] - a[0])
            p = own if t == own[0] else (t, *(x + (y - x) * r for x, y in zip(a[1:], b[1:], strict=True)))
            if not out or out[-1] != p:
                out.append(p)
    return out


def test_exact_answers_over_points(spark):
    """Against a sampling of each path: what is inside for sure is found, what stays away by far isn't."""
    by: dict = {}
    for r in statement(spark, SF, world(Spark), "SELECT tid, point_id, ts, lon, lat FROM points").orderBy("tid", "ts", "point_id").collect():
        by.setdefault(r["tid"], []).append((float(r["ts"]), r["lon"], r["lat"]))
    window = spark.sql(MAIN).first()
    box = window[1:5]
    from tessera.operators import index_sql as ix
    from tessera.plans.queries import pointwise

    found = {r["tid"] for r in statement(spark, SF, [(n, MAIN if n == "windows" else s) for n, s in pointwise(Spark, "three_way")], "SELECT tid FROM exact_points").collect()}
    sure, near = set(), set()
    for t, points in by.items():
        path = clipped(points, window["q_start"], window["q_end"])
        samples = [tuple(x + (y - x) * k / 500 for x, y in zip(a[1:], b[1:], strict=True)) for a, b in zip(path, path[1:], strict=False) for k in range(501)] or [p[1:] for p in path]
        if any(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in samples):
            sure.add(t)
        if any(box[0] - 1e-3 <= x <= box[2] + 1e-3 and box[1] - 1e-3 <= y <= box[3] + 1e-3 for x, y in samples):
            near.add(t)
    coarse = {r["tid"] for r in statement(spark, SF, [*world(Spark), ("windows", MAIN), *ix.point_candidates()], "SELECT tid FROM three_way").collect()}
    assert sure & coarse <= found <= near & coarse and found


def test_index_on_disk(spark, tmp_path):
    tables = {"a": spark.range(10).toDF("x"), "b": spark.range(3).toDF("y")}
    manifest = index_store.save(tables, f"{tmp_path}/i", "ab" * 32, theta=8)
    plan = index_store.plan_update(manifest)
    loaded, found = index_store.load(spark, f"{tmp_path}/i")
    assert found == manifest and loaded["a"].count() == 10 and index_store.disk_bytes(spark, f"{tmp_path}/i") > 0
    index_store.check_plan(spark, f"{tmp_path}/i", plan)
    spark.range(11).toDF("x").write.mode("overwrite").parquet(f"{tmp_path}/i/a")
    with pytest.raises(index_store.StaleIndex, match="table a"):
        index_store.load(spark, f"{tmp_path}/i")
    index_store.save(tables, f"{tmp_path}/i", "cd" * 32)
    with pytest.raises(index_store.StaleIndex, match="changed"):
        index_store.check_plan(spark, f"{tmp_path}/i", plan)
    (tmp_path / "i/.manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "i/manifest.json").write_text((tmp_path / "i/manifest.json").read_text().replace("cdcd", "cece"))
    with pytest.raises(index_store.StaleIndex, match="digest"):
        index_store.manifest_of(spark, f"{tmp_path}/i")
    with pytest.raises(index_store.StaleIndex):
        index_store.manifest_of(spark, f"{tmp_path}/none")


def test_verifiers_refuse(spark):
    """Each check that the reference formats ask for, by a token that breaks only it."""
    box = (0.0, 0.0, 1.0, 1.0)
    take = lambda check, *args: check.take(*args)
    bad = {
        "before its start": lambda: take(proofs.Verifier(box, 5, 4), proofs.MMR_PRUNED, struct.pack(">32sII", bytes(32), 1, 2)),
        "a part ends": lambda: take(proofs.Verifier(box, 5, 9), proofs.MMR_PRUNED, struct.pack(">32sII", bytes(32), 4, 2)),
        "a result ends": lambda: take(proofs.Verifier(box, 5, 9), proofs.RESULT_SLOT, b"", (1, bytes(32), 8, 7)),
        "an edge ends": lambda: take(proofs.Verifier(box, 5, 9), proofs.EDGE_OPAQUE, struct.pack(">IddddIII32s", 1, 5, 5, 6, 6, 2, 9, 3, bytes(32))),
        "corners reversed": lambda: take(list_proofs.Verifier(box, 5, 9), list_proofs.PRUNED_LEAF, struct.pack(">ddddI32s", 9, 9, 8, 9, 0, bytes(32)), None),
        "opened in vain": lambda: take(list_proofs.Verifier(box, 5, 9), list_proofs.LEAF, struct.pack(">ddddI", 8, 8, 9, 9, 0), None),
        "the query ends": lambda: take(list_proofs.Verifier(box, 9, 5), list_proofs.LEAF, struct.pack(">ddddI", 0, 0, 9, 9, 0), None),
    }
    for why, work in bad.items():
        with pytest.raises(proofs.Rejected, match=why):
            work()
    take(proofs.Verifier((1.0, 1.0, 0.0, 0.0), 5, 9), proofs.NODE_PRUNED, struct.pack(">32sddddII", bytes(32), 2, 2, 3, 3, 6, 7))
    with pytest.raises(proofs.Rejected, match="pruned node"):
        take(proofs.Verifier((1.0, 1.0, 0.0, 0.0), 5, 9), proofs.NODE_PRUNED, struct.pack(">32sddddII", bytes(32), 0, 0, 3, 3, 6, 7))
    report = spark.createDataFrame([("a", True, None), ("b", True, None), ("c", False, "the root differs")], "query_id string, accepted boolean, reason string")
    own = spark.createDataFrame([("a", "x"), ("b", "x")], "query_id string, tid string")
    got = {r["query_id"]: tuple(r)[1:] for r in proofs.with_claims(report, own, own.where("query_id = 'a'")).collect()}
    assert got == {"a": (True, None), "b": (False, "the claimed candidates differ"), "c": (False, "the root differs")}


def test_settings_and_matrices(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"data": "d", "out": "../o", "theta": 8, "paths": {"x": "/y"}}))
    own = config.Settings.load(str(tmp_path / "s.json"))
    assert (own.data, own.theta, own.paths["x"]) == (f"{tmp_path}/d", 8, "/y") and own.out == f"{tmp_path.parent}/o"
    (tmp_path / "t.json").write_text('{"thta": 8}')
    with pytest.raises(ValueError, match="thta"):
        config.Settings.load(str(tmp_path / "t.json"))
    cells = spark.createDataFrame([("1h", 1, 0.5), ("1h", 2, 0.25), ("4h", 1, 2.0)], "label string, side long, t double")
    config.write_matrix(cells, f"{tmp_path}/m", "t", [1, 2])
    back = config.read_matrix(spark, f"{tmp_path}/m", "t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    other = cells.withColumn("t", F.expr("if(label = '1h' and side = 2, t + 1, t + 1e-12)"))
    assert [tuple(r)[:2] for r in config.reconcile(cells, other, "t").collect()] == [("1h", 2)]
    (tmp_path / "c.csv").write_text("center_lon,center_lat\n104.0,30.5\n")
    assert tuple(config.read_setup(spark, str(tmp_path / "c.csv"), 7).first()) == (104.0, 30.5, 7)
    ids = spark.createDataFrame([("q", "b"), ("q", "a")], "query_id string, tid string")
    answer = json.loads(config.response(ids, spark.createDataFrame([("q", 3)], "query_id string, n long")).first()["answer"])
    assert answer == {"candidate_ids": ["a", "b"], "candidate_count": 2, "stats": {"n": 3}}
    assert config.demo(spark).groupBy("tid").count().count() == 20
    assert [r["n_trajectories"] for r in experiments.totals(spark, SF).orderBy("pct").collect()] == [3, 6, 9, 12, 15]
    assert auth.edge_partition_problems(spark, SF).count() == 0


def test_runners_over_point_trees(spark, tmp_path):
    windows = f"SELECT CAST(1 AS BIGINT) AS side, CAST(86400 AS BIGINT) AS span, * FROM ({MAIN}) m"
    for engine in ("keys", "boxes"):
        row = experiments.cross_range(spark, SF, f"{tmp_path}/{engine}", engine, windows=windows)[0]
        assert row["final_trajectory_count"] <= row["candidate_trajectory_count"] and row["vo_size_bytes"] > 0
    grown = experiments.point_update(spark, SF, str(tmp_path))
    assert len({r["before"] for r in grown}) == 1 and all(r["root"] != r["before"] for r in grown)
    shares = experiments.point_scaling(spark, SF, str(tmp_path))
    assert [r["n_trajectories"] for r in shares] == [3, 6, 9, 12, 15] and len({r["boxes_root"] for r in shares}) == 5
