"""Trajectory catalogues: lookup of candidates, id audits, and raw road data made contiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.operators import index_sql as ix
from tessera.operators.tables import ranked
from tessera.plans.engine import evaluate

#: The columns of the catalogues' CSV files, and the order of a point's values in them.
SEGMENT_FIELDS = ("trajectory_id", "segment_count", "segments")
PLAIN_FIELDS = ("trajectory_id", "source_traj_id", "road_node_path", "points_format", "points_data")
FORMATS = {"node_lon_lat_time": {"node": 0, "lon": 1, "lat": 2, "ts": 3}, "time_lat_lon": {"ts": 0, "lat": 1, "lon": 2}}
CSV = {"header": True, "quote": '"', "escape": '"'}


def refuse(bad: DataFrame, what: str) -> None:
    """Raise if there is a row of what must not be."""
    if found := bad.first():
        raise ValueError(f"{what}: {found[0]}")


def write_segments(segments: DataFrame, path: str) -> int:
    """Write tid, seq, u, start_ts, v, end_ts as a catalogue of one CSV row a trajectory, and return their number.

    segments holds JSON lists [u, start, v, end] in order; ids must be single (tid, user or file row).
    """
    rows = segments.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("u", "start_ts", "v", "end_ts").alias("s")))).alias("all"))
    rows = rows.select(F.col("tid").alias("trajectory_id"), F.size("all").alias("segment_count"), F.to_json(F.transform("all", lambda x: x["s"])).alias("segments"))
    rows.write.csv(path, **CSV)
    return segments.sparkSession.read.csv(path, **CSV).count()


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """tid, seq, u, start_ts, v, end_ts of a catalogue; raises on repeated ids, wrong counts and ids that aren't 64 hex digits."""
    rows = spark.read.csv(path, multiLine=True, **CSV)
    if tuple(rows.columns) != SEGMENT_FIELDS:
        raise ValueError(f"a catalogue of segments has the columns {', '.join(SEGMENT_FIELDS)}")
    rows = rows.select(F.col("trajectory_id").alias("tid"), F.col("segment_count").cast("long").alias("n"), F.from_json("segments", "array<array<bigint>>").alias("s"))
    refuse(repeated(rows), "a trajectory is listed more than once")
    refuse(rows.where(~F.col("tid").rlike("^[0-9a-fA-F]{64}$")), "not an id")
    refuse(rows.where("s is null or size(s) <> n or exists(s, x -> size(x) <> 4)"), "segments differ from their count")
    return rows.select("tid", F.posexplode("s").alias("seq", "x")).selectExpr("tid", "cast(seq as bigint) seq", "x[0] u", "x[1] start_ts", "x[2] v", "x[3] end_ts")


def write_plain(records: DataFrame, path: str) -> None:
    """Write tid, source_traj_id, node_path, points_format, points as a plaintext catalogue (CSV)."""
    refuse(repeated(records), "a trajectory is listed more than once")
    rows = records.select(F.col("tid").alias(PLAIN_FIELDS[0]), PLAIN_FIELDS[1], F.to_json("node_path").alias(PLAIN_FIELDS[2]), PLAIN_FIELDS[3], F.to_json("points").alias(PLAIN_FIELDS[4]))
    rows.write.csv(path, **CSV)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """tid, source_traj_id, node_path, points_format, points of a plaintext catalogue; absent columns have defaults."""
    rows = spark.read.csv(path, multiLine=True, **CSV)
    if missing := {PLAIN_FIELDS[0], PLAIN_FIELDS[4]} - set(rows.columns):
        raise ValueError(f"a plaintext catalogue lacks {', '.join(sorted(missing))}")
    text = lambda c: F.trim(F.coalesce(F.col(c) if c in rows.columns else F.lit(None).cast("string"), F.lit("")))
    out = rows.select(text(PLAIN_FIELDS[0]).alias("tid"), text(PLAIN_FIELDS[1]).alias("source_traj_id"), F.coalesce(F.from_json(text(PLAIN_FIELDS[2]), "array<bigint>"), F.array().cast("array<bigint>")).alias("node_path"), F.coalesce(F.nullif(text(PLAIN_FIELDS[3]), F.lit("")), F.lit("node_lon_lat_time")).alias("points_format"), F.from_json(PLAIN_FIELDS[4], "array<array<double>>").alias("points"))
    refuse(repeated(out), "a trajectory is listed more than once")
    refuse(out.where("points is null"), "points that can't be read")
    return out


def plain_points(records: DataFrame) -> DataFrame:
    """tid, point_id (from 0), ts, lon, lat of plaintext records, by their format; raises on unknown formats."""
    refuse(records.where(~F.col("points_format").isin(*FORMATS)).select("points_format"), "an unknown format of points")
    p = records.select("tid", "points_format", F.posexplode("points").alias("point_id", "p"))
    at = lambda c: F.coalesce(*[F.when(F.col("points_format") == f, F.get("p", F.lit(own[c]))) for f, own in FORMATS.items()]).alias(c)
    return p.select("tid", F.col("point_id").cast("long"), at("ts"), at("lon"), at("lat"))


def effective_paths(records: DataFrame) -> DataFrame:
    """records with node_path, from the points' nodes where it is empty, first_ts and last_ts."""
    node, ts = ({f: own.get(c) for f, own in FORMATS.items()} for c in ("node", "ts"))
    of_points = F.coalesce(*[F.when(F.col("points_format") == f, F.expr(f"transform(points, p -> cast(p[{k}] as bigint))")) for f, k in node.items() if k is not None])
    end = lambda i: F.coalesce(*[F.when(F.col("points_format") == f, F.element_at("points", i)[k]) for f, k in ts.items()]).cast("long")
    path = F.when(F.size("node_path") > 0, F.col("node_path")).otherwise(F.coalesce(of_points, F.col("node_path")))
    return records.withColumn("node_path", path).withColumn("first_ts", end(1)).withColumn("last_ts", end(-1))


def wrong_ids(records: DataFrame) -> DataFrame:
    """tid, found of records whose id isn't the hash of their nodes, first and last time."""
    nodes = f"array_join(transform(node_path, n -> {d.u32('n')}), '')"
    own = effective_paths(records).withColumn("found", F.expr(d.sha(nodes, d.u32("first_ts"), d.u32("last_ts"))))
    return own.where("lower(tid) <> found").select("tid", "found")


def plaintext_stage(records: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id, tid of the exact answers among candidates (query_id, tid), from their plaintext.

    Looks the candidates up, verifies that each is there and that its id is that of its nodes and
    times, and filters by the path between its points; raises where plaintext and candidates don't agree.
    """
    found, missing = lookup(records, candidates)
    refuse(missing, "the catalogue lacks a candidate")
    refuse(wrong_ids(found), "a trajectory's id isn't that of its plaintext")
    spark = records.sparkSession
    given = {"points": plain_points(found), "windows": windows.select("query_id", "min_lon", "min_lat", "max_lon", "max_lat", "q_start", "q_end"), "asked": candidates.select("query_id", "tid").distinct()}
    return evaluate(spark, [*((n, "") for n in given), *ix.fine_points(d, "asked")], "SELECT query_id, tid FROM exact_points", given=given)


def lookup(catalog: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the candidates, and the candidates that the catalogue lacks; by tid."""
    asked = candidates.select("tid").distinct()
    return catalog.join(asked, "tid", "left_semi"), asked.join(catalog, "tid", "left_anti")


def repeated(catalog: DataFrame) -> DataFrame:
    """tid and n of trajectories that a catalogue lists more than once."""
    return catalog.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1")


def audit_ids(segments: DataFrame) -> DataFrame:
    """tid, found: catalogue rows whose id isn't the hash of their edges, first start and last end.

    segments: tid, seq, eid, start_ts, end_ts.
    """
    own = segments.groupBy("tid").agg(F.expr(d.sha(d.ordered(d.u32("eid"), "seq"), d.u32("min(start_ts)"), d.u32("max(end_ts)"))).alias("found"))
    return own.where("tid <> found")


def audit_sidecar(sidecar: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, problem: missing in or extra to the sidecar, given twice, or no 64-digit hex id."""
    twice = sidecar.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("given twice").alias("problem"))
    wrong = sidecar.where(~F.coalesce(F.col("trajectory_id").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))).select(key, F.lit("not an id").alias("problem"))
    both = sidecar.select(key, F.lit(1).alias("a")).distinct().join(rows.select(key, F.lit(1).alias("b")).distinct(), key, "full_outer")
    apart = both.where("a is null or b is null").select(key, F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("problem"))
    return apart.unionByName(twice).unionByName(wrong)


def renumber(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id from 0, original) and edges (eid from 0, u, v, original) of raw directed edges.

    edges: pos, edge_id, start_node, end_node. Nodes are numbered as they first appear, the start
    before the end; of edges between the same nodes in either direction the first stays.
    """
    ends = edges.select(F.explode(F.array(F.struct((2 * F.col("pos")).alias("at"), F.col("start_node").alias("original")), F.struct((2 * F.col("pos") + 1).alias("at"), F.col("end_node").alias("original")))).alias("e")).select("e.*")
    nodes = ranked(ends.groupBy("original").agg(F.min("at").alias("at")), ["at"], "node_id", label="nodes").select("node_id", "original")
    side = lambda c: nodes.select(F.col("original").alias(c), F.col("node_id").alias(c[0]))
    pair = F.least("start_node", "end_node").alias("low"), F.greatest("start_node", "end_node").alias("high")
    first = edges.groupBy(*pair).agg(F.min(F.struct("pos", "edge_id", "start_node", "end_node")).alias("e")).select("e.*")
    numbered = ranked(first, ["pos"], "eid", label="edges")
    out = numbered.join(side("start_node").withColumnRenamed("s", "u"), "start_node").join(side("end_node").withColumnRenamed("e", "v"), "end_node")
    return nodes, out.select("eid", "u", "v", F.col("edge_id").alias("original"))


def path_problems(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """source_traj_id, u, v of neighbours on a path (source_traj_id, seq, node_id) that no edge (u, v) joins."""
    nxt = F.lead("node_id").over(Window.partitionBy("source_traj_id").orderBy("seq"))
    moves = paths.select("source_traj_id", F.col("node_id").alias("u"), nxt.alias("v")).where("v is not null and u <> v")
    known = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return moves.join(known, (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b")), "left_anti").distinct()


def without_last_column(spark: SparkSession, path: str) -> DataFrame:
    """value: lines of a text of columns set apart by white space, each but for its last."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.array_join(F.slice(fields, F.lit(1), F.greatest(F.size(fields) - 1, F.lit(0))), " ").alias("value"))


def running_points(records: DataFrame) -> DataFrame:
    """point_id over all records in their order (ordinal, pos), tid and the rest."""
    return ranked(records, ["ordinal", "pos"], "point_id", label="points").drop("ordinal", "pos")


def ids_in_order(points: DataFrame) -> DataFrame:
    """tid and place of trajectories in the order of their first point."""
    return ranked(points.groupBy("tid").agg(F.min("point_id").alias("first")), ["first"], "place", label="ids").select("tid", "place")


def distinct_trajectories(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each source_traj_id and points, and the ids given with differing points."""
    digest = rows.withColumn("digest", F.sha2(F.to_json("points"), 256))
    one = digest.dropDuplicates(["source_traj_id", "digest"])
    clash = one.groupBy("source_traj_id").agg(F.count("*").alias("n")).where("n > 1")
    return one.drop("digest"), clash
