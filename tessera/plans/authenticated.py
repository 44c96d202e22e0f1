"""Registered queries over the spatial trees: recursion-shaped, so held against models in tests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.operators import chains, inserts, list_proofs, packed_proofs, proofs, road_tree, spatial_tree
from tessera.operators import index_sql as ix
from tessera.operators.mmr import mmr_nodes, numbered
from tessera.operators.tables import ranked, stored
from tessera.plans import tree_oracles
from tessera.plans.engine import evaluate, statement
from tessera.plans.queries import ORACLE as PLAIN
from tessera.plans.queries import CAP, FANOUT, RANKED, points, updated
from tessera.plans.world import MAIN, matrix, world

THETA = 8  # nodes of a leaf; the road networks here have 100


class Road:
    """The relations of a session's events that the trees are built from."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, body: str, more: tuple = ()) -> DataFrame:
        return statement(self.spark, self.sf_dir, [*world(d), *more], body)

    @property
    def nodes(self) -> DataFrame:
        return self.sql("SELECT node_id, lon, lat FROM nodes")

    @property
    def edges(self) -> DataFrame:
        return self.sql("SELECT eid, a AS u, b AS v, alon AS ulon, alat AS ulat, blon AS vlon, blat AS vlat FROM edges")

    def entries(self) -> DataFrame:
        return stored(self.sql("SELECT eid, tid, start_ts, end_ts FROM entries"), "entries")


def mmr_roots(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """eid, k, root, lo, hi from the nodes of the edges' MMRs."""
    ctes = [(n, "SELECT eid, count(*) AS k FROM mmr WHERE h = 0 GROUP BY eid" if n == "mmr_k" else sql) for n, sql in ix.mmr(d, 0)]
    return evaluate(spark, ctes, "SELECT eid, k, root, lo, hi FROM roots", given={"mmr": nodes})


def main_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tree nodes, edge records, MMR nodes and numbered entries."""
    road = Road(spark, sf_dir)
    entries = road.entries()
    mmr = stored(mmr_nodes(entries), "mmr")
    tree, records = spatial_tree.sem_tree(road.nodes, road.edges, mmr_roots(spark, mmr), THETA)
    return tree, records, mmr, numbered(entries)


def sem_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_tree(spark, sf_dir)[0]


def sem_leaf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_tree(spark, sf_dir)[1].select("eid", "path", "record")


def l0_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_tree(spark, sf_dir)[0].where("path = ''").select(F.col("hash").alias("root"))


def sem_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind, and how many edges their leaves hold."""
    own = F.when(F.col("leaf"), F.col("n_edges"))
    return main_tree(spark, sf_dir)[0].groupBy("origin").agg(F.count("*").alias("n"), F.min(own).alias("min_edges"), F.max(own).alias("max_edges"), F.avg(own).alias("avg_edges"), F.count_if(own > 0).alias("n_filled"))


def vo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.proof_tokens(*main_tree(spark, sf_dir), spark.sql(MAIN))


def vo_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the main window's proof by kind."""
    return vo_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))


def edge_partition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that aren't in exactly one leaf of the main tree."""
    return spatial_tree.partition_problems(*main_tree(spark, sf_dir)[:2], Road(spark, sf_dir).edges)


def vo_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.sizes(proofs.proof_tokens(*main_tree(spark, sf_dir), spark.sql(matrix(d))))


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of the 30 windows of the matrix, verified against the tree's root."""
    built, windows = main_tree(spark, sf_dir), spark.sql(matrix(d))
    root = built[0].where("path = ''").first()["hash"]
    return proofs.verify_report(proofs.proof_tokens(*built, windows), windows, root)


def verified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the main window as its proof discloses them."""
    return vo_tokens(spark, sf_dir).where("tid is not null").select("tid").distinct()


def list_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Binary tree, placed edges, ranked entries, suffix states and the road."""
    road = Road(spark, sf_dir)
    entries = stored(road.sql("SELECT eid, tid, rank, total, start_ts, end_ts FROM ranked", (("ranked", RANKED),)), "ranked")
    states = stored(chains.list_states(entries), "chain")
    heads = states.where("pos = 0").select("eid", F.col("state").alias("root"))
    counts = entries.groupBy("eid").agg(F.count("*").alias("k"), F.count_distinct("tid").alias("weight"))
    edges = road.edges.join(counts.select("eid", "weight"), "eid", "left").fillna(0, ["weight"])
    tree, placed = spatial_tree.binary_tree(road.nodes, edges, heads.join(counts.select("eid", "k"), "eid"), THETA)
    return tree, placed, entries, states, road.edges


def binary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_tree(spark, sf_dir)[0]


def list_vo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_proofs.proof_tokens(*list_tree(spark, sf_dir), spark.sql(MAIN))


def query_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the main window's query over the sorted lists visits, prunes, checks and scans."""
    tokens = list_vo_tokens(spark, sf_dir)
    is_ = lambda *kinds: F.count_if(F.col("token").isin(*kinds))
    nodes = (list_proofs.PRUNED_LEAF, list_proofs.PRUNED_INTERNAL), (list_proofs.LEAF, list_proofs.INTERNAL)
    more = F.when(F.col("token") == list_proofs.EDGE_PREFIX, F.conv(F.substring("body", 25, 2), 16, 10).cast("long"))
    return tokens.groupBy("query_id").agg(is_(*nodes[0], *nodes[1]).alias("n_visited"), is_(*nodes[0]).alias("n_pruned"), is_(list_proofs.EDGE_OPAQUE, list_proofs.EDGE_PREFIX).alias("n_checked"), is_(list_proofs.EDGE_PREFIX).alias("n_opened"), is_(list_proofs.ENTRY).alias("n_scanned"), F.sum(more).alias("n_boundary"), F.count("tid").alias("n_matched"))


def list_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the main window as the proof over sorted lists discloses them."""
    return list_vo_tokens(spark, sf_dir).where("tid is not null").select("tid").distinct()


def list_verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, windows = list_tree(spark, sf_dir), spark.sql(matrix(d))
    root = built[0].where("path = ''").first()["hash"]
    return list_proofs.verify_report(list_proofs.proof_tokens(*built, windows), built[4], windows, root)


def binary_tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_tree(spark, sf_dir).where("path = ''").select(F.col("hash").alias("root"))


def box_index(spark: SparkSession, sf_dir: str, cap: int = CAP, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, str]:
    """Nodes and records of the R-tree, and its root."""
    sql = lambda body: stored(statement(spark, sf_dir, points(d, cap, fanout), body), "rtree")
    corners = [d.little(d.f64(c)) for c in ("x0", "y0", "x1", "y1")]
    nodes = sql(f"SELECT h, idx, hash, concat({', '.join(corners)}) AS bounds, array(x0, y0) AS lows, array(x1, y1) AS highs FROM rt_nodes")
    root = nodes.orderBy(F.desc("h")).selectExpr(f"{d.sha(d.text_hex('R'), 'bounds', 'hash')} AS root").first()
    return nodes, sql("SELECT idx, r, record, tid FROM rt_records"), root["root"] if root else ""


def box_ranges(windows: DataFrame) -> DataFrame:
    return proofs.normalized(windows).selectExpr("query_id", "array(min_lon, min_lat) AS lows", "array(max_lon, max_lat) AS highs")


def box_proofs(spark: SparkSession, sf_dir: str, windows: str, cap: int = CAP, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, str]:
    """R-tree proof tokens of windows, these as ranges, and the trusted root."""
    nodes, records, root = box_index(spark, sf_dir, cap, fanout)
    asked = box_ranges(spark.sql(windows))
    return packed_proofs.tokens(nodes, records, fanout, asked, (4, 2)), asked, root


KEYS = {"lon": ("min_lon", "max_lon"), "lat": ("min_lat", "max_lat"), "ts": ("q_start", "q_end")}


def key_index(spark: SparkSession, sf_dir: str, cap: int = CAP, fanout: int = FANOUT) -> tuple[dict[str, tuple[DataFrame, DataFrame]], str]:
    """Nodes and records of the B-trees by dimension, and the root over all three."""
    trees, roots = {}, []
    for key in KEYS:
        sql = lambda body: stored(statement(spark, sf_dir, points(d, cap, fanout), body), "btree")
        nodes = sql(f"SELECT h, idx, hash, concat({d.f64('lo')}, {d.f64('hi')}) AS bounds, array(lo) AS lows, array(hi) AS highs FROM {key}_nodes")
        top = nodes.orderBy(F.desc("h")).first()
        roots.append(top["hash"] if top else packed_proofs.EMPTY_ROOT)
        trees[key] = nodes, sql(f"SELECT idx, r, record, tid FROM {key}_records")
    return trees, hashlib.sha256(b"THREE-MBT-ROOT-v1" + b"".join(map(bytes.fromhex, roots))).hexdigest()


def key_ranges(windows: DataFrame) -> dict[str, DataFrame]:
    own = proofs.normalized(windows)
    return {key: own.selectExpr("query_id", f"array(CAST({low} AS DOUBLE)) AS lows", f"array(CAST({high} AS DOUBLE)) AS highs") for key, (low, high) in KEYS.items()}


def key_proofs(spark: SparkSession, sf_dir: str, windows: str, cap: int = CAP, fanout: int = FANOUT) -> tuple[dict, dict, str]:
    """B-tree proof tokens by dimension, the windows as ranges, and the trusted root."""
    trees, root = key_index(spark, sf_dir, cap, fanout)
    asked = key_ranges(spark.sql(windows))
    return {key: packed_proofs.tokens(*trees[key], fanout, asked[key], (8, 8)) for key in KEYS}, asked, root


def rtree_verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_proofs.verify_boxes(*box_proofs(spark, sf_dir, matrix(d)))


def btree_verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_proofs.verify_keys(*key_proofs(spark, sf_dir, matrix(d)))


def rtree_disclosed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of disclosed points within the main window, time included."""
    proof, _, _ = box_proofs(spark, sf_dir, MAIN)
    shown = proof.where("tid is not null").select("query_id", F.expr("cast(conv(regexp_replace(reverse(substr(body, 1, 16)), '(.)(.)', '$2$1'), 16, 10) as bigint)").alias("point_id"), "tid")
    own = statement(spark, sf_dir, points(d), "SELECT point_id, lon, lat, ts FROM points")
    return shown.join(own, "point_id").join(spark.sql(MAIN), "query_id").where("lon between min_lon and max_lon and lat between min_lat and max_lat and ts between q_start and q_end").select("tid").distinct()


def insert_points(spark: SparkSession, sf_dir: str, key: str, cap: int = CAP) -> DataFrame:
    """Rows of a point tree with their leaves after the base's 60 % of trajectories took in the rest.

    key: lon, lat or ts for a B-tree, morton for the R-tree; grid bounds are those of all points.
    """
    order = [key, "point_id"] if key == "morton" else [key, "point_id", "tid"]
    own = "point_id, tid, ts, lon, lat, morton FROM keyed" if key == "morton" else f"point_id, tid, {key}, {d.f64(f'CAST({key} AS DOUBLE)')} AS kx FROM points"
    both = [*points(d), *[c for c in updated(d) if c[0] in ("cutoff", "user_rank", "ordinal")]]
    base = "(SELECT tid FROM ids JOIN ordinal USING (user_id) CROSS JOIN cutoff WHERE o <= n_base)"
    rows = stored(statement(spark, sf_dir, both, f"SELECT p.*, b.tid IS NOT NULL AS old FROM (SELECT {own}) p LEFT JOIN {base} b ON b.tid = p.tid"), "points")
    old, new = rows.where("old").drop("old"), rows.where("NOT old").drop("old")
    packed = ranked(old, order, label="pack").withColumn("idx", F.expr(f"r div {cap}")).withColumn("r", F.expr(f"r % {cap}"))
    return inserts.insert(packed, new, key, order, cap, last_of_equal=key != "morton")


def btree_insert_root(spark: SparkSession, sf_dir: str, cap: int = CAP, fanout: int = FANOUT) -> DataFrame:
    """Aggregated root of the three B-trees after the insert."""
    roots = []
    for key in ("lon", "lat", "ts"):
        grown = {f"{key}_rank": insert_points(spark, sf_dir, key, cap)}
        roots.append(evaluate(spark, ix.btree(d, key, cap, fanout, 0, leaf="idx"), f"SELECT hash AS {key} FROM {key}_rootnode", given=grown))
    return roots[0].join(roots[1]).join(roots[2]).selectExpr(f"{d.sha(d.text_hex('THREE-MBT-ROOT-v1'), 'lon', 'lat', 'ts')} AS root")


def rtree_insert_root(spark: SparkSession, sf_dir: str, cap: int = CAP, fanout: int = FANOUT) -> DataFrame:
    """Root commitment of the R-tree after the insert."""
    ctes = [("morton_rank", ""), *ix.rtree(d, cap, fanout, 0, leaf="idx")]
    return evaluate(spark, ctes, "SELECT root FROM rt_root", given={"morton_rank": insert_points(spark, sf_dir, "morton", cap)})


def updated_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tree of 60 % of trajectories after the rest's entries, updated, and the one built of all."""
    road = Road(spark, sf_dir)
    both = updated(d)
    base = stored(statement(spark, sf_dir, both, "SELECT eid, tid, start_ts, end_ts FROM base"), "base")
    delta = stored(statement(spark, sf_dir, both, "SELECT eid, tid, start_ts, end_ts FROM delta"), "delta")
    roots = lambda entries: mmr_roots(spark, stored(mmr_nodes(entries), "mmr"))
    tree, records = spatial_tree.sem_tree(road.nodes, road.edges, roots(base), THETA)
    old = base.join(delta.select("eid").distinct(), "eid", "left_semi")
    changed = roots(old.unionByName(delta))
    rebuilt = spatial_tree.sem_tree(road.nodes, road.edges, roots(base.unionByName(delta)), THETA)[0]
    return spatial_tree.updated_tree(tree, records, changed)[0], rebuilt


def append_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the updated tree, and how many of them differ from those of a full build."""
    ours, full = updated_trees(spark, sf_dir)
    same = ours.join(full.select("path", F.col("hash").alias("want")), "path", "full_outer")
    return same.agg(F.count("*").alias("n_nodes"), F.count_if(F.expr("hash IS DISTINCT FROM want")).alias("n_differing"))


def btree_json_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the three proofs of each window of the matrix as compact JSON."""
    parts, windows = {}, spark.sql(matrix(d))
    for key in KEYS:
        sql = lambda body: stored(statement(spark, sf_dir, points(d), body), "btree")
        nodes = sql(f"SELECT h, idx, hash, array(lo) AS lows, array(hi) AS highs FROM {key}_nodes")
        records = sql(f"SELECT {d.idiv('r', CAP)} AS idx, CAST({key} AS DOUBLE) AS key, point_id, tid FROM {key}_rank")
        parts[key] = packed_proofs.json_sizes(nodes, records, FANOUT, key_ranges(windows)[key], {"ts": "time"}.get(key, key))
    return packed_proofs.composite_json_sizes(parts, windows)


def list_vo_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_proofs.sizes(list_proofs.proof_tokens(*list_tree(spark, sf_dir), spark.sql(matrix(d))))


def updated_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The binary tree of 60 % of trajectories after the rest's entries, and one of all in the same shape.

    Only lists that got an entry are chained again, and only groups and paths of their edges hashed.
    """
    road, both = Road(spark, sf_dir), [*updated(d), ("own", "SELECT e.eid, e.tid, e.start_ts, e.end_ts, e.user_id, e.seq, o <= n_base AS old FROM entries e JOIN ordinal USING (user_id) CROSS JOIN cutoff")]
    rows = stored(statement(spark, sf_dir, both, "SELECT eid, tid, start_ts, end_ts, user_id, seq, old FROM own"), "list-rows")

    def heads(entries: DataFrame) -> DataFrame:
        order = Window.partitionBy("eid").orderBy("start_ts", "user_id", "seq")
        lists = entries.select("eid", "tid", "start_ts", "end_ts", F.row_number().over(order).cast("long").alias("rank"), F.count("*").over(Window.partitionBy("eid")).alias("total"))
        return stored(chains.list_states(lists).groupBy("eid").agg(F.max("pos").alias("k"), F.min_by("state", "pos").alias("root")), "list-heads")

    base = rows.where("old")
    weight = base.groupBy("eid").agg(F.count_distinct("tid").alias("weight"))
    edges = road.edges.join(weight, "eid", "left").fillna(0, ["weight"])
    tree, placed = spatial_tree.binary_tree(road.nodes, edges, heads(base), THETA)
    touched = heads(rows.join(rows.where("NOT old").select("eid").distinct(), "eid", "left_semi"))
    return spatial_tree.updated_binary_tree(tree, placed, touched)[0], spatial_tree.binary_tree(road.nodes, edges, heads(rows), THETA)[0]


def list_update_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the updated binary tree, and how many of them differ from those of a full build."""
    ours, full = updated_lists(spark, sf_dir)
    same = ours.join(full.select("path", F.col("hash").alias("want")), "path", "full_outer")
    return same.agg(F.count("*").alias("n_nodes"), F.count_if(F.expr("hash IS DISTINCT FROM want")).alias("n_differing"))


def road_tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of the road network's own tree."""
    road = Road(spark, sf_dir)
    return road_tree.road_tree(road.nodes, road.edges, THETA)[0].where("path = ''").select(F.col("hash").alias("root"))


N_NEW_EDGES = 10


def road_new_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that the road experiment adds."""
    road = Road(spark, sf_dir)
    rows = [(t, min(u, v), max(u, v), round(m, 3)) for t, u, v, m in road_tree.new_edges(stored(road.nodes, "nodes"), stored(road.edges, "edges"), N_NEW_EDGES)]
    return spark.createDataFrame(rows, "target int, a long, b long, meters double")


def road_update_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole road's proof before and after new edges: root, sizes, and whether it holds."""
    road = Road(spark, sf_dir)
    nodes, edges = stored(road.nodes, "nodes"), stored(road.edges, "edges")
    grown = stored(road_tree.with_new_edges(nodes, edges, road_tree.new_edges(nodes, edges, N_NEW_EDGES)), "edges")
    out = []
    for state, own in (("before", edges), ("after", grown)):
        tree, placed = road_tree.road_tree(nodes, own, THETA)
        tokens = stored(road_tree.proof_tokens(tree, placed), "road-proof")
        root = tree.where("path = ''").first()["hash"]
        report = road_tree.verify_report(tokens, root, own.count()).drop("n_edges")
        out.append(report.join(road_tree.payload_bytes(tokens)).select(F.lit(state).alias("state"), F.lit(root).alias("root"), "*"))
    return out[0].unionByName(out[1])


QUERIES = {f.__name__: f for f in (sem_tree, sem_leaf_edges, l0_root, sem_origins, edge_partition_problems, vo_tokens, vo_token_histogram, query_counters, vo_sizes, verify_report, verified_candidates, binary_tree, binary_tree_root, list_vo_tokens, list_candidates, list_verify_report, rtree_verify_report, btree_verify_report, rtree_disclosed_candidates, btree_insert_root, rtree_insert_root, append_equals_rebuild, btree_json_sizes, list_vo_sizes, list_update_equals_rebuild, road_tree_root, road_new_edges, road_update_report)}
#: The candidates that a proof discloses are those of the plain query.
SAME_AS = {"verified_candidates": "coarse_candidates", "list_candidates": "coarse_candidates", "rtree_disclosed_candidates": "rtree_candidates"}
ORACLE = {name: PLAIN[same] for name, same in SAME_AS.items()} | tree_oracles.oracles(THETA)
