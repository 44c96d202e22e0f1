"""The road network's own tree, a proof that discloses all of it, and new roads near given places.

The tree has the shape of spatial_tree.sem_tree, but hashes cover geometry alone. A proof
holds every edge in front of its leaf and children in front of their parent, so that the
client rebuilds the root with a stack as deep as the tree.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.operators.proofs import Rejected
from tessera.operators.spatial_tree import BOX, bottom_up, edge_places, skeleton, vertex_paths
from tessera.operators.tables import stored

# Fixed values of the record formats.
EDGE, LEAF, INTERNAL = "ROAD-EDGE-v1", "ROAD-LEAF-v1", "ROAD-INTERNAL-v1"
NORMAL_LEAF, MIDDLE_LEAF = 0, 1
EDGE_FORMAT, LEAF_FORMAT, INTERNAL_FORMAT = ">qqqdddd", ">ddddiI", ">dddd"
EDGE_BYTES, LEAF_BYTES, INTERNAL_BYTES = 3 * 4 + 4 * 8, 1 + 4 * 8 + 4 + 4, 1 + 4 * 8 + 3 * 4  # of a proof's payload

# Fixed values of the road experiment: places within the network's box, and lengths in metres.
TARGETS = [(x, y) for y in (0.28, 0.72) for x in (0.12, 0.30, 0.50, 0.70, 0.88)]
POOL, WIDE_POOL = 64, 256
PREFERRED_METERS, RELAXED_METERS = (80.0, 2000.0), 5000.0

_BOX = [d.f64(c) for c in BOX]
_RECORD = [d.u64("eid"), d.u64("u"), d.u64("v"), *[d.f64(c) for c in ("ulon", "ulat", "vlon", "vlat")]]
_ORIGIN = f"if(origin = 'middle', {MIDDLE_LEAF}, {NORMAL_LEAF})"


def road_tree(nodes: DataFrame, edges: DataFrame, theta: int) -> tuple[DataFrame, DataFrame]:
    """Tree nodes (path, leaf, origin, box, n_edges, hash) and the edges with their leaf's path.

    nodes: node_id, lon, lat; edges: eid, u, v, ulon, ulat, vlon, vlat.
    """
    vertices = stored(vertex_paths(nodes, edges.withColumn("weight", F.lit(1)), theta), "tree-vertices")
    placed = edge_places(vertices, edges).select("eid", "path", "u", "v", "ulon", "ulat", "vlon", "vlat")
    placed = stored(placed.withColumn("record", F.expr(d.sha(d.text_hex(EDGE), *_RECORD))), "road-edges")
    full = skeleton(vertices, placed, {}, d.ordered("record", "eid")).withColumn("block", F.coalesce("block", F.lit("")))
    full = full.withColumn("hash", F.when(F.col("leaf"), F.expr(d.sha(d.text_hex(LEAF), *_BOX, d.u32(_ORIGIN), d.u32("n_edges"), "block"))))
    return bottom_up(full.drop("block"), F.col("hash"), d.sha(d.text_hex(INTERNAL), *_BOX, "parts"), ["n_edges"]), placed


def proof_tokens(tree: DataFrame, placed: DataFrame) -> DataFrame:
    """place, of_node, eid, token ('E', 'L' or 'I') and body (hex) of a proof of the whole network."""
    none = F.lit(None).cast("long")
    body = F.when(F.col("leaf"), F.expr(f"concat({', '.join(_BOX)}, {d.u32(_ORIGIN)}, {d.u32('n_edges')})")).otherwise(F.expr(f"concat({', '.join(_BOX)})"))
    heads = tree.select(F.concat("path", F.lit("3")).alias("place"), F.lit(1).alias("of_node"), none.alias("eid"), F.when(F.col("leaf"), "L").otherwise("I").alias("token"), F.lower(body).alias("body"))
    return heads.unionByName(placed.select(F.concat("path", F.lit("3")).alias("place"), F.lit(0).alias("of_node"), "eid", F.lit("E").alias("token"), F.lower(F.expr(f"concat({', '.join(_RECORD)})")).alias("body")))


def payload_bytes(tokens: DataFrame) -> DataFrame:
    """Bytes of a proof and its numbers of tokens."""
    n = lambda t: F.count_if(F.col("token") == t)
    return tokens.agg((n("E") * EDGE_BYTES + n("L") * LEAF_BYTES + n("I") * INTERNAL_BYTES).alias("proof_bytes"), n("E").alias("n_edges"), n("L").alias("n_leaves"), n("I").alias("n_internal"))


class Verifier:
    """Takes tokens one by one and rebuilds the root."""

    def __init__(self) -> None:
        self.nodes: list[bytes] = []
        self.block, self.in_leaf, self.last_eid, self.n_edges = b"", 0, -1, 0

    def take(self, token: str, body: bytes) -> None:
        if token == "E":
            eid = struct.unpack(EDGE_FORMAT, body)[0]
            if eid <= self.last_eid:
                raise Rejected("edges of a leaf out of order")
            self.block += hashlib.sha256(EDGE.encode() + body).digest()
            self.last_eid, self.in_leaf, self.n_edges = eid, self.in_leaf + 1, self.n_edges + 1
            return
        if token == "L":
            if struct.unpack(LEAF_FORMAT, body)[5] != self.in_leaf:
                raise Rejected("a leaf's edges differ from its record")
            self.nodes.append(hashlib.sha256(LEAF.encode() + body + self.block).digest())
        else:
            if len(self.nodes) < 3 or self.in_leaf or len(body) != struct.calcsize(INTERNAL_FORMAT):
                raise Rejected("a node lacks children")
            self.nodes[-3:] = [hashlib.sha256(INTERNAL.encode() + body + b"".join(self.nodes[-3:])).digest()]
        self.block, self.in_leaf, self.last_eid = b"", 0, -1


def verify_report(tokens: DataFrame, root: str, n_edges: int) -> DataFrame:
    """One row: whether the proof leads to the root with n_edges different edges, and if not, why."""
    trusted = bytes.fromhex(root)

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check, why, some = Verifier(), None, False
        for frame in frames:
            for token, body in zip(frame["token"], frame["body"], strict=True):
                some = True
                if why is None:
                    try:
                        check.take(token, bytes.fromhex(body))
                    except (Rejected, struct.error) as e:
                        why = str(e)
        if some:
            if why is None and check.nodes != [trusted]:
                why = "the root differs"
            yield pd.DataFrame([(why, check.n_edges)], columns=["reason", "n_edges"])

    shown = tokens.repartition(1).sortWithinPartitions("place", "of_node", "eid").select("token", "body").mapInPandas(stream, "reason string, n_edges long")
    own = tokens.where("token = 'E'").agg(F.count_distinct("eid").alias("n_different"))
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when((F.col("n_edges") != n_edges) | (F.col("n_different") != n_edges), "wrong number of edges")
    return shown.join(own).select(why.isNull().alias("accepted"), why.alias("reason"), "n_edges")


def _meters(lon0: str, lat0: str, lon1: str, lat1: str) -> str:
    return f"sqrt(power(({lon1} - {lon0}) * 111320e0 * cos(radians(({lat0} + {lat1}) * 0.5e0)), 2) + power(({lat1} - {lat0}) * 110540e0, 2))"


def targets(count: int) -> list[tuple[float, float]]:
    """Places as shares of the network's box; beyond the fixed ones by a low-discrepancy sequence."""
    more = range(max(0, count - len(TARGETS)))
    return (TARGETS + [(0.15 + 0.70 * (i * 0.61803398875 % 1.0), 0.15 + 0.70 * (i * 0.41421356237 % 1.0)) for i in more])[:count]


def new_edges(nodes: DataFrame, edges: DataFrame, count: int) -> list[tuple[int, int, int, float]]:
    """(target, u, v, meters) of `count` edges that the network lacks, one near each target.

    Of pairs among a target's nearest nodes the one whose middle is nearest: of preferred
    length, else of relaxed length, else of any length in a wider pool. Pairs already taken
    by earlier targets are passed over: each tier sends at most count rows a target to the driver.
    Where a wider pool may lack pairs for a target, pools grow, at last to all nodes; targets get
    no edge only if the network then lacks no more.
    """
    spark = nodes.sparkSession
    where = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(targets(count))], "target int, fx double, fy double")
    box = nodes.agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), F.count(F.lit(1)).alias("n"))
    asked = stored(where.join(box).selectExpr("target", "x0 + (x1 - x0) * fx AS tlon", "y0 + (y1 - y0) * fy AS tlat", "n"), "road-targets")
    n_nodes = asked.agg(F.max("n")).first()[0] or 0
    taken: set = set()
    out: dict[int, tuple] = {}
    wide = WIDE_POOL
    while True:
        rest = asked.where(~F.col("target").isin(list(out))).drop("n")
        for r in _candidates(nodes, edges, rest, wide, count):
            if r["target"] not in out and (r["a"], r["b"]) not in taken:
                taken.add((r["a"], r["b"]))
                out[r["target"]] = (r["target"], r["u"], r["v"], r["meters"])
        if len(out) == count or wide >= n_nodes:
            break
        wide *= 4
    if any(math.isnan(x[3]) for x in out.values()):
        raise ValueError("a place of a node is not a number")
    return [out[k] for k in sorted(out)]


def _candidates(nodes: DataFrame, edges: DataFrame, asked: DataFrame, wide: int, count: int) -> list:
    """Rows target, u, v, a, b, meters in order of preference, at most count a tier, for targets (target, tlon, tlat)."""
    away = F.expr("power((lon - tlon) * greatest(cos(radians(tlat)), 1e-9), 2) + power(lat - tlat, 2)")
    near = nodes.join(F.broadcast(asked)).withColumn("away", away)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("away", "node_id"))).where(F.col("r") <= wide)
    near = stored(near.select("target", "tlon", "tlat", "node_id", "lon", "lat", "r"), "road-near")
    p, q = near.alias("p"), near.alias("q")
    pairs = p.join(q, F.expr("p.target = q.target AND p.r < q.r")).selectExpr("p.target", "p.node_id AS u", "q.node_id AS v", "least(p.node_id, q.node_id) AS a", "greatest(p.node_id, q.node_id) AS b", "q.r AS far", f"{_meters('p.lon', 'p.lat', 'q.lon', 'q.lat')} AS meters", f"{_meters('(p.lon + q.lon) * 0.5e0', '(p.lat + q.lat) * 0.5e0', 'p.tlon', 'p.tlat')} AS gap")
    pairs = pairs.join(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), ["a", "b"], "left_anti")
    low, high = PREFERRED_METERS
    fits = F.array(F.expr(f"far <= {POOL} AND meters BETWEEN {low} AND {high}"), F.expr(f"far <= {POOL} AND meters <= {RELAXED_METERS}"), F.lit(True))
    tiers = pairs.select("*", F.posexplode(fits).alias("tier", "fit")).where("fit")
    best = tiers.withColumn("k", F.row_number().over(Window.partitionBy("target", "tier").orderBy("gap", "meters", "a", "b"))).where(F.col("k") <= count)
    return best.orderBy("target", "tier", "k").select("target", "u", "v", "a", "b", "meters").collect()


def with_new_edges(nodes: DataFrame, edges: DataFrame, added: list[tuple[int, int, int, float]]) -> DataFrame:
    """edges and the added ones, whose ids follow the greatest."""
    first = (edges.agg(F.max("eid")).first()[0] or 0) + 1
    new = nodes.sparkSession.createDataFrame([(first + k, u, v) for k, (_, u, v, _) in enumerate(added)], "eid long, u long, v long")
    end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("lon").cast("double").alias(f"{c}lon"), F.col("lat").cast("double").alias(f"{c}lat"))
    return edges.unionByName(new.join(end("u"), "u").join(end("v"), "v").select(edges.columns))
