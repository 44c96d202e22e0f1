"""Weighted spatial trees over a road network, split level by level, and their hashes.

A node is its path from the root: '0' and '2' are the sides of a split, '1' is the
middle leaf of edges that cross it. A vertex's path is refined by one digit a level, so
an edge's place follows from its ends: their common path, or where the paths part. The
text order of path || '3' is the order in which children come before their parent.

Road networks are small beside trajectories, but nothing here is collected: splits come
from running weights over ranges (tables.running), and the driver only reads whether a
level still has open nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.operators import chains
from tessera.operators.tables import running, stored

EMPTY_LO, EMPTY_HI = 4294967295, 0  # fixed values: the time range of no entries
BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def vertex_paths(nodes: DataFrame, edges: DataFrame, theta: int, *, stop_without_edges: bool = True) -> DataFrame:
    """(node_id, lon, lat, path) of every node's leaf.

    nodes: node_id, lon, lat; edges: eid, u, v, weight. A set of more than theta nodes (and
    with an edge, if stop_without_edges) is split on its wider side, longitude in a tie,
    where twice the running weight of edge ends is nearest to the total; without weight, in
    halves. A loop counts once with stop_without_edges, else twice.
    """
    if theta < 2:
        raise ValueError("theta must be at least 2")
    open_, done = nodes.select("node_id", F.col("lon").cast("double"), F.col("lat").cast("double"), F.lit("").alias("path")), []
    edges = edges.select("eid", "u", "v", "weight")
    while True:
        open_ = stored(open_, "tree-level")
        inside = edges.join(_end(open_, "u"), "u").join(_end(open_, "v"), "v").where("u_path = v_path")
        ends = F.array("u", "v")
        load = inside.select(F.explode(F.array_distinct(ends) if stop_without_edges else ends).alias("node_id"), "weight", F.lit(1).alias("n"))
        load = load.groupBy("node_id").agg(F.sum("weight").alias("w"), F.sum("n").alias("n"))
        loaded = open_.join(load, "node_id", "left").fillna(0, ["w", "n"])
        stats = loaded.groupBy("path").agg(F.count("*").alias("size"), F.sum("w").alias("total"), F.sum("n").alias("n_ends"), ((F.max("lon") - F.min("lon")) >= (F.max("lat") - F.min("lat"))).alias("by_lon"))
        split = stats.where(F.col("size") > theta)
        if stop_without_edges:
            split = split.where("n_ends > 0")
        split = stored(split, "tree-splits")
        done.append(open_.join(split, "path", "left_anti").select("node_id", "lon", "lat", "path"))
        if split.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rows = loaded.join(split.select("path", "size", "total", "by_lon"), "path").withColumn("x", F.expr("if(by_lon, lon, lat)"))
        rows = running(rows, ["x", "node_id"], {"prefix": "w", "pos": "1L"}, ["path"], label="tree-order")
        gap = F.struct(F.abs(2 * F.col("prefix") - F.col("total")), F.col("pos"))
        best = rows.where("pos < size").groupBy("path").agg(F.min(gap).alias("best"))
        cut = F.when(F.col("total") == 0, F.expr("size div 2")).otherwise(F.col("best.pos"))
        open_ = rows.join(best, "path").select("node_id", "lon", "lat", F.concat("path", F.when(F.col("pos") <= cut, "0").otherwise("2")).alias("path"))


def _end(vertices: DataFrame, side: str) -> DataFrame:
    return vertices.select(F.col("node_id").alias(side), F.col("path").alias(f"{side}_path"))


def edge_places(vertices: DataFrame, edges: DataFrame, middle: str = "1") -> DataFrame:
    """edges with the path of their node: that of both ends, or where these part, followed by `middle`."""
    out = edges.join(_end(vertices, "u"), "u").join(_end(vertices, "v"), "v")
    parts = "get(filter(sequence(1, greatest(length(u_path), 1)), i -> substr(u_path, i, 1) <> substr(v_path, i, 1)), 0)"
    path = F.when(F.col("u_path") == F.col("v_path"), F.col("u_path")).otherwise(F.concat(F.expr(f"substr(u_path, 1, {parts} - 1)"), F.lit(middle)))
    return out.withColumn("path", path).drop("u_path", "v_path")


def _prefixes(path: str) -> F.Column:
    return F.expr(f"explode(transform(sequence(0, length({path})), i -> substr({path}, 1, i)))").alias("node")


def _meta(prefix: str = "") -> list[str]:
    return [d.f64(f"{prefix}{c}") for c in BOX] + [d.u32(f"{prefix}lo"), d.u32(f"{prefix}hi")]


RECORD = d.sha(d.u32("eid"), d.f64("ulon"), d.f64("ulat"), d.f64("vlon"), d.f64("vlat"), d.u32("k"), d.u32("lo"), d.u32("hi"), "root")


def bottom_up(nodes: DataFrame, children: F.Column, internal: str, carry: list[str]) -> DataFrame:
    """nodes with hashes: leaves have one, internal nodes get it from their children, deepest first."""
    nodes = stored(nodes.withColumn("depth", F.length("path")), "tree-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level, levels = stored(nodes.where(F.col("depth") == deepest), "tree-hashed"), []
    for depth in range(deepest - 1, -1, -1):
        levels.append(level)
        parts = level.select(F.substring("path", 1, depth).alias("parent"), F.struct("path", children.alias("part")).alias("child"))
        below = parts.groupBy(F.col("parent").alias("path")).agg(F.array_sort(F.collect_list("child")).alias("below"))
        here = nodes.where(F.col("depth") == depth).join(below, "path", "left")
        here = here.withColumn("parts", F.array_join(F.transform("below", lambda c: c["part"]), ""))
        level = stored(here.withColumn("hash", F.when(F.col("leaf"), F.col("hash")).otherwise(F.expr(internal))).select(nodes.columns), "tree-hashed")
    return reduce(DataFrame.unionByName, [*levels, level]).select("path", "leaf", "origin", *BOX, *carry, "hash")


def skeleton(vertices: DataFrame, records: DataFrame, more: dict, block: str) -> DataFrame:
    """path, leaf, origin, box, columns of `more`, n_edges and block of every node of a three-way tree.

    more: name: (aggregate over the edges below, value without edges); block: aggregate over a
    leaf's edges, null without them.
    """
    of_edges = records.select(_prefixes("path"), "ulon", "ulat", "vlon", "vlat", *more).groupBy(F.col("node").alias("path")).agg(
        F.min(F.least("ulon", "vlon")).alias("e0"), F.min(F.least("ulat", "vlat")).alias("e1"), F.max(F.greatest("ulon", "vlon")).alias("e2"), F.max(F.greatest("ulat", "vlat")).alias("e3"), *[f.alias(n) for n, (f, _) in more.items()])
    blocks = records.groupBy("path").agg(F.count("*").alias("n_edges"), F.expr(block).alias("block"))
    normal = vertices.groupBy("path").agg(*[f(c).alias(f"v{k}") for k, (f, c) in enumerate(((F.min, "lon"), (F.min, "lat"), (F.max, "lon"), (F.max, "lat")))]).withColumn("leaf", F.lit(True)).withColumn("origin", F.lit("normal"))
    inner = normal.where("path <> ''").select(F.expr("explode(transform(sequence(0, length(path) - 1), i -> substr(path, 1, i)))").alias("path")).distinct()
    zeros = [F.lit(0.0).alias(f"v{k}") for k in range(4)]
    shape = normal.unionByName(inner.select(F.concat("path", F.lit("1")).alias("path"), *zeros, F.lit(True).alias("leaf"), F.lit("middle").alias("origin")))
    shape = shape.unionByName(inner.select("path", *zeros, F.lit(False).alias("leaf"), F.lit("internal").alias("origin")))
    box = [F.coalesce(f"e{k}", f"v{k}").alias(c) for k, c in enumerate(BOX)]
    return shape.join(of_edges, "path", "left").join(blocks, "path", "left").select("path", "leaf", "origin", *box, *[F.coalesce(n, F.lit(x)).alias(n) for n, (_, x) in more.items()], F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "block")


def sem_tree(nodes: DataFrame, edges: DataFrame, roots: DataFrame, theta: int) -> tuple[DataFrame, DataFrame]:
    """Tree of left, middle and right children; returns its nodes and the edge records with their leaf.

    nodes: node_id, lon, lat; edges: eid, u, v, ulon, ulat, vlon, vlat; roots: eid, k, root, lo, hi of
    edges with entries. Nodes: path, leaf, origin, box of the edges below (of the vertices in a leaf
    without edges; zeros in an empty middle), lo, hi, n_edges, hash.
    """
    vertices = stored(vertex_paths(nodes, edges.withColumn("weight", F.lit(1)), theta), "tree-vertices")
    none = d.sha(d.u32("0"))
    records = edge_places(vertices, edges).join(roots.select("eid", "k", "root", "lo", "hi"), "eid", "left")
    records = records.select("eid", "path", "ulon", "ulat", "vlon", "vlat", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("lo", F.lit(EMPTY_LO)).alias("lo"), F.coalesce("hi", F.lit(EMPTY_HI)).alias("hi"), F.coalesce("root", F.expr(none)).alias("root"))
    records = stored(records.withColumn("record", F.expr(RECORD)), "tree-edges")
    times = {"lo": (F.min("lo"), EMPTY_LO), "hi": (F.max("hi"), EMPTY_HI)}
    full = skeleton(vertices, records, times, d.sha(d.ordered("record", "eid"))).withColumn("block", F.coalesce("block", F.expr("sha2(unhex(''), 256)")))
    full = full.withColumn("hash", F.when(F.col("leaf"), F.expr(d.sha(*_meta(), "block"))))
    phi = F.expr(f"concat(hash, {', '.join(_meta())})")
    return bottom_up(full.drop("block"), phi, d.sha(*_meta(), "parts"), ["lo", "hi", "n_edges"]), records


def binary_tree(nodes: DataFrame, edges: DataFrame, heads: DataFrame, theta: int) -> tuple[DataFrame, DataFrame]:
    """Two-way tree whose crossing edges stay at the internal node; weights are distinct trajectories.

    edges: eid, u, v, weight; heads: eid, k, root of the sorted lists. Returns the nodes (box of the
    vertices, n_edges, grp (state of its edges), hash) and the edges' places and hashes.
    """
    vertices = stored(vertex_paths(nodes, edges, theta, stop_without_edges=False), "tree-vertices")
    placed = edge_places(vertices, edges, middle="").join(heads, "eid", "left")
    placed = placed.select("eid", "path", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("root", F.lit(chains.LIST_TAIL)).alias("root"))
    placed = stored(placed.withColumn("hash", F.expr(chains.edge_hash("eid", "k", "root"))), "tree-edges")
    groups = chains.group_roots(placed.select(F.col("path").alias("key"), "eid", "hash")).select(F.col("key").alias("path"), F.col("n").alias("n_edges"), F.col("state").alias("grp"))
    leaves = vertices.select("path").distinct().withColumn("leaf", F.lit(True))
    shape = vertices.select(_prefixes("path"), "lon", "lat").groupBy(F.col("node").alias("path")).agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    full = shape.join(leaves, "path", "left").join(groups, "path", "left").fillna({"leaf": False, "n_edges": 0, "grp": chains.GROUP_INIT})
    full = full.withColumn("origin", F.expr("if(leaf, 'normal', 'internal')"))
    box = [d.f64(c) for c in BOX]
    full = full.withColumn("hash", F.when(F.col("leaf"), F.expr(d.sha(d.text_hex("BL-SPATIAL-LEAF-v2"), *box, d.u32("n_edges"), "grp"))))
    return bottom_up(full, F.col("hash"), d.sha(d.text_hex("BL-SPATIAL-INTERNAL-v2"), *box, "parts", d.u32("n_edges"), "grp"), ["n_edges", "grp"]), placed


def partition_problems(tree: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """eid, problem of edges that aren't in exactly one leaf, lie at no leaf of the tree, or aren't the road's."""
    twice = records.groupBy("eid").agg(F.count("*").alias("n")).where("n > 1").select("eid", F.lit("in several leaves").alias("problem"))
    lost = edges.select("eid").join(records, "eid", "left_anti").select("eid", F.lit("in no leaf").alias("problem"))
    strange = records.join(edges.select("eid"), "eid", "left_anti").select("eid", F.lit("not of the road").alias("problem"))
    astray = records.join(tree.where("leaf"), "path", "left_anti").select("eid", F.lit("at no leaf").alias("problem"))
    return reduce(DataFrame.unionByName, [twice, lost, strange, astray])


def delta_problems(records: DataFrame, delta: DataFrame) -> DataFrame:
    """eid, problem of entries that can't be appended: an edge the tree lacks, or an end before its start."""
    lost = delta.join(records, "eid", "left_anti").select("eid", F.lit("unknown edge").alias("problem"))
    return lost.unionByName(delta.where("end_ts < start_ts").select("eid", F.lit("ends before its start").alias("problem"))).distinct()


def updated_tree(tree: DataFrame, records: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sem_tree's results after new roots (eid, k, root, lo, hi) of some edges; other nodes keep their hashes.

    Only blocks of leaves with such an edge, and the nodes above them, are hashed again. New
    roots are those of lists that grew: a time range may widen, not shrink.
    """
    fresh = roots.select("eid", *[F.col(c).alias(f"new_{c}") for c in ("k", "root", "lo", "hi")])
    state = [F.coalesce(f"new_{c}", c).alias(c) for c in ("k", "lo", "hi", "root")]
    joined = records.drop("record").join(fresh, "eid", "left").select("eid", "path", "ulon", "ulat", "vlon", "vlat", *state, F.col("new_k").isNotNull().alias("new"))
    joined = stored(joined.withColumn("record", F.expr(RECORD)), "tree-edges")
    touched = joined.where("new").select("path").distinct()
    dirty = stored(touched.select(_prefixes("path")).select(F.col("node").alias("path")).distinct(), "tree-dirty")
    under = joined.join(touched, "path", "left_semi")
    blocks = under.groupBy("path").agg(F.expr(d.sha(d.ordered("record", "eid"))).alias("block"), F.min("lo").alias("b_lo"), F.max("hi").alias("b_hi"))
    leaves = tree.where("leaf").join(blocks, "path").withColumn("lo", F.col("b_lo")).withColumn("hi", F.col("b_hi")).drop("b_lo", "b_hi")
    leaves = stored(leaves.withColumn("hash", F.expr(d.sha(*_meta(), "block"))).select(tree.columns), "tree-leaves")
    grown = leaves.select(_prefixes("path"), "lo", "hi").groupBy(F.col("node").alias("path")).agg(F.min("lo").alias("n_lo"), F.max("hi").alias("n_hi"))
    inner = tree.where("NOT leaf").join(grown, "path").withColumn("lo", F.least("lo", "n_lo")).withColumn("hi", F.greatest("hi", "n_hi")).select(tree.columns)
    clean = tree.join(dirty, "path", "left_anti")
    beside = clean.join(dirty.select(F.col("path").alias("parent")), F.expr("path <> '' AND substr(path, 1, length(path) - 1) = parent"), "left_semi")
    kept = lambda df: df.withColumn("leaf", F.lit(True))
    phi = F.expr(f"concat(hash, {', '.join(_meta())})")
    hashed = bottom_up(kept(leaves).unionByName(inner).unionByName(kept(beside)), phi, d.sha(*_meta(), "parts"), ["lo", "hi", "n_edges"])
    again = hashed.join(dirty, "path", "left_semi").drop("leaf").join(tree.select("path", "leaf"), "path").select(tree.columns)
    return clean.unionByName(again), joined.select(records.columns)


def updated_binary_tree(tree: DataFrame, placed: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """binary_tree's results after new heads (eid, k, root) of some edges' lists; the tree's shape stays.

    Only groups of nodes with such an edge, and the nodes above them, are hashed again.
    """
    fresh = heads.select("eid", F.col("k").alias("new_k"), F.col("root").alias("new_root"))
    joined = placed.join(fresh, "eid", "left").select("eid", "path", F.coalesce("new_k", "k").alias("k"), F.coalesce("new_root", "root").alias("root"), F.col("new_k").isNotNull().alias("new"))
    joined = stored(joined.withColumn("hash", F.expr(chains.edge_hash("eid", "k", "root"))), "tree-edges")
    touched = joined.where("new").select("path").distinct()
    dirty = stored(touched.select(_prefixes("path")).select(F.col("node").alias("path")).distinct(), "tree-dirty")
    groups = chains.group_roots(joined.join(touched, "path", "left_semi").select(F.col("path").alias("key"), "eid", "hash")).select(F.col("key").alias("path"), F.col("state").alias("new_grp"))
    here = tree.join(dirty, "path").join(groups, "path", "left").withColumn("grp", F.coalesce("new_grp", "grp")).select(tree.columns)
    box = [d.f64(c) for c in BOX]
    here = here.withColumn("hash", F.when(F.col("leaf"), F.expr(d.sha(d.text_hex("BL-SPATIAL-LEAF-v2"), *box, d.u32("n_edges"), "grp"))))
    clean = tree.join(dirty, "path", "left_anti")
    beside = clean.join(dirty.select(F.col("path").alias("parent")), F.expr("path <> '' AND substr(path, 1, length(path) - 1) = parent"), "left_semi")
    hashed = bottom_up(here.unionByName(beside.withColumn("leaf", F.lit(True))), F.col("hash"), d.sha(d.text_hex("BL-SPATIAL-INTERNAL-v2"), *box, "parts", d.u32("n_edges"), "grp"), ["n_edges", "grp"])
    again = hashed.join(dirty, "path", "left_semi").drop("leaf").join(tree.select("path", "leaf"), "path").select(tree.columns)
    return clean.unionByName(again), joined.select(placed.columns)
