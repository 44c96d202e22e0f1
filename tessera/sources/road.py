"""Road networks from text: nodes `id lon lat` and edges `eid u v`, with validation as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("f[0] <> ''")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, lon, lat; lines with fewer than three fields are skipped, ids may have gaps."""
    return _fields(spark, path).where("size(f) >= 3").select(F.expr("cast(f[0] as bigint)").alias("node_id"), F.expr("cast(f[1] as double)").alias("lon"), F.expr("cast(f[2] as double)").alias("lat"))


def read_edges(spark: SparkSession, path: str, nodes: DataFrame, parallel: str = "refuse") -> DataFrame:
    """eid, u, v and the box of the edge.

    parallel: of edges between the same nodes in either direction, "least" keeps that with the least
    eid, "all" keeps them, and "refuse" raises; so do repeated eids, edges without their nodes and
    nodes given twice, unless parallel is "least".
    """
    raw = _fields(spark, path).where("size(f) >= 3").selectExpr("cast(f[0] as bigint) eid", "cast(f[1] as bigint) u", "cast(f[2] as bigint) v")
    pair = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    if parallel == "least":
        raw = raw.groupBy(*pair).agg(F.min(F.struct("eid", "u", "v")).alias("e")).select("e.*")
    elif parallel not in ("all", "refuse"):
        raise ValueError(f"parallel edges can't be treated by {parallel!r}")
    else:
        bad = violations(nodes, raw)
        if parallel == "refuse":
            bad = bad.union(raw.groupBy(*pair).agg(F.count("*").alias("n"), F.min("eid").alias("id")).where("n > 1").select(F.lit("parallel edges").alias("kind"), "id"))
        if found := bad.first():
            raise ValueError(f"{found['kind']}: {found['id']}")
    end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("lon").alias(f"{c}lon"), F.col("lat").alias(f"{c}lat"))
    out = raw.join(end("u"), "u").join(end("v"), "v")
    return out.select("eid", "u", "v", F.least("ulon", "vlon").alias("min_lon"), F.least("ulat", "vlat").alias("min_lat"), F.greatest("ulon", "vlon").alias("max_lon"), F.greatest("ulat", "vlat").alias("max_lat"))


def find_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least eid between them in either direction; null where there is none."""
    least = edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("eid").alias("eid"))
    return pairs.join(least, (F.least(pairs["u"], pairs["v"]) == F.col("a")) & (F.greatest(pairs["u"], pairs["v"]) == F.col("b")), "left").drop("a", "b")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind and id of repeated node ids, repeated edge ids and edges that end at no node."""
    twice = lambda df, c, kind: df.groupBy(F.col(c).alias("id")).count().where("count > 1").select(F.lit(kind).alias("kind"), "id")
    ends = edges.select("eid", F.explode(F.array("u", "v")).alias("node_id"))
    lost = ends.join(nodes, "node_id", "left_anti").select(F.lit("edge without node").alias("kind"), F.col("eid").alias("id")).distinct()
    return twice(nodes, "node_id", "node id twice").union(twice(edges, "eid", "edge id twice")).union(lost)
