"""Batch inserts into packed trees: rows go to existing leaves, which are cut anew; levels above follow.

An untouched leaf keeps its rows. Results are new tables, so a failed insert leaves the
tree as it was and rolling back is reading the old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import ranked, running, stored


def route(leaves: DataFrame, rows: DataFrame, key: str, *, last_of_equal: bool) -> DataFrame:
    """rows with `leaf`, the first whose greatest key isn't below theirs, else the last leaf.

    leaves: idx from 0 without gaps, top (greatest key). Where several leaves end with a row's
    very key, last_of_equal takes the last of them. An as-of join by running counts: no
    window and no broadcast over all leaves.
    """
    cols = rows.columns
    side = 0 if last_of_equal else 1  # of leaves among equal keys
    marks = leaves.select(F.col("top").alias(key), F.lit(side).alias("side"), F.lit(1).alias("is_leaf"), *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != key])
    mixed = marks.unionByName(rows.withColumn("side", F.lit(1 - side)).withColumn("is_leaf", F.lit(0)))
    found = running(mixed, [key, "side"], {"passed": "is_leaf"}, label="route").where("is_leaf = 0")
    if last_of_equal:
        ends = leaves.select(F.col("top").alias(key)).distinct().withColumn("meets", F.lit(1))
        found = found.join(ends, key, "left").withColumn("passed", F.col("passed") - F.coalesce("meets", F.lit(0)))
    last = leaves.agg(F.max("idx").alias("last_leaf"))
    out = found.join(last).withColumn("leaf", F.least("passed", "last_leaf"))
    return out.select(*cols, "leaf")


def insert(placed: DataFrame, rows: DataFrame, key: str, order: list[str], cap: int, *, last_of_equal: bool) -> DataFrame:
    """All rows with their new leaf `idx` and place `r` in it.

    placed: the tree's rows with idx and r; rows: new ones with the same columns but these. A leaf and
    what goes to it are merged by `order` and cut every `cap` rows. An empty tree is packed afresh.
    """
    columns = rows.columns
    leaves = stored(placed.groupBy("idx").agg(F.max(key).alias("top")), "leaf-tops")
    if leaves.isEmpty():
        return ranked(rows, order, label="pack").select(*columns, F.expr(f"r div {cap}").alias("idx"), F.expr(f"r % {cap}").alias("r"))
    merged = placed.select(*columns, F.col("idx").alias("leaf")).unionByName(route(leaves, rows, key, last_of_equal=last_of_equal))
    at = running(merged, order, {"at": "1L"}, ["leaf"], label="insert").withColumn("chunk", F.expr(f"(at - 1) div {cap}")).withColumn("r", F.expr(f"(at - 1) % {cap}"))
    at = stored(at, "inserted")
    places = ranked(at.select("leaf", "chunk").where("r = 0"), ["leaf", "chunk"], "idx", label="leaf-order")
    return at.join(places, ["leaf", "chunk"]).select(*columns, "idx", "r")
