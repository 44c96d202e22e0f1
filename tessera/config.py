"""Settings of experiments from JSON files, matrices and setups as CSV, answers as JSON, and demonstration data."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Settings:
    """What an experiment runs on; paths in a file are relative to it."""

    data: str = ""
    out: str = "out"
    city: str = ""
    theta: int = 64
    cap: int = 128
    fanout: int = 64
    repeats: int = 1
    warmups: int = 0
    paths: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        if unknown := set(raw) - {x.name for x in fields(Settings)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        base = os.path.dirname(os.path.abspath(path))
        absolute = lambda p: p if not p or os.path.isabs(p) or "://" in p else os.path.normpath(os.path.join(base, p))
        out = Settings(**raw)
        out.data, out.out, out.paths = absolute(out.data), absolute(out.out), {k: absolute(v) for k, v in out.paths.items()}
        return out


def read_matrix(spark: SparkSession, path: str, measure: str) -> DataFrame:
    """label, side, the measure: the filled cells of a matrix of CSV whose columns are sides; a label given twice raises."""
    wide = spark.read.csv(path, header=True)
    sides = [c for c in wide.columns if c.strip().isdigit()]
    label = next(c for c in wide.columns if "label" in c)
    if twice := wide.groupBy(label).count().where("count > 1").first():
        raise ValueError(f"{twice[0]} has two rows")
    cells = wide.unpivot([label], sides, "side", measure).where(F.trim(F.coalesce(measure, F.lit(""))) != "")
    return cells.select(F.col(label).alias("label"), F.trim("side").cast("long").alias("side"), F.col(measure).cast("double"))


def write_matrix(cells: DataFrame, path: str, measure: str, sides: list[int]) -> None:
    """cells (label, side, the measure) as a matrix with a column for each of the sides; cells not there stay blank."""
    cells.groupBy("label").pivot("side", sides).agg(F.first(measure)).orderBy("label").coalesce(1).write.csv(path, header=True, mode="overwrite")


def reconcile(a: DataFrame, b: DataFrame, measure: str, tolerance: float = 1e-9) -> DataFrame:
    """label, side, a, b of the cells of two matrices that one lacks, or that differ by more than the tolerance."""
    own = a.select("label", "side", F.col(measure).alias("a")).join(b.select("label", "side", F.col(measure).alias("b")), ["label", "side"], "full_outer")
    return own.where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def read_setup(spark: SparkSession, path: str, start: int) -> DataFrame:
    """center_lon, center_lat, base_query_start of a setup; `start` where it has none."""
    rows = spark.read.csv(path, header=True)
    has = "base_query_start" in rows.columns
    return rows.select(F.col("center_lon").cast("double"), F.col("center_lat").cast("double"), F.coalesce(F.col("base_query_start").cast("double").cast("long") if has else F.lit(None), F.lit(start)).alias("base_query_start"))


def response(candidates: DataFrame, counters: DataFrame) -> DataFrame:
    """query_id and answer: the candidates in order and a query's counters as JSON."""
    ids = candidates.groupBy("query_id").agg(F.array_sort(F.collect_set("tid")).alias("candidate_ids"))
    stats = counters.select("query_id", F.struct(*[c for c in counters.columns if c != "query_id"]).alias("stats"))
    both = stats.join(ids, "query_id", "left").withColumn("candidate_ids", F.coalesce("candidate_ids", F.array().cast("array<string>")))
    return both.select("query_id", F.to_json(F.struct("candidate_ids", F.size("candidate_ids").alias("candidate_count"), "stats")).alias("answer"))


def demo(spark: SparkSession, n: int = 20, points: int = 12, step: int = 30) -> DataFrame:
    """tid, point_id, ts, lat, lon of n made trajectories that drift north-east, one a minute."""
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return rows.select(
        F.sha2(F.concat(F.lit("demo-"), F.col("id").cast("string")), 256).alias("tid"), (F.col("id") * points + F.col("k")).alias("point_id"), (1_538_352_000 + F.col("id") * 60 + F.col("k") * step).alias("ts"),
        (30.6 + F.col("id") * 0.001 + F.col("k") * 0.0005).alias("lat"), (104.0 + F.col("id") * 0.001 + F.col("k") * 0.0005).alias("lon"),
    )
