"""The engine's scalar functions under SQL names of a session, as expressions without Python code."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.dialect import Spark as d
from tessera.functions.dialect import segment_hits


def register_functions(spark: SparkSession) -> None:
    """u32be, u64be, f64be, mmr_leaf and segment_hits, as temporary SQL functions."""
    box = "min_lon DOUBLE, min_lat DOUBLE, max_lon DOUBLE, max_lat DOUBLE"
    hit = segment_hits("x0", "y0", "x1", "y1", "w").replace("w.", "")
    for name, args, kind, body in (
        ("u32be", "x BIGINT", "STRING", f"lower({d.u32('x')})"),
        ("u64be", "x BIGINT", "STRING", f"lower({d.u64('x')})"),
        ("f64be", "x DOUBLE", "STRING", f"lower({d.f64('x')})"),
        ("mmr_leaf", "tid STRING, start_ts BIGINT, end_ts BIGINT", "STRING", d.sha("tid", d.u32("start_ts"), d.u32("end_ts"))),
        ("segment_hits", f"x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, {box}", "BOOLEAN", hit),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
