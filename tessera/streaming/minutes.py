"""Distinct trajectories a minute over a stream of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_counts(segments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """window, n: trajectories with a segment in the minute; segments: tid, start_ts, end_ts in seconds.

    A segment counts in each minute from the one that (start - 60) lies in to that of its end. A
    pair is kept once while within the watermark, later ones are late data; then counts are final.
    """
    covered = F.sequence(F.expr("(start_ts - 60) div 60"), F.expr("end_ts div 60"))
    rows = segments.select("tid", F.explode(covered).alias("m")).select("tid", F.timestamp_seconds(F.col("m") * 60).alias("minute"))
    once = rows.withWatermark("minute", delay).dropDuplicates(["tid", "minute"])
    return once.groupBy(F.window("minute", "1 minute")).agg(F.count("*").alias("n"))
