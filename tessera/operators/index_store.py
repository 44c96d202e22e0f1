"""Indexes on disk: their tables with a manifest, written last, that has version, root and a digest of each table.

A version of an index is a folder of its own; an update writes a new one, so that a
failed update or a rollback leaves the old one as it is.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import hadoop_path

MAGIC, VERSION = "tessera-index", 1


class StaleIndex(ValueError):
    """An index that isn't what its manifest or a plan says."""


def digest(df: DataFrame) -> list[int]:
    """Rows, and the sum and the exclusive or of their 64-bit hashes: the same for any order of the rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    row = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)") % F.lit(1 << 62).cast("decimal(38,0)")), F.bit_xor(h)).first()
    return [row[0], int(row[1] or 0), int(row[2] or 0)]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    own, files = hadoop_path(spark, path)
    temporary, _ = hadoop_path(spark, path + ".tmp")
    out = files.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(own):
        files.delete(own, False)
    if not files.rename(temporary, own):
        raise OSError(f"{path} can't be written")


def _read_text(spark: SparkSession, path: str) -> str:
    own, files = hadoop_path(spark, path)
    if not files.exists(own):
        raise StaleIndex(f"{path} isn't there: no index, or one whose writing didn't end")
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def save(tables: dict[str, DataFrame], folder: str, root: str, **about) -> dict:
    """Write an index's tables below folder, the manifest last; returns it. root: hex of the commitment."""
    spark = next(iter(tables.values())).sparkSession
    digests = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        digests[name] = digest(spark.read.parquet(f"{folder}/{name}"))
    manifest = {"magic": MAGIC, "version": VERSION, "root": root, "tables": digests, "about": about}
    manifest["digest"] = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    _write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict:
    try:
        manifest = json.loads(_read_text(spark, f"{folder}/manifest.json"))
    except json.JSONDecodeError as e:
        raise StaleIndex("the manifest is damaged") from e
    own = {k: v for k, v in manifest.items() if k != "digest"}
    if manifest.get("magic") != MAGIC or manifest.get("version") != VERSION:
        raise StaleIndex("not an index of this version")
    if hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest() != manifest.get("digest"):
        raise StaleIndex("the manifest's digest differs")
    return manifest


def load(spark: SparkSession, folder: str, *, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest of an index; verify compares every table with its digest."""
    manifest = manifest_of(spark, folder)
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}
    for name, df in tables.items() if verify else ():
        if digest(df) != manifest["tables"][name]:
            raise StaleIndex(f"the table {name} differs from its digest")
    return tables, manifest


def plan_update(manifest: dict) -> dict:
    """What an update is planned against."""
    return {"root": manifest["root"], "digest": manifest["digest"]}


def check_plan(spark: SparkSession, folder: str, plan: dict) -> None:
    """Raise if the index has changed since the update was planned."""
    now = manifest_of(spark, folder)
    if plan != plan_update(now):
        raise StaleIndex("the index has changed since the update was planned")


def disk_bytes(spark: SparkSession, folder: str) -> int:
    path, files = hadoop_path(spark, folder)
    return files.getContentSummary(path).getLength()


def leaf_rows(records: DataFrame, idx: int, size: int) -> DataFrame:
    """A leaf's records in order, with ids and the bytes of each."""
    return records.where(F.col("idx") == idx).withColumn("bytes", F.lit(size)).orderBy("r")
