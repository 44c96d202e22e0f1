"""A corpus from raw documents: filter, deduplicate, decontaminate, redact, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and gives it to the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, neardup, quality, secrets
from tessera.llm._common import materialize, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null, empty and wordless texts go; so does a doc_id of which one row is rejected. A row without
    a doc_id stays, as no label can tell of it. Repeated rows stay or go together.
    """
    judged = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, judged.where("not kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates of 80 % or more, that with the least doc_id.

    Rows without a doc_id come last and, like rows that share one, are told apart by their sets and
    texts: one row of a group stays. Rows without words are linked with nothing; they stay, equal ones once.
    """
    found = materialize(neardup.near_duplicates(docs, num=80), "near-duplicates")
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept"))
    marks = materialize(rows.where("n > 1 or doc_id is null or not kept"), "marks")
    out = docs.join(marks, docs["doc_id"].eqNullSafe(marks["doc_id"]), "left_anti")
    several = marks.where("n > 1 or doc_id is null")
    if several.isEmpty():  # else texts would be shuffled for nothing
        return out
    tag = uuid.uuid4().hex  # of columns that docs can't have
    name, cluster, first, nth = (f"{c}-{tag}" for c in ("set", "cluster", "first", "nth"))
    own = neardup.with_set_id(docs.join(several, docs["doc_id"].eqNullSafe(several["doc_id"]), "left_semi"), name)
    groups = found.select(F.col("doc_id").alias(f"id-{tag}"), F.col("set_id").alias(f"of-{tag}"), F.col("cluster").alias(cluster), F.col("component_id").alias(first)).distinct()
    own = own.join(groups, own["doc_id"].eqNullSafe(groups[f"`id-{tag}`"]) & own[f"`{name}`"].eqNullSafe(groups[f"`of-{tag}`"]))
    alone = F.col(f"`{cluster}`").isNull()
    one = Window.partitionBy(f"`{cluster}`", F.when(alone, F.struct(own["doc_id"], own["text"]))).orderBy(F.asc_nulls_last(own["doc_id"]), f"`{name}`", own["text"])
    own = own.withColumn(nth, F.row_number().over(one)).where((F.col(f"`{nth}`") == 1) & (alone | own["doc_id"].eqNullSafe(F.col(f"`{first}`"))))
    return out.unionByName(own.select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts stay, repeated rows stay or go together."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars is that of the new text, null texts stay null."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mix, in that order within and across partitions; no row goes."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the rejected doc_ids; a row without a doc_id stays."""
    gone = materialize(rejected.select("doc_id").where("doc_id is not null").distinct(), "rejected")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Perplexities, signatures and schedules aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
