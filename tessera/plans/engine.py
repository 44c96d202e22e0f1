"""Runs lists of named SQL expressions in Spark, making by operators what needs more than one statement.

The relations of a folder of tables are derived once a session and stored, as an index's
input is parsed once; queries, trees and proofs then read them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.dialect import Spark
from tessera.operators.index_sql import Levels, Made, Mmr, Rank
from tessera.operators.mmr import ordered_nodes
from tessera.operators.tables import hadoop_path, ranked, stored
from tessera.plans.world import world

#: Relations of plans.world that are stored; the others are cheap over these.
KEPT = ("nodes", "seg", "numbered", "edges", "segments", "ids", "entries", "points")
_kept: dict[tuple, DataFrame] = {}


def fresh(spark: SparkSession, frame: DataFrame) -> tuple:
    """Names, lengths and times of a table's files: what was derived from it holds while these stay."""
    out = []
    for name in sorted(frame.inputFiles()):
        path, files = hadoop_path(spark, name)
        status = files.getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def relation(spark: SparkSession, events: DataFrame, name: str, state: tuple) -> DataFrame:
    """A relation of plans.world over events, made when first asked for."""
    key = (spark.sparkContext.applicationId, state, name)
    if key in _kept:
        path, files = hadoop_path(spark, _kept[key].inputFiles()[0]) if _kept[key].inputFiles() else (None, None)
        if path is not None and files.exists(path):
            return _kept[key]
    ctes = world(Spark)
    made = dict(ctes)[name]
    if isinstance(made, Rank):
        out = ranked(evaluate(spark, ctes, f"SELECT {made.select} FROM {made.source}", events, state), made.order.split(", "), label=name)
    else:
        own = [(n, s) for n, s in ctes if n != name]
        out = evaluate(spark, own, made, events, state)
    _kept[key] = stored(out, name)
    return _kept[key]


def levels(spark: SparkSession, leaves: DataFrame, up) -> DataFrame:
    """(h, and the columns of leaves) of all levels of a tree, up to that with one node."""
    every = [stored(leaves, "level")]
    while every[-1].count() > 1:
        every.append(stored(spark.sql(up("{below}"), below=every[-1]), "level"))
    return reduce(DataFrame.unionByName, (x.selectExpr(f"CAST({h} AS BIGINT) AS h", "*") for h, x in enumerate(every)))


def needed(ctes: list[tuple[str, str]], body: str, given) -> list[tuple[str, str]]:
    """The expressions that the body needs, directly or not; those given need nothing."""
    out, text = [], body
    for name, sql in reversed(ctes):
        if re.search(rf"\b{name}\b", text):
            out.append((name, sql))
            text += " " + ("" if name in given else sql.source if isinstance(sql, Made) else sql)
    return out[::-1]


def evaluate(spark: SparkSession, ctes: list[tuple[str, str]], body: str, events: DataFrame | None = None, state: tuple | None = None, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The body over expressions, of which those of plans.world come from events and those given are DataFrames."""
    base = dict(world(Spark)) if events is not None else {}
    kept = {n for n, s in ctes if n in KEPT and base.get(n) == s}
    frames, done, given = dict(given or {}), [], given or {}

    def run(text: str) -> DataFrame:
        sql = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in needed(done, text, ())) + " " + text if needed(done, text, ()) else text
        used = frames | ({"events": events} if events is not None else {})
        return spark.sql(sql, **{k: v for k, v in used.items() if "{" + k + "}" in sql})

    for name, sql in needed(ctes, body, kept | set(given)):
        if name in given:
            pass
        elif name in kept:
            frames[name] = relation(spark, events, name, state)
        elif isinstance(sql, Rank):
            frames[name] = ranked(run(f"SELECT {sql.select} FROM {sql.source}"), sql.order.split(", "), label=name)
        elif isinstance(sql, Mmr):
            frames[name] = ordered_nodes(run(f"SELECT * FROM {sql.source}"), sql.order.split(", "))
        elif isinstance(sql, Levels):
            frames[name] = levels(spark, run(f"SELECT * FROM {sql.source}"), sql.up)
        elif re.search(r"OVER \(ORDER BY", sql):
            raise ValueError(f"{name} ranks all rows in one task")
        done.append((name, "SELECT * FROM {" + name + "}" if name in frames else sql))
    return run(body)


def statement(spark: SparkSession, sf_dir: str, ctes: list[tuple[str, str]], body: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The body over the events of a folder."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate(spark, ctes, body, events, fresh(spark, events), given)
