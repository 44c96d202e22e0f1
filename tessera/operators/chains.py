"""Hash chains over ordered lists, each streamed through one task with one state in memory.

A chain is sequential by definition, so a list isn't split; different lists are
spread over tasks, and a long one only takes longer. Rows reach the fold sorted
by Spark, which spills, and leave it in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d

# Fixed values of the record formats.
ENTRY = "BL-ENTRY-v2"
LIST = "BL-SORTED-LIST-CHAIN-v2"
LIST_TAIL = hashlib.sha256(b"BL-SORTED-LIST-TAIL-v2").hexdigest()
EDGE = "BL-EDGE-v2"
GROUP = "BL-EDGE-GROUP-v2"
GROUP_INIT = hashlib.sha256(b"BL-EDGE-GROUP-INIT-v2").hexdigest()

ENTRY_HASH = d.sha(d.text_hex(ENTRY), "tid", d.u32("start_ts"), d.u32("end_ts"))


def edge_hash(eid: str, count: str, root: str) -> str:
    return d.sha(d.text_hex(EDGE), d.u32(eid), d.u32(count), root)


def list_step(item: bytes, state: bytes) -> bytes:
    return hashlib.sha256(LIST.encode() + item + state).digest()


def group_step(item: bytes, state: bytes) -> bytes:
    return hashlib.sha256(GROUP.encode() + state + item).digest()


def fold(rows: DataFrame, init: str, step, *, descending: bool = False) -> DataFrame:
    """(key, pos, state) after each item of (key, pos, item hex), keys apart, by pos."""
    first, schema = bytes.fromhex(init), rows.select("key", "pos", F.lit("").alias("state")).schema

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, first
        for frame in frames:
            states = []
            for key, item in zip(frame["key"], frame["item"], strict=True):
                state = step(bytes.fromhex(item), state if key == last else first)
                last = key
                states.append(state.hex())
            yield pd.DataFrame({"key": frame["key"], "pos": frame["pos"], "state": states})

    order = F.desc("pos") if descending else F.asc("pos")
    return rows.select("key", "pos", "item").repartition("key").sortWithinPartitions("key", order).mapInPandas(stream, schema)


def list_states(ranked: DataFrame) -> DataFrame:
    """(eid, pos, state): state at pos covers entries pos + 1 to total; that at pos = total is the tail.

    ranked: eid, rank from 1, total, tid, start_ts, end_ts.
    """
    items = ranked.select(F.col("eid").alias("key"), (F.col("rank") - 1).alias("pos"), F.expr(ENTRY_HASH).alias("item"))
    tails = ranked.where("rank = 1").select("eid", F.col("total").alias("pos"), F.lit(LIST_TAIL).alias("state"))
    return fold(items, LIST_TAIL, list_step, descending=True).withColumnRenamed("key", "eid").unionByName(tails)


def group_roots(edges: DataFrame) -> DataFrame:
    """(key, n, state): forward chain of the edge hashes of a group by eid; edges: key, eid, hash."""
    states = fold(edges.selectExpr("key", "eid pos", "hash item"), GROUP_INIT, group_step)
    return states.groupBy("key").agg(F.count("*").alias("n"), F.max_by("state", "pos").alias("state"))
