"""Edge time-MMRs in rounds: each folds the nodes of an edge in chunks, six levels at a time.

A chunk of 64 neighbours is one row; its levels are array expressions, so that a round
costs one shuffle. A hot edge is no bottleneck: its chunks are spread over tasks, and
the number of rounds is the logarithm of the largest edge to base 64.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.operators.tables import running, stored

FOLDED = 6  # levels of a round


def numbered(entries: DataFrame) -> DataFrame:
    """(eid, tid, start_ts, end_ts, j): places of the entries of an edge, whose ranges may lie in many tasks."""
    rows = running(entries.select("eid", "tid", "start_ts", "end_ts"), ["start_ts", "end_ts", "tid"], {"j": "1L"}, ["eid"], label="mmr-order")
    return rows.withColumn("j", F.col("j") - 1)


def mmr_leaves(entries: DataFrame) -> DataFrame:
    """(eid, j, hash, lo, hi): entries of each edge by start, end and trajectory."""
    return leaves_of(numbered(entries))


def leaves_of(rows: DataFrame) -> DataFrame:
    """Leaves in the order that rows state by j."""
    hashed = F.expr(d.sha("tid", d.u32("start_ts"), d.u32("end_ts")))
    return rows.select("eid", "j", hashed.alias("hash"), F.col("start_ts").alias("lo"), F.col("end_ts").alias("hi"))


def folded(leaves: DataFrame, height: int) -> DataFrame:
    """(eid, h, j, hash, lo, hi) of the FOLDED levels above nodes (eid, j, hash, lo, hi) of a height.

    A node has both children within its chunk, whose size is a power of two.
    """
    size = 1 << FOLDED
    rows = leaves.groupBy("eid", F.expr(f"j div {size}").alias("chunk")).agg(F.expr("transform(array_sort(collect_list(struct(j, hash, lo, hi))), x -> struct(x.hash AS hash, x.lo AS lo, x.hi AS hi))").alias("l0"))
    pair = d.sha("l[2 * i].hash", d.u32("l[2 * i].lo"), d.u32("l[2 * i].hi"), "l[2 * i + 1].hash", d.u32("l[2 * i + 1].lo"), d.u32("l[2 * i + 1].hi"))
    for h in range(FOLDED):
        own = lambda x, h=h: x.replace("l[", f"l{h}[")
        up = f"transform(sequence(0, size(l{h}) div 2 - 1), i -> struct({own(pair)} AS hash, least({own('l[2 * i].lo, l[2 * i + 1].lo')}) AS lo, greatest({own('l[2 * i].hi, l[2 * i + 1].hi')}) AS hi))"
        rows = rows.withColumn(f"l{h + 1}", F.expr(f"CASE WHEN size(l{h}) > 1 THEN {up} ELSE cast(array() as array<struct<hash:string,lo:bigint,hi:bigint>>) END"))
    every = ", ".join(f"transform(l{h}, (x, i) -> struct(cast({height + h} as bigint) AS h, chunk * {size >> h} + i AS j, x.hash AS hash, x.lo AS lo, x.hi AS hi))" for h in range(1, FOLDED + 1))
    return rows.select("eid", F.inline(F.expr(f"concat({every})")))


def nodes_of(leaves: DataFrame) -> DataFrame:
    """(eid, h, j, pos, hash, lo, hi) for every node over leaves (eid, j, hash, lo, hi); pos is its place in the append-only order."""
    leaves = stored(leaves, "mmr-leaves")
    most = leaves.agg(F.max("j")).first()[0]
    levels, height = [leaves.select("eid", F.lit(0).cast("long").alias("h"), "j", "hash", "lo", "hi")], 0
    while (most or 0) + 1 >> height > 1:
        top = levels[-1].where(F.col("h") == height).drop("h")
        levels.append(stored(folded(top, height), "mmr-levels"))
        height += FOLDED
    last = "((j + 1) * shiftleft(1L, cast(h as int)) - 1)"
    every = reduce(DataFrame.unionByName, levels)
    return every.select("eid", "h", "j", F.expr(f"2 * {last} - cast(bit_count({last}) as bigint) + h").alias("pos"), "hash", "lo", "hi")


def ordered_nodes(entries: DataFrame, order: list[str]) -> DataFrame:
    """Nodes over the entries of each edge in a total order, be it of time or of arrival."""
    own = [c for c in order if c not in ("eid", "tid", "start_ts", "end_ts")]
    rows = running(entries.select("eid", "tid", "start_ts", "end_ts", *own), order, {"j": "1L"}, ["eid"], label="mmr-order")
    return nodes_of(leaves_of(rows.withColumn("j", F.col("j") - 1)))


def mmr_nodes(entries: DataFrame) -> DataFrame:
    """Nodes over the entries of each edge by start, end and trajectory."""
    return nodes_of(mmr_leaves(entries))


def appended_nodes(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """The nodes that entries (eid, tid, start_ts, end_ts, place from 0 among an edge's new ones) add to MMRs.

    Only new leaves and what they complete is hashed; nodes: eid, h, j, hash, lo, hi of the MMRs so far.
    """
    sizes = nodes.where("h = 0").groupBy("eid").agg(F.count("*").alias("k"))
    new = entries.join(sizes, "eid", "left").withColumn("j", F.coalesce("k", F.lit(0)) + F.col("place"))
    level, out, h = stored(leaves_of(new), "mmr-new"), [], 0
    while not level.isEmpty():
        out.append(level.select("eid", F.lit(h).cast("long").alias("h"), "j", "hash", "lo", "hi"))
        old = nodes.where(F.col("h") == h).join(level.where("j % 2 = 1").select("eid", (F.col("j") - 1).alias("j")), ["eid", "j"], "left_semi")
        both = level.select("eid", "j", "hash", "lo", "hi").unionByName(old.select("eid", "j", "hash", "lo", "hi"))
        side = lambda k, c: F.max(F.when(F.col("j") % 2 == k, F.col(c))).alias(f"{c}{k}")
        pair = both.groupBy("eid", F.expr("j div 2").alias("j")).agg(*[side(k, c) for k in (0, 1) for c in ("hash", "lo", "hi")]).where("hash0 is not null and hash1 is not null")
        hashed = F.expr(d.sha("hash0", d.u32("lo0"), d.u32("hi0"), "hash1", d.u32("lo1"), d.u32("hi1")))
        level, h = stored(pair.select("eid", "j", hashed.alias("hash"), F.least("lo0", "lo1").alias("lo"), F.greatest("hi0", "hi1").alias("hi")), "mmr-new"), h + 1
    last = "((j + 1) * shiftleft(1L, cast(h as int)) - 1)"
    every = reduce(DataFrame.unionByName, out) if out else nodes.limit(0)
    return every.select("eid", "h", "j", F.expr(f"2 * {last} - cast(bit_count({last}) as bigint) + h").alias("pos"), "hash", "lo", "hi")


def append_or_rebuild(nodes: DataFrame, base: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes of the edges that delta touches, sorted by time, and (eid, rebuilt) for each of them.

    An edge whose new entries all start no earlier than its last one grows at its end; any other
    is built anew. base, delta: eid, tid, start_ts, end_ts.
    """
    order = ["start_ts", "end_ts", "tid"]
    last = base.groupBy("eid").agg(F.max(F.struct(*order)).alias("last"))
    first = delta.groupBy("eid").agg(F.min(F.struct(*order)).alias("first"))
    how = stored(first.join(last, "eid", "left").select("eid", F.coalesce(F.col("first") < F.col("last"), F.lit(False)).alias("rebuilt")), "mmr-how")
    anew, grows = how.where("rebuilt").select("eid"), how.where("NOT rebuilt").select("eid")
    rows = running(delta.join(grows, "eid", "left_semi").select("eid", *order), order, {"place": "1L"}, ["eid"], label="mmr-order").withColumn("place", F.col("place") - 1)
    old = nodes.join(grows, "eid", "left_semi")
    grown = old.unionByName(appended_nodes(old, rows))
    return grown.unionByName(mmr_nodes(base.unionByName(delta).join(anew, "eid", "left_semi"))), how
