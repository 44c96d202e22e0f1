"""Mixing sources to target weights by Pfair scheduling.

A source with weight w (exact, of a sum of 1) may place its block i no earlier than slot
floor(i / w) and must place it before slot ceil((i + 1) / w). Serving the released
block with the earliest deadline keeps every source within one block of its share
at every slot, however many there are. The driver computes the slots of blocks, one
number each; documents are only given their places. When a source has no block left,
the others go on with their weights scaled up, so that nothing is dropped.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import materialize

NEW = ["mix_source", "mix_block", "mix_slot", "mix_position"]
#: Schedules of up to so many numbers (16 MB) are broadcast; larger ones are joined by source and run of blocks.
BROADCAST_NUMBERS = 2_000_000
#: Blocks of a source in one row of the schedule.
RUN = 4096


def shares(weights: dict[str, float], cycle: int) -> dict[str, int]:
    """Whole slots of a cycle, at least one each, by largest remainders: close to the exact weights, which schedules use."""
    total = sum(weights.values())
    exact = {s: Fraction(w) / Fraction(total) * cycle for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    k = 0
    while sum(out.values()) < cycle:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > cycle:
        out[max(out, key=lambda s: (out[s] - exact[s], out[s], s))] -= 1
    return out


def until_one_is_through(left: dict[str, int], weights: dict[str, float]) -> dict[str, list[int]]:
    """Earliest deadline first by the exact weights, up to the slot at which a source has no block left: slots of each."""
    exact = {s: Fraction(weights[s]) for s in left}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * scale) for s, x in exact.items()}
    total = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(left)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in left}
    at = 0
    while True:
        while waiting and waiting[0][0] <= at:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // parts[s]), s, i))
        deadline, s, i = heapq.heappop(ready)
        assert deadline > at
        out[s].append(at)
        if i + 1 == left[s]:
            return out
        heapq.heappush(waiting, ((i + 1) * total // parts[s], s, i + 1))
        at += 1


def places(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slot of every block of each source; phases follow one another, and each ends when a source has no block left."""
    left, out, begin = dict(blocks), {s: array("q") for s in blocks}, 0
    while left := {s: n for s, n in left.items() if n > 0}:
        own = until_one_is_through(left, weights) if len(left) > 1 else {s: range(n) for s, n in left.items()}
        for s, slots in own.items():
            out[s].extend(begin + x for x in slots)
            left[s] -= len(slots)
        begin += sum(map(len, own.values()))
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block: int = 64, alpha: float = 0.5, seed: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """The rows of docs with mix_source, mix_block (of its source), mix_slot and mix_position.

    weights: target weight of each source, above 0; a source without one gets the
    least of them. Without weights, a source weighs its row count to the power
    `alpha`. A block is `block` rows of a source in the order of a seeded hash of
    the id; the last one of a source may be shorter. Sorting by mix_position gives
    the mix: before every slot, a source that still has blocks is less than one
    block from its share of the slots of the phase.

    A null source is a source of its own, named ''. Rows that repeat an id or tie
    otherwise all get places of their own. An empty table gives an empty result.
    Columns of docs with the names of the new ones are replaced. The driver holds
    one number for each block, never anything for each row.
    """
    spark = docs.sparkSession
    docs = docs.drop(*NEW)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    h = F.xxhash64(F.lit(seed), F.col("id"))
    n_rows = base.count()
    buckets = max(16, -(-n_rows // bucket_rows))
    base = base.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sizes = materialize(base.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    counts = {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum("n")).collect()}
    w = {s: float(n) ** alpha for s, n in counts.items()} if weights is None else {s: float(weights.get(s, min(weights.values()))) for s in counts}
    if any(x <= 0 for x in w.values()):
        raise ValueError("target weights must be above 0")
    slots = places({s: -(-n // block) for s, n in counts.items()}, w)

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "id")
    ranked = base.withColumn("k", F.row_number().over(within)).join(offsets, ["source", "bucket"])
    rank = F.col("offset") + F.col("k") - 1
    ranked = ranked.select("row", "source", F.floor(rank / block).cast("long").alias("i"), F.pmod(rank, F.lit(block)).alias("inside"))

    spans = [(s, k // RUN, own[k : k + RUN].tolist()) for s, own in slots.items() for k in range(0, len(own), RUN)]
    table = spark.createDataFrame(spans, "of string, run long, slots array<long>")
    if sum(map(len, slots.values())) <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    placed = ranked.withColumn("of_run", F.floor(F.col("i") / RUN)).join(table, (F.col("of") == F.col("source")) & (F.col("run") == F.col("of_run")))
    slot = F.element_at("slots", (F.pmod("i", F.lit(RUN)) + 1).cast("int"))
    return placed.select("row.*", F.col("source").alias(NEW[0]), F.col("i").alias(NEW[1]), slot.alias(NEW[2]), (slot * block + F.col("inside")).alias(NEW[3]))
