"""Proofs over the binary tree and the sorted lists of edges, and their verifier.

An edge that meets the rectangle discloses its entries up to the last that starts within
the window, the next one as a witness, and the chain state behind them. The client has
its own copy of the road network. Entries follow their edge's token from the last to the
first, so that the chain is rebuilt with one state in memory.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.functions.dialect import segment_hits
from tessera.operators import chains
from tessera.operators.proofs import ORDER, REPORT, Rejected, hits, in_order, in_order_of_corners, normalized
from tessera.operators.spatial_tree import BOX

# Fixed values of the proof format: token types. Entries are a list of their own in it.
PRUNED_LEAF, PRUNED_INTERNAL, LEAF, INTERNAL = 1, 2, 3, 4
EDGE_OPAQUE, EDGE_PREFIX, ENTRY = 10, 11, 12
MAGIC, VERSION, HEADER = b"BLVO0002", 2, ">8sIQQ"
FORMATS = {
    PRUNED_LEAF: ">ddddI32s", PRUNED_INTERNAL: ">dddd32s32sI32s", LEAF: ">ddddI", INTERNAL: ">ddddI",
    EDGE_OPAQUE: ">II32s", EDGE_PREFIX: ">IIIB32s", ENTRY: ">I32sII",
}
MEETS = "min_lon <= w.max_lon AND max_lon >= w.min_lon AND min_lat <= w.max_lat AND max_lat >= w.min_lat"


def _asked(windows: DataFrame) -> DataFrame:
    return normalized(windows).select("query_id", F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]).alias("w"), F.col("q_start").cast("long"), F.col("q_end").cast("long"))


def proof_tokens(tree: DataFrame, placed: DataFrame, ranked: DataFrame, states: DataFrame, road: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id, order columns, token, body, and tid of entries that overlap the window in time.

    tree, placed: of spatial_tree.binary_tree; ranked: eid, rank, total, tid, start_ts, end_ts;
    states: of chains.list_states; road: eid, ulon, ulat, vlon, vlat.
    """
    body = lambda *xs: F.expr(f"lower(concat({', '.join(xs)}))")
    kids = tree.select(F.expr("substr(path, 1, length(path) - 1)").alias("parent"), F.expr("right(path, 1)").alias("side"), "hash").where("side <> ''")
    kids = kids.groupBy(F.col("parent").alias("path")).agg(F.max(F.when(F.col("side") == "0", F.col("hash"))).alias("h0"), F.max(F.when(F.col("side") == "2", F.col("hash"))).alias("h2"))
    seen = tree.join(kids, "path", "left").join(_asked(windows)).withColumn("open", F.expr(MEETS))
    parents = seen.where("open AND NOT leaf").select("query_id", F.col("path").alias("parent"))
    below = seen.where("path <> ''").withColumn("parent", F.expr("substr(path, 1, length(path) - 1)")).join(parents, ["query_id", "parent"], "left_semi")
    seen = seen.where("path = ''").unionByName(below.drop("parent"))
    box = [d.f64(c) for c in BOX]
    n = d.u32("n_edges")
    kind = F.when(F.col("open"), F.when(F.col("leaf"), LEAF).otherwise(INTERNAL)).otherwise(F.when(F.col("leaf"), PRUNED_LEAF).otherwise(PRUNED_INTERNAL))
    content = F.when(F.col("open"), body(*box, n)).when(F.col("leaf"), body(*box, n, "grp")).otherwise(body(*box, "h0", "h2", n, "grp"))

    def rows(df: DataFrame, of_node: int, eid: str, phase: int, pos: str, token: F.Column, content: F.Column, tid: F.Column) -> DataFrame:
        return df.select("query_id", F.concat("path", F.lit("3")).alias("place"), F.lit(of_node).alias("of_node"), F.expr(f"cast({eid} as bigint)").alias("eid"), F.lit(phase).alias("phase"), F.expr(f"cast({pos} as bigint)").alias("pos"), token.cast("int").alias("token"), content.alias("body"), tid.alias("tid"))

    none = F.lit(None).cast("string")
    out = [rows(seen, 1, "0", 0, "0", kind, content, none)]
    opened = seen.where("open").select("query_id", "path", "w", "q_start", "q_end")
    edges = placed.join(opened, "path").join(road, "eid").withColumn("hit", F.expr(segment_hits("ulon", "ulat", "vlon", "vlat", "w")))
    out.append(rows(edges.where("NOT hit"), 0, "eid", 0, "0", F.lit(EDGE_OPAQUE), body(d.u32("eid"), d.u32("k"), "root"), none))
    wide = edges.where("hit").select("query_id", "path", "eid", F.col("k").alias("total"), "root", "q_start", "q_end")
    shown = wide.drop("total").join(ranked, "eid").where("start_ts <= q_end").groupBy("query_id", "eid").agg(F.count("*").alias("n_shown"))
    wide = wide.join(shown, ["query_id", "eid"], "left").fillna(0, ["n_shown"]).withColumn("more", F.expr("if(n_shown < total, 1, 0)"))
    ends = states.select("eid", F.col("pos").alias("rest"), "state")
    wide = wide.withColumn("rest", F.col("n_shown") + F.col("more"))
    heads = wide.join(ends, ["eid", "rest"], "left").withColumn("state", F.coalesce("state", F.lit(chains.LIST_TAIL)))
    out.append(rows(heads, 0, "eid", 1, "0", F.lit(EDGE_PREFIX), body(d.u32("eid"), d.u32("total"), d.u32("n_shown"), "lpad(hex(more), 2, '0')", "state"), none))
    given = wide.select("query_id", "path", "eid", "rest", "q_start", "q_end").join(ranked, "eid").where("rank <= rest")
    matched = F.when(F.expr("start_ts <= q_end AND end_ts >= q_start"), F.col("tid"))
    out.append(rows(given, 0, "eid", 2, "-rank", F.lit(ENTRY), body(d.u32("eid"), "tid", d.u32("start_ts"), d.u32("end_ts")), matched))
    return reduce(DataFrame.unionByName, out)


class Verifier:
    """Takes tokens one by one, with the edge's own geometry test by the client's road copy."""

    def __init__(self, box: tuple, q_start: int, q_end: int) -> None:
        self.box, self.start, self.end = in_order_of_corners(box), q_start, q_end
        self.nodes: list[bytes] = []
        self._clear()
        self.left, self.n_results = 0, 0

    def _clear(self) -> None:
        self.group, self.n_edges, self.last_eid = bytes.fromhex(chains.GROUP_INIT), 0, -1

    def _need(self, held: bool, why: str) -> None:
        if not held:
            raise Rejected(why)

    def take(self, token: int, body: bytes, hit: bool | None) -> None:
        self._need(self.start <= self.end, "the query ends before its start")
        self._need(token in FORMATS and len(body) == struct.calcsize(FORMATS[token]), "malformed token")
        v = struct.unpack(FORMATS[token], body)
        self._need((token == ENTRY) == (self.left > 0), "entries and lists don't fit")
        if token == ENTRY:
            self._entry(v)
        elif token in (EDGE_OPAQUE, EDGE_PREFIX):
            self._need(hit is not None and v[0] > self.last_eid, "an unknown edge, or edges out of order")
            self.last_eid = v[0]
            self._need(hit == (token == EDGE_PREFIX), "an edge that matters isn't opened, or one is in vain")
            if token == EDGE_OPAQUE:
                self._edge(v[1], v[2])
                return
            _, self.total, shown, more, self.state = v
            self._need(more in (0, 1) and shown <= self.total and more == (shown < self.total), "an edge without its witness")
            self._need(shown + more < self.total or self.state.hex() == chains.LIST_TAIL, "a list has a wrong tail")
            self.left, self.witness, self.before = shown + more, bool(more), None
            if not self.left:
                self._edge(self.total, self.state)
        else:
            self._node(token, v)

    def _entry(self, v: tuple) -> None:
        eid, tid, start, end = v
        self._need(eid == self.last_eid, "an entry of another edge")
        if self.witness:
            self._need(start > self.end, "the witness starts within the window")
        else:
            self._need(start <= self.end and (self.before is None or start <= self.before), "entries out of order")
            self.n_results += end >= self.start
        self.before, self.witness, self.left = start, False, self.left - 1
        item = hashlib.sha256(chains.ENTRY.encode() + tid + struct.pack(">II", start, end)).digest()
        self.state = chains.list_step(item, self.state)
        if not self.left:
            self._edge(self.total, self.state)

    def _edge(self, count: int, root: bytes) -> None:
        own = hashlib.sha256(chains.EDGE.encode() + struct.pack(">II", self.last_eid, count) + root).digest()
        self.group, self.n_edges = chains.group_step(own, self.group), self.n_edges + 1

    def _node(self, token: int, v: tuple) -> None:
        box, rest = struct.pack(">dddd", *v[:4]), v[4:]
        meets = v[0] <= self.box[2] and v[2] >= self.box[0] and v[1] <= self.box[3] and v[3] >= self.box[1]
        self._need(v[0] <= v[2] and v[1] <= v[3], "a box has its corners reversed")
        if token in (PRUNED_LEAF, PRUNED_INTERNAL):
            self._need(not meets and not self.n_edges, "a pruned node meets the window")
            below, n, group = b"".join(rest[:-2]), rest[-2], rest[-1]
        else:
            self._need(meets, "a node is opened in vain")
            self._need(rest[0] == self.n_edges, "a node's edges differ from its record")
            below, n, group = b"", self.n_edges, self.group
            if token == INTERNAL:
                self._need(len(self.nodes) >= 2, "a node lacks children")
                below, self.nodes = b"".join(self.nodes[-2:]), self.nodes[:-2]
            self._clear()
        domain = b"BL-SPATIAL-INTERNAL-v2" if below else b"BL-SPATIAL-LEAF-v2"
        self.nodes.append(hashlib.sha256(domain + box + below + struct.pack(">I", n) + group).digest())

    def finish(self, root: bytes) -> int:
        self._need(self.start <= self.end, "the query ends before its start")
        self._need(len(self.nodes) == 1 and not self.left and not self.n_edges, "the proof is incomplete")
        self._need(self.nodes[0] == root, "the root differs")
        return self.n_results


def verify_report(tokens: DataFrame, road: DataFrame, windows: DataFrame, root: str) -> DataFrame:
    """A row for each query, as proofs.verify_report; road is the client's own copy."""
    trusted = bytes.fromhex(root)
    own = tokens.join(_asked(windows), "query_id").join(road.select("eid", "ulon", "ulat", "vlon", "vlat"), "eid", "left")
    is_edge = F.col("token").isin(EDGE_OPAQUE, EDGE_PREFIX)
    own = own.withColumn("hit", F.when(is_edge & F.col("ulon").isNotNull(), F.expr(segment_hits("ulon", "ulat", "vlon", "vlat", "w")).cast("int")).otherwise(-1))

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, check, why, n = None, None, None, 0

        def report() -> list[tuple]:
            reason = why
            if check is not None and reason is None:
                try:
                    check.finish(trusted)
                except Rejected as e:
                    reason = str(e)
            return [] if check is None else [(query, reason is None, reason, n, check.n_results)]

        columns = ["query_id", "accepted", "reason", "n_tokens", "n_results"]
        for frame in frames:
            done = []
            for q, token, body, hit, w, lo, hi in zip(*(frame[c] for c in ("query_id", "token", "body", "hit", "w", "q_start", "q_end")), strict=True):
                if q != query:
                    done += report()
                    query, why, n, check = q, None, 0, Verifier(tuple(w[c] for c in BOX), lo, hi)
                n += 1
                if why is None:
                    try:
                        check.take(token, bytes.fromhex(body), None if hit < 0 else bool(hit))
                    except Rejected as e:
                        why = str(e)
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(report(), columns=columns)

    return in_order(own).select("query_id", "token", "body", "hit", "w", "q_start", "q_end").mapInPandas(stream, REPORT)


def disclosed(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id and tid of the disclosed entries that overlap their window, from the tokens' own bytes."""
    at = lambda k: F.conv(F.substring("body", k, 8), 16, 10).cast("long")
    entries = tokens.where(F.col("token") == ENTRY).select("query_id", F.substring("body", 9, 64).alias("tid"), at(73).alias("start"), at(81).alias("end"))
    return entries.join(windows.select("query_id", "q_start", "q_end"), "query_id").where("start <= q_end AND end >= q_start").select("query_id", "tid").distinct()


def sizes(tokens: DataFrame) -> DataFrame:
    """Bytes of each query's proof file with its entries, and their numbers."""
    entry = F.col("token") == ENTRY
    size = F.when(entry, struct.calcsize(FORMATS[ENTRY])).otherwise(1 + F.expr("length(body) div 2"))
    return tokens.groupBy("query_id").agg((F.lit(struct.calcsize(HEADER)) + F.sum(size)).alias("proof_bytes"), F.count_if(~entry).alias("n_tokens"), F.count_if(entry).alias("n_entries"))


def save(tokens: DataFrame, query_id: str, path: str) -> None:
    """A query's proof file for its client: tokens, then the entries of each list in their order."""
    own = tokens.where(F.col("query_id") == query_id)
    entry = F.col("token") == ENTRY
    n = own.agg(F.count_if(~entry), F.count_if(entry)).first()
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, MAGIC, VERSION, n[0], n[1]))
        for r in own.where(~entry).orderBy(*ORDER).toLocalIterator():
            f.write(bytes([r["token"]]) + bytes.fromhex(r["body"]))
        for r in own.where(entry).orderBy("place", "of_node", "eid", F.desc("pos")).toLocalIterator():
            f.write(bytes.fromhex(r["body"]))


def _backwards(f, start: int, n: int, size: int, block: int = 4096) -> Iterator[bytes]:
    """The n records from `start` on, last first, a block in memory at a time."""
    for high in range(n, 0, -block):
        low = max(0, high - block)
        f.seek(start + low * size)
        data = f.read((high - low) * size)
        for k in range(high - low - 1, -1, -1):
            yield data[k * size : (k + 1) * size]


def verify_file(path: str, window: tuple, road: Mapping[int, tuple], root: str) -> set[str]:
    """Trajectory ids of a proof file that holds; raises Rejected otherwise.

    window: box, q_start, q_end; road: the client's own copy, eid: (ulon, ulat, vlon, vlat).
    """
    *box, q_start, q_end = window
    check, ids, size = Verifier(tuple(box), q_start, q_end), set(), struct.calcsize(FORMATS[ENTRY])
    with open(path, "rb") as f, open(path, "rb") as g:

        def exactly(n: int) -> bytes:
            data = f.read(n)
            if len(data) != n:
                raise Rejected("a file ends early")
            return data

        magic, version, n_tokens, n_entries = struct.unpack(HEADER, exactly(struct.calcsize(HEADER)))
        if (magic, version) != (MAGIC, VERSION):
            raise Rejected("not a file of this format")
        at = entries = os.path.getsize(path) - n_entries * size
        for _ in range(n_tokens):
            token = exactly(1)[0]
            if token not in FORMATS or token == ENTRY:
                raise Rejected("malformed token")
            body = exactly(struct.calcsize(FORMATS[token]))
            hit = None
            if token in (EDGE_OPAQUE, EDGE_PREFIX):
                ends = road.get(struct.unpack(">I", body[:4])[0])
                hit = None if ends is None else hits(*ends, tuple(box))
            check.take(token, body, hit)
            if token == EDGE_PREFIX:
                n = check.left
                if at + n * size > entries + n_entries * size:
                    raise Rejected("entries are missing")
                for record in _backwards(g, at, n, size):
                    check.take(ENTRY, record, None)
                    _, tid, start, end = struct.unpack(FORMATS[ENTRY], record)
                    if start <= q_end and end >= q_start:
                        ids.add(tid.hex())
                at += n * size
        if f.tell() != entries or at != entries + n_entries * size:
            raise Rejected("a file goes on after its end")
    check.finish(bytes.fromhex(root))
    return ids
