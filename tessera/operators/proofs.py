"""Proof tokens of window queries over the weighted tree and the edge MMRs, and their verifier.

Tokens are rows in the order of a recursive walk, children first, whose bodies are the
records of the proof file in hex. Many windows are answered by one plan. The verifier
reads a proof once, in order, with a stack as deep as the tree.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.functions.dialect import overlaps, segment_hits
from tessera.operators.spatial_tree import BOX, EMPTY_HI, EMPTY_LO

# Fixed values of the proof format: token types, file magics, version.
NODE_PRUNED, NODE_LEAF, NODE_INTERNAL = 1, 3, 4
EDGE_OPAQUE, EDGE_EXPANDED = 10, 11
MMR_PRUNED, RESULT_SLOT, MMR_INTERNAL, MMR_ROOT = 20, 22, 23, 24
PROOF_MAGIC, RESULT_MAGIC, VERSION = b"CMVO0002", b"VSET0002", 2
FORMATS = {
    NODE_PRUNED: ">32sddddII", NODE_LEAF: ">ddddIII", NODE_INTERNAL: ">ddddII",
    EDGE_OPAQUE: ">IddddIII32s", EDGE_EXPANDED: ">IddddIII",
    MMR_PRUNED: ">32sII", RESULT_SLOT: ">", MMR_INTERNAL: ">", MMR_ROOT: ">I",
}
WINDOW = [*BOX, "q_start", "q_end"]
ORDER = ["place", "of_node", "eid", "phase", "pos"]


def normalized(windows: DataFrame) -> DataFrame:
    """windows with the corners of their boxes in order."""
    low = {c: F.least(c, c.replace("min", "max")).alias(c) for c in BOX[:2]}
    high = {c: F.greatest(c, c.replace("max", "min")).alias(c) for c in BOX[2:]}
    return windows.select(*[(low | high).get(c, F.col(c)) for c in windows.columns])


def proof_tokens(tree: DataFrame, records: DataFrame, mmr: DataFrame, leaves: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id, the order columns, token, body, and tid, start_ts, end_ts of result slots.

    tree, records: of spatial_tree.sem_tree; mmr: mmr.mmr_nodes; leaves: mmr.numbered;
    windows: query_id, box, q_start, q_end, a stated set of queries.
    """
    w = normalized(windows).select("query_id", *[F.col(c).alias(f"w_{c}") for c in BOX], "q_start", "q_end")
    misses = f"NOT (min_lon <= w_max_lon AND max_lon >= w_min_lon AND min_lat <= w_max_lat AND max_lat >= w_min_lat) OR (lo = {EMPTY_LO} AND hi = {EMPTY_HI}) OR NOT {overlaps('lo', 'hi', 'q_start', 'q_end')}"
    seen = tree.join(w).withColumn("open", F.expr(f"path = '' OR NOT ({misses})"))
    parents = seen.where("open AND NOT leaf").select("query_id", F.col("path").alias("parent"))
    child = seen.where("path <> ''").withColumn("parent", F.expr("substr(path, 1, length(path) - 1)")).join(parents, ["query_id", "parent"], "left_semi")
    seen = seen.where("path = ''").unionByName(child.drop("parent"))
    box, time = [d.f64(c) for c in BOX], [d.u32("lo"), d.u32("hi")]
    body = lambda *xs: F.expr(f"lower(concat({', '.join(xs)}))")
    slot = [F.lit(None).cast(t).alias(c) for c, t in (("tid", "string"), ("start_ts", "long"), ("end_ts", "long"))]

    def rows(df: DataFrame, of_node: int, eid: str, phase: int, pos: str, token: F.Column, content: F.Column, more=slot) -> DataFrame:
        return df.select("query_id", F.concat("path", F.lit("3")).alias("place"), F.lit(of_node).alias("of_node"), F.expr(f"cast({eid} as bigint)").alias("eid"), F.lit(phase).alias("phase"), F.expr(f"cast({pos} as bigint)").alias("pos"), token.cast("int").alias("token"), content.alias("body"), *more)

    kind = F.when(~F.col("open"), NODE_PRUNED).when(F.col("leaf"), NODE_LEAF).otherwise(NODE_INTERNAL)
    content = F.when(~F.col("open"), body("hash", *box, *time)).when(F.col("leaf"), body(*box, *time, d.u32("n_edges"))).otherwise(body(*box, *time))
    out = [rows(seen, 1, "0", 0, "0", kind, content)]

    opened = seen.where("open AND leaf").select("query_id", "path", *[f"w_{c}" for c in BOX], "q_start", "q_end")
    edges = records.join(opened, "path").withColumn("w", F.struct(*[F.col(f"w_{c}").alias(c) for c in BOX]))
    needed = f"k > 0 AND {overlaps('lo', 'hi', 'q_start', 'q_end')} AND {segment_hits('ulon', 'ulat', 'vlon', 'vlat', 'w')}"
    edges = edges.withColumn("needed", F.expr(needed))
    geometry = [d.u32("eid"), *[d.f64(c) for c in ("ulon", "ulat", "vlon", "vlat")], d.u32("k"), *time]
    out.append(rows(edges, 0, "eid", 2, "0", F.when(F.col("needed"), EDGE_EXPANDED).otherwise(EDGE_OPAQUE), F.when(F.col("needed"), body(*geometry)).otherwise(body(*geometry, "root"))))

    wide = edges.where("needed").select("query_id", "path", "eid", "k", "q_start", "q_end")
    out.append(rows(wide, 0, "eid", 1, "0", F.lit(MMR_ROOT), body(d.u32("k"))))
    nodes = mmr.join(wide, "eid").withColumn("meets", F.expr(overlaps("lo", "hi", "q_start", "q_end")))
    nodes = nodes.withColumn("ph", F.col("h") + 1).withColumn("pj", F.expr("j div 2"))
    peak = "(pj + 1) * shiftleft(1L, cast(ph as int)) > k"
    above = nodes.where("meets AND h > 0").select("query_id", "eid", F.col("h").alias("ph"), F.col("j").alias("pj"))
    nodes = nodes.where(peak).unionByName(nodes.where(f"NOT {peak}").join(above, ["query_id", "eid", "ph", "pj"], "left_semi").select(nodes.columns))
    out.append(rows(nodes.where("NOT meets OR h > 0"), 0, "eid", 0, "pos", F.when(~F.col("meets"), MMR_PRUNED).otherwise(MMR_INTERNAL), F.when(~F.col("meets"), body("hash", *time)).otherwise(F.lit(""))))
    hits = nodes.where("meets AND h = 0").join(leaves, ["eid", "j"])
    out.append(rows(hits, 0, "eid", 0, "pos", F.lit(RESULT_SLOT), F.lit(""), ["tid", "start_ts", "end_ts"]))
    return reduce(DataFrame.unionByName, out)


def in_order(tokens: DataFrame) -> DataFrame:
    """Tokens of a query together and in proof order; the order of text is that of bytes."""
    return tokens.repartition("query_id").sortWithinPartitions("query_id", *ORDER)


class Rejected(ValueError):
    """A proof that doesn't show that its results are right and complete."""


def hits(x0: float, y0: float, x1: float, y1: float, box: tuple) -> bool:
    """As dialect.segment_hits, with the same arithmetic."""
    low, high = 0.0, 1.0
    for p, q, least, most in ((x0, x1, box[0], box[2]), (y0, y1, box[1], box[3])):
        step = q - p
        if step == 0.0:
            if not least <= p <= most:
                return False
            continue
        a, b = (least - p) / step, (most - p) / step
        low, high = max(low, min(a, b)), min(high, max(a, b))
    return low <= high


def in_order_of_corners(box: tuple) -> tuple:
    x0, y0, x1, y1 = box
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


class Verifier:
    """Takes tokens one by one; finish() compares the rebuilt root with the trusted one."""

    def __init__(self, box: tuple, q_start: int, q_end: int) -> None:
        self.box, self.start, self.end = in_order_of_corners(box), q_start, q_end
        self.nodes: list[tuple] = []
        self.mmr: list[tuple] = []
        self.found: list[tuple] = []
        self.edge_root: tuple | None = None
        self.block, self.in_leaf, self.last_eid, self.span, self.last = hashlib.sha256(), 0, -1, (EMPTY_LO, EMPTY_HI), 0
        self.n_results = 0

    def _meets(self, lo: int, hi: int) -> bool:
        return hi >= self.start and lo <= self.end

    def _need(self, held: bool, why: str) -> None:
        if not held:
            raise Rejected(why)

    def take(self, token: int, body: bytes, entry: tuple | None = None) -> None:
        self._need(self.start <= self.end, "the query ends before its start")
        self._need(token in FORMATS and len(body) == struct.calcsize(FORMATS[token]), "malformed token")
        v, self.last = struct.unpack(FORMATS[token], body), token
        if token in (NODE_PRUNED, NODE_LEAF, NODE_INTERNAL):
            self._need(not self.mmr and self.edge_root is None, "edge proof without its record")
            self._node(token, v, body)
        elif token in (EDGE_OPAQUE, EDGE_EXPANDED):
            self._edge(token, v, body)
        else:
            self._need(self.edge_root is None, "edge proof without its record")
            self._part(token, v, entry)

    def _part(self, token: int, v: tuple, entry: tuple | None) -> None:
        if token == MMR_PRUNED:
            self._need(v[1] <= v[2], "a part ends before its start")
            self._need(not self._meets(v[1], v[2]), "a pruned part meets the window")
            self.mmr.append(v)
        elif token == RESULT_SLOT:
            self._need(entry is not None, "a result is missing")
            eid, tid, lo, hi = entry
            self._need(len(tid) == 32 and lo <= hi, "a result ends before its start")
            self._need(self._meets(lo, hi), "a result misses the window")
            self._need(not self.found or self.found[0] == eid, "results of two edges in one")
            self.found = [eid]
            self.n_results += 1
            self.mmr.append((hashlib.sha256(tid + struct.pack(">II", lo, hi)).digest(), lo, hi))
        elif token == MMR_INTERNAL:
            self._need(len(self.mmr) >= 2, "a part lacks children")
            right, left = self.mmr.pop(), self.mmr.pop()
            self.mmr.append((hashlib.sha256(struct.pack(">32sII32sII", *left, *right)).digest(), min(left[1], right[1]), max(left[2], right[2])))
        else:
            self._need(len(self.mmr) == v[0].bit_count() > 0, "wrong number of peaks")
            root = hashlib.sha256(struct.pack(">I", v[0]) + b"".join(struct.pack(">32sII", *p) for p in self.mmr)).digest()
            self.edge_root = v[0], min(p[1] for p in self.mmr), max(p[2] for p in self.mmr), root
            self.mmr = []

    def _edge(self, token: int, v: tuple, body: bytes) -> None:
        eid, *ends, k, lo, hi = v[:8]
        self._need(not self.mmr and eid > self.last_eid, "edges out of order")
        self._need(k == 0 or (lo != EMPTY_LO and lo <= hi), "an edge ends before its start")
        needed = k > 0 and self._meets(lo, hi) and hits(*ends, self.box)
        if token == EDGE_OPAQUE:
            self._need(self.edge_root is None and not needed, "an edge that matters isn't opened")
            self._need(k > 0 or (lo, hi, v[8]) == (EMPTY_LO, EMPTY_HI, hashlib.sha256(bytes(4)).digest()), "an empty edge has a state")
        else:
            self._need(needed and self.edge_root is not None, "an edge is opened in vain or without proof")
            self._need(self.edge_root[:3] == (k, lo, hi) and self.found in ([], [eid]), "an edge's state differs from its proof")
            body += self.edge_root[3]
        self.block.update(hashlib.sha256(body).digest())
        self.edge_root, self.found, self.last_eid, self.in_leaf = None, [], eid, self.in_leaf + 1
        self.span = min(self.span[0], lo), max(self.span[1], hi)

    def _node(self, token: int, v: tuple, body: bytes) -> None:
        if token == NODE_LEAF:
            self._need(v[6] == self.in_leaf and v[4:6] == self.span, "a leaf's edges differ from its record")
            meta = body[:40]
            self.nodes.append((hashlib.sha256(meta + self.block.digest()).digest(), meta))
            self.block, self.in_leaf, self.last_eid, self.span = hashlib.sha256(), 0, -1, (EMPTY_LO, EMPTY_HI)
            return
        self._need(not self.in_leaf, "edges outside of a leaf")
        if token == NODE_PRUNED:
            x0, y0, x1, y1, lo, hi = v[1:]
            apart = not (x0 <= self.box[2] and x1 >= self.box[0] and y0 <= self.box[3] and y1 >= self.box[1])
            self._need(apart or (lo, hi) == (EMPTY_LO, EMPTY_HI) or not self._meets(lo, hi), "a pruned node meets the window")
            self.nodes.append((v[0], body[32:]))
            return
        self._need(len(self.nodes) >= 3, "a node lacks children")
        below, self.nodes = self.nodes[-3:], self.nodes[:-3]
        times = [struct.unpack(">II", m[32:]) for _, m in below]
        self._need(v[4:6] == (min(t[0] for t in times), max(t[1] for t in times)), "a node's time range isn't its children's")
        self.nodes.append((hashlib.sha256(body + b"".join(h + m for h, m in below)).digest(), body))

    def finish(self, root: bytes) -> int:
        """Number of results of a proof that holds."""
        self._need(self.start <= self.end, "the query ends before its start")
        self._need(len(self.nodes) == 1 and not self.in_leaf and not self.mmr and self.edge_root is None, "the proof is incomplete")
        self._need(self.last in (NODE_LEAF, NODE_INTERNAL), "the root isn't opened")
        self._need(self.nodes[0][0] == root, "the root differs")
        return self.n_results


REPORT = "query_id string, accepted boolean, reason string, n_tokens long, n_results long"


def verify_report(tokens: DataFrame, windows: DataFrame, root: str) -> DataFrame:
    """A row for each query: whether its proof leads to the trusted root (hex), and if not, why.

    Rows stream through in proof order; a query's proof is read by one task, as by a client.
    """
    trusted = bytes.fromhex(root)
    asked = F.struct(*[F.col(c).cast("double").alias(c) for c in BOX], F.col("q_start"), F.col("q_end")).alias("w")
    rows = in_order(tokens.join(windows.select("query_id", asked), "query_id"))

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, check, why, n = None, None, None, 0

        def report() -> list[tuple]:
            if check is None:
                return []
            reason = why
            if reason is None:
                try:
                    check.finish(trusted)
                except Rejected as e:
                    reason = str(e)
            return [(query, reason is None, reason, n, check.n_results)]

        columns = ["query_id", "accepted", "reason", "n_tokens", "n_results"]
        for frame in frames:
            done = []
            for q, token, body, eid, tid, lo, hi, w in zip(*(frame[c] for c in ("query_id", "token", "body", "eid", "tid", "start_ts", "end_ts", "w")), strict=True):
                if q != query:
                    done += report()
                    query, why, n = q, None, 0
                    check = Verifier(tuple(w[c] for c in BOX), w["q_start"], w["q_end"])
                n += 1
                if why is None:
                    try:
                        check.take(token, bytes.fromhex(body), (eid, bytes.fromhex(tid), int(lo), int(hi)) if isinstance(tid, str) else None)
                    except Rejected as e:
                        why = str(e)
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(report(), columns=columns)

    return rows.select("query_id", "token", "body", "eid", "tid", "start_ts", "end_ts", "w").mapInPandas(stream, REPORT)


def with_claims(report: DataFrame, derived: DataFrame, claimed: DataFrame) -> DataFrame:
    """report, with a refusal of queries whose claimed candidates aren't those that the proof discloses.

    derived, claimed: query_id, tid.
    """
    own, other = (df.select("query_id", "tid").distinct() for df in (derived, claimed))
    apart = own.withColumn("a", F.lit(1)).join(other.withColumn("b", F.lit(1)), ["query_id", "tid"], "full_outer").where("a IS NULL OR b IS NULL").select("query_id").distinct().withColumn("differs", F.lit(True))
    out = report.join(apart, "query_id", "left").withColumn("differs", F.coalesce("differs", F.lit(False)))
    wrong = F.when(F.col("accepted") & F.col("differs"), F.lit("the claimed candidates differ")).otherwise(F.col("reason"))
    return out.withColumn("reason", wrong).withColumn("accepted", F.col("accepted") & ~F.col("differs")).select(report.columns)


def disclosed(tokens: DataFrame) -> DataFrame:
    """query_id and tid of the results in proofs."""
    return tokens.where("tid IS NOT NULL").select("query_id", "tid").distinct()


def sizes(tokens: DataFrame) -> DataFrame:
    """Bytes of each query's proof file and result file, headers included, and their rows."""
    return tokens.groupBy("query_id").agg((F.lit(16) + F.sum(1 + F.expr("length(body) div 2"))).alias("proof_bytes"), F.count("*").alias("n_tokens"), (F.lit(16) + F.count("tid") * 44).alias("result_bytes"), F.count("tid").alias("n_results"))


def save(tokens: DataFrame, query_id: str, proof_path: str, result_path: str) -> None:
    """The two files of a query for its client, written as rows arrive, a partition at a time."""
    own = tokens.where(F.col("query_id") == query_id)
    n = own.agg(F.count("*"), F.count("tid")).first()
    with open(proof_path, "wb") as proof, open(result_path, "wb") as result:
        proof.write(struct.pack(">8sII", PROOF_MAGIC, VERSION, n[0]))
        result.write(struct.pack(">8sII", RESULT_MAGIC, VERSION, n[1]))
        for r in own.orderBy(*ORDER).toLocalIterator():
            proof.write(bytes([r["token"]]) + bytes.fromhex(r["body"]))
            if r["tid"] is not None:
                result.write(struct.pack(">I32sII", r["eid"], bytes.fromhex(r["tid"]), r["start_ts"], r["end_ts"]))


def _records(path: str, magic: bytes) -> Iterator:
    with open(path, "rb") as f:

        def exactly(n: int) -> bytes:
            data = f.read(n)
            if len(data) != n:
                raise Rejected("a file ends early")
            return data

        found, version, count = struct.unpack(">8sII", exactly(16))
        if (found, version) != (magic, VERSION):
            raise Rejected("not a file of this format")
        for _ in range(count):
            if magic == RESULT_MAGIC:
                yield struct.unpack(">I32sII", exactly(44))
                continue
            token = exactly(1)[0]
            if token not in FORMATS:
                raise Rejected("malformed token")
            yield token, exactly(struct.calcsize(FORMATS[token]))
        if f.read(1):
            raise Rejected("a file goes on after its end")


def verify_files(proof_path: str, result_path: str, window: Iterable, root: str) -> set[str]:
    """Trajectory ids of a proof that holds; raises Rejected otherwise. window: box, q_start, q_end."""
    *box, q_start, q_end = window
    check, results, ids = Verifier(tuple(box), q_start, q_end), _records(result_path, RESULT_MAGIC), set()
    for token, body in _records(proof_path, PROOF_MAGIC):
        entry = next(results, None) if token == RESULT_SLOT else None
        check.take(token, body, entry)
        if entry:
            ids.add(entry[1].hex())
    check.finish(bytes.fromhex(root))
    if next(results, None) is not None:
        raise Rejected("results without a place in the proof")
    return ids
