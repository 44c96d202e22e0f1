"""Runners of the experiments: windows of all sizes, growing shares of the data, and batches of updates.

Each returns rows and writes them as CSV; the runner over windows also writes a matrix for
each measure. Seconds are those of whole Spark jobs, so that small cells measure scheduling.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dialect import Spark as d
from tessera.operators import index_sql as ix
from tessera.operators import inserts, list_proofs, packed_proofs, proofs, spatial_tree
from tessera.operators.mmr import mmr_nodes
from tessera.operators.tables import ranked, stored
from tessera.plans import authenticated as auth
from tessera.plans.engine import evaluate, statement
from tessera.plans.queries import CAP, FANOUT, points, updated
from tessera.plans.world import matrix, world

LABELS = {60: "1min", 1800: "30min", 3600: "1h", 14400: "4h", 43200: "12h", 86400: "24h"}
PERCENT = (20, 40, 60, 80, 100)
BATCHES = (1, 2, 4, 8, 10)  # of the trajectories, after the base of 60 %


@dataclass
class Engine:
    """What a runner asks of an index: proof tokens of windows, their verifier and their size."""

    tokens: Callable[[DataFrame], DataFrame]
    verify: Callable[[DataFrame, DataFrame], DataFrame]
    sizes: Callable[[DataFrame], DataFrame]
    scanned: str  # condition of the tokens that disclose entries
    candidates: Callable[[DataFrame, DataFrame], DataFrame]  # query_id, tid of a proof
    exact: Callable[[str], list]  # expressions over `windows`, the last of which has the exact answers


def _over_edges(text: str) -> list:
    return [*world(d), ("windows", text), *ix.fine("windows")]


def _over_points(candidates: str) -> Callable[[str], list]:
    return lambda text: [*world(d), ("windows", text), *ix.point_candidates(), *ix.fine_points(d, candidates)]


def _stream_sizes(tokens: DataFrame) -> DataFrame:
    size = F.expr("length(body) div 2") + F.when(F.col("token") == packed_proofs.RECORD, 0).otherwise(1)
    return tokens.groupBy("query_id").agg(F.sum(size).alias("proof_bytes"))


def tree_engine(spark: SparkSession, data: str) -> Engine:
    built = tuple(stored(df, "engine") for df in auth.main_tree(spark, data))
    root = built[0].where("path = ''").first()["hash"]
    return Engine(lambda w: proofs.proof_tokens(*built, w), lambda t, w: proofs.verify_report(t, w, root), proofs.sizes, "tid IS NOT NULL", lambda t, w: proofs.disclosed(t), _over_edges)


def list_engine(spark: SparkSession, data: str) -> Engine:
    built = tuple(stored(df, "engine") for df in auth.list_tree(spark, data))
    root = built[0].where("path = ''").first()["hash"]
    return Engine(lambda w: list_proofs.proof_tokens(*built, w), lambda t, w: list_proofs.verify_report(t, built[4], w, root), list_proofs.sizes, f"token = {list_proofs.ENTRY}", list_proofs.disclosed, _over_edges)


def key_engine(spark: SparkSession, data: str) -> Engine:
    trees, root = auth.key_index(spark, data)

    def tokens(w: DataFrame) -> DataFrame:
        asked = auth.key_ranges(w)
        return reduce(DataFrame.unionByName, (packed_proofs.tokens(*trees[k], FANOUT, asked[k], (8, 8)).withColumn("dim", F.lit(k)) for k in auth.KEYS))

    def apart(t: DataFrame) -> dict[str, DataFrame]:
        return {k: t.where(F.col("dim") == k).drop("dim") for k in auth.KEYS}

    def candidates(t: DataFrame, w: DataFrame) -> DataFrame:
        asked, own = auth.key_ranges(w), apart(t)
        return reduce(DataFrame.intersect, (packed_proofs.disclosed(own[k], asked[k], packed_proofs.KEYS) for k in auth.KEYS))

    return Engine(tokens, lambda t, w: packed_proofs.verify_keys(apart(t), auth.key_ranges(w), root), _stream_sizes, f"token = {packed_proofs.RECORD}", candidates, _over_points("three_way"))


def box_engine(spark: SparkSession, data: str) -> Engine:
    nodes, records, root = auth.box_index(spark, data)

    def candidates(t: DataFrame, w: DataFrame) -> DataFrame:
        at = lambda k: F.expr(f"cast(conv(regexp_replace(reverse(substr(body, {k}, 16)), '(.)(.)', '$2$1'), 16, 10) as bigint)")
        shown = t.where(F.col("token") == packed_proofs.RECORD).select("query_id", at(1).alias("point_id"), "tid")
        own = statement(spark, data, world(d), "SELECT point_id, lon, lat, ts FROM points")
        return shown.join(own, "point_id").join(proofs.normalized(w), "query_id").where("lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat AND ts BETWEEN q_start AND q_end").select("query_id", "tid").distinct()

    return Engine(lambda w: packed_proofs.tokens(nodes, records, FANOUT, auth.box_ranges(w), (4, 2)), lambda t, w: packed_proofs.verify_boxes(t, auth.box_ranges(w), root), _stream_sizes, f"token = {packed_proofs.RECORD}", candidates, _over_points("in_box"))


ENGINES = {"tree": tree_engine, "lists": list_engine, "keys": key_engine, "boxes": box_engine}


def _timed(work: Callable):
    began = time.perf_counter()
    out = work()
    return out, time.perf_counter() - began


def _write(spark: SparkSession, rows: list[dict], folder: str) -> None:
    spark.createDataFrame(rows).select(*rows[0]).coalesce(1).write.csv(folder, header=True, mode="overwrite")


def cross_range(spark: SparkSession, data: str, out: str, engine: str = "tree", repeats: int = 1, warmups: int = 0, windows: str | None = None) -> list[dict]:
    """A row for each window of the matrix (or of a SELECT like it), means and deviations over the repeats.

    Query time is that of the proof's tokens and of the exact filter; verification is apart.
    A proof that is refused stops the run.
    """
    index, rows = ENGINES[engine](spark, data), []
    for w in spark.sql(windows or matrix(d)).orderBy("side", "span").collect():
        one = spark.createDataFrame([w], spark.sql(matrix(d)).schema)
        text = f"SELECT '{w['query_id']}' AS query_id, " + ", ".join(f"CAST('{w[c]!r}' AS DOUBLE) AS {c}" for c in spatial_tree.BOX) + f", {w['q_start']}L AS q_start, {w['q_end']}L AS q_end"
        took: dict[str, list[float]] = {"coarse": [], "fine": [], "verify": []}
        for turn in range(warmups + repeats):
            tokens, coarse = _timed(lambda: stored(index.tokens(one), "tokens"))  # noqa: B023
            exact, fine = _timed(lambda: statement(spark, data, index.exact(text), f"SELECT tid FROM {index.exact(text)[-1][0]}").count())  # noqa: B023
            report, verify = _timed(lambda: index.verify(tokens, one).first())  # noqa: B023
            if not report["accepted"]:
                raise proofs.Rejected(report["reason"])
            if turn >= warmups:
                for name, x in (("coarse", coarse), ("fine", fine), ("verify", verify)):
                    took[name].append(x)
        size = index.sizes(tokens).first()["proof_bytes"]
        found = tokens.agg(F.count_if(F.expr(index.scanned))).first()[0], index.candidates(tokens, one).count()
        query = [a + b for a, b in zip(took["coarse"], took["fine"], strict=True)]
        row = {"spatial_side_km": w["side"], "temporal_label": LABELS[w["span"]], "temporal_seconds": w["span"]}
        row |= {f"query_{c}": w[c] for c in spatial_tree.BOX} | {"query_start": w["q_start"], "query_end": w["q_end"]}
        for name, xs in (("coarse_query", took["coarse"]), ("fine_filtering", took["fine"]), ("query", query), ("verification", took["verify"])):
            row |= {f"{name}_time_s": statistics.mean(xs), f"{name}_time_std_s": statistics.stdev(xs) if len(xs) > 1 else 0.0}
        row |= {"vo_size_bytes": size, "vo_size_mb": size / 1e6, "verification_set_count": found[0], "candidate_trajectory_count": found[1], "final_trajectory_count": exact}
        rows.append(row)
    _write(spark, rows, f"{out}/cross_range_results")
    for measure in ("query_time_s", "verification_time_s", "vo_size_mb", "candidate_trajectory_count", "final_trajectory_count"):
        cells = spark.createDataFrame(rows).select("temporal_seconds", "temporal_label", "spatial_side_km", measure)
        cells.groupBy("temporal_seconds", "temporal_label").pivot("spatial_side_km").agg(F.first(measure)).orderBy("temporal_seconds").coalesce(1).write.csv(f"{out}/{measure}_matrix", header=True, mode="overwrite")
    return rows


def _numbered(spark: SparkSession, data: str) -> DataFrame:
    """Entries with the place of their trajectory and the numbers of all and of the base's."""
    ctes = [*updated(d), ("placed", "SELECT e.eid, e.tid, e.start_ts, e.end_ts, o, n, n_base FROM entries e JOIN ordinal USING (user_id) CROSS JOIN cutoff")]
    return stored(statement(spark, data, ctes, "SELECT eid, tid, start_ts, end_ts, o, n, n_base FROM placed"), "placed")


def _roots(spark: SparkSession, entries: DataFrame) -> DataFrame:
    return auth.mmr_roots(spark, stored(mmr_nodes(entries.select("eid", "tid", "start_ts", "end_ts")), "mmr"))


def scaling(spark: SparkSession, data: str, out: str) -> list[dict]:
    """Build time and root of the main tree over growing shares of the trajectories."""
    road, placed, rows = auth.Road(spark, data), _numbered(spark, data), []
    for pct in PERCENT:
        own = placed.where(f"o <= n * {pct} div 100")
        root, took = _timed(lambda: spatial_tree.sem_tree(road.nodes, road.edges, _roots(spark, own), auth.THETA)[0].where("path = ''").first()["hash"])  # noqa: B023
        n = own.agg(F.count_distinct("o"), F.count("*")).first()
        rows.append({"pct": pct, "n_trajectories": n[0], "n_entries": n[1], "build_s": took, "root": root})
    _write(spark, rows, f"{out}/scaling_results")
    return rows


def update(spark: SparkSession, data: str, out: str) -> list[dict]:
    """Time to take batches into the main tree of 60 %, each from that same base, and whether a rebuild agrees."""
    road, placed, rows = auth.Road(spark, data), _numbered(spark, data), []
    base = placed.where("o <= n_base")
    tree, records = (stored(df, "base-tree") for df in spatial_tree.sem_tree(road.nodes, road.edges, _roots(spark, base), auth.THETA))
    for pct in BATCHES:
        grown = placed.where(f"o <= n_base + greatest(1, n * {pct} div 100)")
        batch = grown.where("o > n_base")

        def work() -> str:
            lists = grown.join(batch.select("eid").distinct(), "eid", "left_semi")  # noqa: B023
            return spatial_tree.updated_tree(tree, records, _roots(spark, lists))[0].where("path = ''").first()["hash"]

        root, took = _timed(work)
        full = spatial_tree.sem_tree(road.nodes, road.edges, _roots(spark, grown), auth.THETA)[0].where("path = ''").first()["hash"]
        n = batch.agg(F.count_distinct("o"), F.count("*"), F.count_distinct("eid")).first()
        rows.append({"pct": pct, "n_trajectories": n[0], "n_entries": n[1], "n_edges": n[2], "update_s": took, "root": root, "equals_rebuild": root == full})
    _write(spark, rows, f"{out}/update_results")
    return rows


def _placed_points(spark: SparkSession, data: str) -> DataFrame:
    """Points with the place of their trajectory, and the numbers of all and of the base's."""
    ctes = [*points(d), *[c for c in updated(d) if c[0] in ("cutoff", "user_rank", "ordinal")], ("placed", "SELECT p.*, o, n, n_base FROM keyed p JOIN ids USING (tid) JOIN ordinal USING (user_id) CROSS JOIN cutoff")]
    return stored(statement(spark, data, ctes, "SELECT * FROM placed"), "placed-points")


def _box_root(spark: SparkSession, rows: DataFrame) -> str:
    ctes = [("morton_rank", ""), *ix.rtree(d, CAP, FANOUT, 0, leaf="idx")]
    return evaluate(spark, ctes, "SELECT root FROM rt_root", given={"morton_rank": rows}).first()["root"]


def point_scaling(spark: SparkSession, data: str, out: str) -> list[dict]:
    """Build time and roots of the point trees over growing shares of the trajectories."""
    placed, rows = _placed_points(spark, data), []
    for pct in PERCENT:
        own = placed.where(f"o <= n * {pct} div 100").select("point_id", "tid", "ts", "lon", "lat")
        given = {"points": own}
        keys, took = _timed(lambda: evaluate(spark, points(d), f"SELECT {d.sha(d.text_hex('THREE-MBT-ROOT-v1'), 'x.hash', 'y.hash', 't.hash')} AS root FROM lon_rootnode x CROSS JOIN lat_rootnode y CROSS JOIN ts_rootnode t", given=given).first()["root"])  # noqa: B023
        boxes, box_took = _timed(lambda: evaluate(spark, points(d), "SELECT root FROM rt_root", given=given).first()["root"])  # noqa: B023
        n = own.agg(F.count_distinct("tid"), F.count("*")).first()
        rows.append({"pct": pct, "n_trajectories": n[0], "n_points": n[1], "keys_build_s": took, "keys_root": keys, "boxes_build_s": box_took, "boxes_root": boxes})
    _write(spark, rows, f"{out}/point_scaling_results")
    return rows


def point_update(spark: SparkSession, data: str, out: str) -> list[dict]:
    """Time to take batches into the R-tree of 60 %, each from that same base, and its roots."""
    placed, rows = _placed_points(spark, data), []
    columns = ["point_id", "tid", "ts", "lon", "lat", "morton"]
    base = ranked(placed.where("o <= n_base").select(columns), ["morton", "point_id"], label="pack").withColumn("idx", F.expr(f"r div {CAP}")).withColumn("r", F.expr(f"r % {CAP}"))
    base = stored(base, "base-points")
    before = _box_root(spark, base)
    for pct in BATCHES:
        batch = stored(placed.where(f"o > n_base AND o <= n_base + greatest(1, n * {pct} div 100)").select(columns), "batch")
        root, took = _timed(lambda: _box_root(spark, inserts.insert(base, batch, "morton", ["morton", "point_id"], CAP, last_of_equal=False)))  # noqa: B023
        rows.append({"pct": pct, "n_points": batch.count(), "update_s": took, "before": before, "root": root})
    _write(spark, rows, f"{out}/point_update_results")
    return rows


def totals(spark: SparkSession, data: str) -> DataFrame:
    """pct, n_trajectories: what each share of the experiments comes to, and of how many."""
    n = statement(spark, data, world(d), "SELECT count(*) AS n FROM ids").first()["n"]
    return spark.createDataFrame([(p, max(1, n * p // 100), n) for p in PERCENT], "pct int, n_trajectories long, n_all long")
