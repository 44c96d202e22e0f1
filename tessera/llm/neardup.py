"""MinHash near-duplicate components by a signature-coordinate inverted join.

1. Each distinct set of word shingles gets a signature of `coords` coordinates.
2. A set is posted under its rarest coordinate-value pairs only. Two sets that
   agree on at least `need` coordinates share one of the coords - need + 1 pairs
   that come first in a global order, so this prefix loses none of them. Rarity
   comes from a counting sketch of fixed size over all signatures.
3. Posting lists with equal members are skipped but for one. Every list names a
   pivot, its most central member, and members meet under their pivots.
4. Collisions of members with their pivot are counted over the signatures, of which the
   low byte of each coordinate is enough: equal coordinates have equal bytes, so that no
   pair gets fewer collisions. Those that have `need` of them are compared with it on full
   sets: one row a member, in blocks, to each of which the pivot goes, so that a group of
   near copies costs rows in proportion to its size.
5. Only members that this does not link to their pivot are compared with all the
   others of the group, in pairs of blocks, on signatures and then on full sets.
6. Links are merged into components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WordHash, bloom_filter, connected_components, distinct, lean, materialize, mix, ngram_hashes, passing, runs, small_batches, sorted_join, utf8_column

SKETCH = 1 << 16


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-shingles; the whole sequence if there are fewer words."""
    if len(words) == 0:
        return words
    return distinct(ngram_hashes(words, min(n, len(words))))


def multipliers(coords: int) -> np.ndarray:
    return mix(np.arange(1, coords + 1, dtype=np.uint64)) | np.uint64(1)


def signature(items: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Least 32 high bits of each permutation over the set."""
    least = np.full(len(by), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(items), 1024):
        np.minimum(least, (items[None, at : at + 1024] * by[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def low_bytes(sigs: np.ndarray) -> np.ndarray:
    """The low byte of each coordinate; the high ones are mostly 0 in large sets."""
    return (sigs & np.uint32(255)).astype(np.uint8)


def tokens(sigs: np.ndarray) -> np.ndarray:
    """64-bit names of the coordinate-value pairs."""
    return mix((np.arange(sigs.shape[1], dtype=np.uint64) << np.uint64(32))[None, :] | sigs.astype(np.uint64))


def matches_needed(coords: int, num: int, den: int) -> int:
    """Coordinates that a pair at the threshold agrees on, less 5.5 deviations."""
    p = num / den
    return max(1, math.floor(coords * p - 5.5 * math.sqrt(coords * p * (1 - p))))


def _signer(shingle: int, coords: int):
    by = multipliers(coords)

    @lean
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            ids, nids, sizes, sigs = batch.column(0), [], [], []
            for text in utf8_column(batch.column(1)):
                items = shingle_set(hashes.of((text or b"").lower().split()), shingle)
                nids.append(set_id(items))
                sizes.append(len(items))
                sigs.append(signature(items, by).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "nid", "n_shingles", "sig"])

    return run


def _sketcher(coords: int):
    @lean
    def run(batches):
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                sigs = np.frombuffer(b"".join(batch.column(0).slice(at, 1024).to_pylist()), np.uint32).reshape(-1, coords)
                counts += np.bincount((tokens(sigs) & np.uint64(SKETCH - 1)).astype(np.int64).ravel(), minlength=SKETCH)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    return run


def _poster(coords: int, prefix: int, sketch, only=None):
    """Postings of each set; with a filter, those whose key passes it."""

    @lean
    def run(batches):
        counts = sketch.value
        rank = np.floor(2 * np.log2(counts + 1.0)).astype(np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, coords)
                names = tokens(sigs)
                slots = (names & np.uint64(SKETCH - 1)).astype(np.int64)
                ordered = (rank[slots] << np.uint64(56)) | (names >> np.uint64(8))
                first = np.partition(ordered, prefix - 1, axis=1)[:, :prefix] if prefix < coords else ordered
                nid = part.column(0).to_numpy()
                # the most central first; the low bits break ties
                central = (counts[slots].sum(axis=1).clip(0, (1 << 30) - 1).astype(np.int64) << 32) | (mix(nid.view(np.uint64)) >> np.uint64(32)).astype(np.int64)
                key, nid, central = first.view(np.int64).ravel(), np.repeat(nid, prefix), np.repeat(central, prefix)
                if only is not None:
                    some = passing(only.value, key)
                    key, nid, central = key[some], nid[some], central[some]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nid), pa.array(central)], ["key", "nid", "central"])

    return run


def _shortener(coords: int):
    """(nid, low): the low bytes of the signatures."""

    @lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                low = low_bytes(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, coords))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in low], pa.binary())], ["nid", "low"])

    return run


def set_id(items: np.ndarray) -> np.int64 | None:
    """64 bits that name a set; None for the empty one."""
    return np.int64(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes()))) if len(items) else None


def _set_maker(shingle: int, coords: int, wanted):
    """Sets whose name passes the filter, of rows whose id passes it or is null."""
    by = multipliers(coords)

    @lean
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            ids = batch.column(0)
            batch = batch.filter(pa.compute.or_(ids.is_null(), pa.array(passing(wanted.value, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))))
            for at in range(0, batch.num_rows, 256):
                nids, sets, sigs = [], [], []
                for text in utf8_column(batch.column(1).slice(at, 256)):
                    items = shingle_set(hashes.of((text or b"").lower().split()), shingle)
                    nid = set_id(items)
                    if nid is not None and passing(wanted.value, np.array([nid]))[0]:
                        nids.append(nid)
                        sets.append(items.tobytes())
                        sigs.append(low_bytes(signature(items, by)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["nid", "items", "low"])

    return run


def _namer(columns: list[str], text_col: str, shingle: int, name: str):
    @lean
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            nids = [set_id(shingle_set(hashes.of((x or b"").lower().split()), shingle)) for x in utf8_column(batch.column(columns.index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nids, pa.int64())], [*columns, name])

    return run


def with_set_id(docs: DataFrame, name: str = "set_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with the name of each row's set of shingles, as in near_duplicates, in a new column."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    return docs.mapInArrow(_namer(docs.columns, text_col, shingle, name), docs.withColumn(name, F.lit(None).cast("long")).schema)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b| for sorted distinct arrays."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _near_pivot(coords: int, need: int):
    """Members of a block that agree with their pivot on `need` coordinates."""

    @lean
    def run(batches):
        for table in runs(batches, ["pivot", "block"]):
            nid, pivot = table["nid"].to_numpy(), table["pivot"][0].as_py()
            hub = np.flatnonzero(nid == pivot)
            if len(hub) and len(nid) > 1:
                sigs = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, coords)
                near = nid[((sigs == sigs[hub[0]]).sum(axis=1) >= need) & (nid != pivot)]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), pivot, np.int64)), pa.array(near)], ["pivot", "nid"])

    return run


def _like_pivot(num: int, den: int):
    """Members of a block whose sets are similar to their pivot's."""

    @lean
    def run(batches):
        for table in runs(batches, ["pivot", "block"]):
            nid, pivot = table["nid"].to_numpy(), table["pivot"][0].as_py()
            hub = np.flatnonzero(nid == pivot)
            if len(hub) and len(nid) > 1:
                sets = table["items"]
                own = np.frombuffer(sets[int(hub[0])].as_py(), np.uint64)
                like = np.array([x for k, x in enumerate(nid.tolist()) if x != pivot and similar(np.frombuffer(sets[k].as_py(), np.uint64), own, num, den)], np.int64)
                if len(like):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(like), pivot, np.int64)), pa.array(like)], ["pivot", "nid"])

    return run


def _sifter(coords: int, need: int):
    """Members of a pair of blocks, one left over and one of all, with a partner of the other kind that agrees on `need` coordinates."""

    @lean
    def run(batches):
        for table in runs(batches, ["pivot", "bi", "bj"]):
            nid, left = table["nid"].to_numpy(), table["left"].to_numpy(zero_copy_only=False).astype(bool)
            sigs = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, coords)
            every = np.flatnonzero(~left)
            found = np.zeros(len(nid), bool)
            for i in np.flatnonzero(left).tolist():
                for start in range(0, len(every), 2048):
                    part = every[start : start + 2048]
                    near = part[((sigs[part] == sigs[i]).sum(axis=1) >= need) & (nid[part] != nid[i])]
                    if len(near):
                        found[near] = found[i] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.sum(), table["pivot"][0].as_py(), np.int64)), pa.array(nid[found]), pa.array(left[found])], ["pivot", "nid", "left"])

    return run


def _linker(coords: int, need: int, num: int, den: int):
    """Links between a block of members left over and a block of all; no more than tell which hang together."""

    def links_of(table: pa.Table) -> list[tuple[int, int]]:
        nid, left = table["nid"].to_numpy(), table["left"].to_numpy(zero_copy_only=False).astype(bool)
        _, group = np.unique(nid, return_inverse=True)  # of nids known to hang together
        sets = table["items"]
        sigs = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, coords)
        every = np.flatnonzero(~left)
        out = []
        for i in np.flatnonzero(left).tolist():
            own = np.frombuffer(sets[i].as_py(), np.uint64)
            for start in range(0, len(every), 2048):
                part = every[start : start + 2048]
                for j in part[(sigs[part] == sigs[i]).sum(axis=1) >= need].tolist():
                    if group[j] != group[i] and similar(own, np.frombuffer(sets[j].as_py(), np.uint64), num, den):
                        out.append((int(nid[i]), int(nid[j])))
                        group[group == group[i]] = group[j]
        return out

    @lean
    def run(batches):
        found: list[tuple[int, int]] = []
        for table in runs(batches, ["pivot", "bi", "bj"]):
            found += links_of(table)
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
                found = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _blocked(members: DataFrame, block: int, label: str) -> DataFrame:
    """members (pivot, nid) with n_blocks of about `block` members in the pivot's group, and the own one.

    Only groups of more than a block are joined with their numbers, salted, so that no task has a large group.
    """
    many = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks")).where("n_blocks > 1")
    many = many.select("pivot", "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("nid", "pivot"), F.lit(SALTS)).cast("int")).join(sorted_join(many), ["pivot", "salt"], "left")
    dealt = dealt.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).select("pivot", "nid", "n_blocks", F.pmod(F.xxhash64("nid"), F.col("n_blocks")).cast("int").alias("block"))
    return materialize(dealt, label)


def _with_pivot(members: DataFrame, block: int, label: str) -> DataFrame:
    """(pivot, nid, block): members but for the pivots, in one block each, and the pivot in all."""
    dealt = _blocked(members.where("nid <> pivot"), block, label)
    heads = dealt.groupBy("pivot", "block").count().select("pivot", F.col("pivot").alias("nid"), "block")
    return dealt.select("pivot", "nid", "block").unionByName(heads)


def _across(both: DataFrame, block: int) -> DataFrame:
    """(pivot, nid, left, bi, bj): blocks of the members left over with blocks of all members of their groups.

    both: (pivot, nid, left), a row a member of either kind. Sizes of groups are sums of tasks'
    sums; members meet them salted, in one join, so that no task has a large group.
    """
    blocks = lambda which: F.ceil(F.count_if(which) / block).cast("int")
    sizes = both.groupBy("pivot").agg(blocks(F.col("left")).alias("k_left"), blocks(~F.col("left")).alias("k_all")).where("k_left > 0 and k_all > 0")
    salted = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = both.withColumn("salt", F.pmod(F.xxhash64("nid", "pivot"), F.lit(SALTS)).cast("int")).join(sorted_join(salted), ["pivot", "salt"])
    own = F.pmod(F.xxhash64("nid"), F.when(F.col("left"), F.col("k_left")).otherwise(F.col("k_all"))).cast("int")
    dealt = dealt.select("pivot", "nid", "left", own.alias("own"), F.explode(F.expr("sequence(0, if(left, k_all, k_left) - 1)")).alias("other"))
    return dealt.selectExpr("pivot", "nid", "left", "if(left, own, other) AS bi", "if(left, other, own) AS bj")


def _grouped(dealt: DataFrame, by_nid: DataFrame, keys: list[str]) -> DataFrame:
    """Members with the columns of by_nid, each group in one task and sorted."""
    return dealt.join(sorted_join(by_nid), "nid").repartition(*keys).sortWithinPartitions(*keys)


SALTS = 16


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, coords: int = 128, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_id, cluster for every row of docs.

    Words are runs of anything but ASCII white space, A-Z in lower case. Rows are
    linked if den * |A and B| >= num * |A or B| for their sets of `shingle`-word
    shingles. component_id is the least doc_id that links reach; kept marks it. set_id
    names a row's set, cluster its component by one of its sets.

    A null or wordless text has an empty set, n_shingles 0, no link, set_id and cluster
    null. Fewer words than `shingle` make one shingle. Rows with equal sets are linked;
    rows that repeat a doc_id keep a row each and are kept or not by their component.
    A null doc_id takes part in links; it is the component_id (null, not kept)
    only where nothing else is reached. A text's set is in one task's memory, however
    long the text. An empty table gives an empty result; other columns are ignored.
    """
    spark, need = docs.sparkSession, matches_needed(coords, num, den)
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(rows.mapInArrow(_signer(shingle, coords), "doc_id long, nid long, n_shingles long, sig binary"), "signed")
    some = signed.where("nid is not null")
    each = materialize(some.groupBy("nid").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    nodes, copies = each.select("nid", "sig"), each.select("nid", "least", "n")

    counts = np.zeros(SKETCH, np.int64)
    for slot, n in nodes.select("sig").mapInArrow(_sketcher(coords), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n  # at most SKETCH rows, whatever the input
    sketch, prefix = spark.sparkContext.broadcast(counts), coords - need + 1
    posts = nodes.mapInArrow(_poster(coords, prefix, sketch), "key long, nid long, central long")
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("central").alias("top"), F.bit_xor(F.xxhash64("nid")).alias("members")).where("n > 1")
    lists = materialize(lists.groupBy("members", "n", "top").agg(F.min("key").alias("key")).select("key", "top"), "lists")
    listed = bloom_filter(lists.select("key"))
    posts = nodes.mapInArrow(_poster(coords, prefix, sketch, listed), "key long, nid long, central long")
    met = materialize(posts.join(sorted_join(lists), "key").select("key", "nid", "central", "top"), "met")
    pivots = met.where("central = top").groupBy("key").agg(F.min("nid").alias("pivot"))
    under = materialize(met.join(sorted_join(pivots), "key").select("pivot", "nid").distinct(), "under")
    for used in (sketch, listed):
        used.destroy()

    def sets_of(members: DataFrame) -> DataFrame:
        """nid, items, low of the members' sets, made again from one row each."""
        wanted = materialize(members.select("nid").distinct().join(sorted_join(copies), "nid").select("nid", "least"), "wanted")
        keys = bloom_filter(wanted.select(F.explode(F.array("nid", "least")).alias("id")).where("id is not null"))
        made = lambda df: df.mapInArrow(_set_maker(shingle, coords, keys), "nid long, items binary, low binary")
        out = made(rows.where("doc_id is not null"))
        if not wanted.where("least is null").isEmpty():
            out = out.unionByName(made(rows.where("doc_id is null")))
        out = materialize(out, "sets")
        keys.destroy()
        return out

    short = nodes.mapInArrow(_shortener(coords), "nid long, low binary")
    near = _grouped(_with_pivot(under, block, "dealt"), short, ["pivot", "block"]).mapInArrow(_near_pivot(coords, need), "pivot long, nid long")
    near = materialize(near, "near")
    sets = sets_of(near.select(F.explode(F.array("pivot", "nid")).alias("nid")))
    like = _grouped(_with_pivot(near, block, "near-dealt"), sets, ["pivot", "block"]).mapInArrow(_like_pivot(num, den), "pivot long, nid long")
    like = materialize(like.distinct(), "like")
    left = materialize(under.where("nid <> pivot").join(sorted_join(like), ["pivot", "nid"], "left_anti"), "left-over")
    links = like.select(F.col("pivot").alias("a"), F.col("nid").alias("b"))
    if not left.isEmpty():
        keys = ["pivot", "bi", "bj"]
        both = left.select("pivot", "nid", F.lit(True).alias("left")).unionByName(under.select("pivot", "nid", F.lit(False).alias("left")))
        found = materialize(_grouped(_across(both, block), short, keys).mapInArrow(_sifter(coords, need), "pivot long, nid long, left boolean").distinct(), "sifted")
        if not found.isEmpty():
            more = _grouped(_across(found, block), sets_of(found), keys).mapInArrow(_linker(coords, need, num, den), "a long, b long")
            links = links.unionByName(materialize(more, "links"))

    labels = connected_components(links)
    named = copies.join(sorted_join(labels.withColumnRenamed("node", "nid")), "nid", "left").where("comp is not null or n > 1")
    named = materialize(named.select("nid", "least", F.coalesce("comp", "nid").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = named.select("nid", "comp").join(sorted_join(least), "comp")
    out = signed.select("doc_id", "nid", "n_shingles").join(sorted_join(of_set), "nid", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), F.col("nid").alias("set_id"), F.coalesce("comp", "nid").alias("cluster"))
