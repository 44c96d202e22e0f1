"""Helpers shared by the operators: cut lineage, hash words, pack arrays, filter ids, stream sorted runs."""

from __future__ import annotations

import ctypes
import functools
import gc
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import bucketed as bucketed
from tessera.operators.tables import drop as drop
from tessera.operators.tables import release as release
from tessera.operators.tables import shared_dir as shared_dir
from tessera.operators.tables import stored as materialize

GOLD = np.uint64(0x9E3779B97F4A7C15)
MASK64 = (1 << 64) - 1


#: glibc's names of the sizes from which memory is mapped, kept free, and of the number of arenas.
MMAP_THRESHOLD, TRIM_THRESHOLD, ARENA_MAX = -3, -1, -8


def lean(run):
    """A function over batches that keeps no memory which it doesn't use; workers outlive tasks.

    Blocks of 1 MB or more, Arrow's too, go back to the system when freed, the rest when a task ends.
    """

    @functools.wraps(run)
    def streamed(batches):
        libc = ctypes.CDLL(None)
        glibc = hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim")
        if glibc:
            for name, value in ((MMAP_THRESHOLD, 1 << 20), (TRIM_THRESHOLD, 4 << 20), (ARENA_MAX, 2)):
                libc.mallopt(name, value)
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            if glibc:
                libc.malloc_trim(0)

    return streamed


#: Rows and bytes that Spark hands to Python at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session's batches to Python workers be no larger than BATCH_ROWS and BATCH_BYTES, so that workers stay small."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        found = re.sub("[^0-9-]", "", spark.conf.get(key))
        if not 0 < int(found) <= most:
            spark.conf.set(key, str(most))


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class WordHash(dict):
    """bytes -> 64-bit hash, remembered for the words met most recently."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def of_text(words: list[bytes]) -> int:
        return hash_of(b" ".join(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; a sort is several times as fast here as numpy's unique without counts."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes, in order; empty if there are fewer words."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * GOLD + words[j : len(words) - n + 1 + j]
    return mix(out + np.uint64(n))


def squeezed(x: np.ndarray) -> bytes:
    """zstandard over the planes of equal significance of an array's bytes."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def steps(ascending: np.ndarray) -> bytes:
    """An ascending array as the differences of its members."""
    return squeezed(np.diff(ascending, prepend=np.zeros(1, np.uint64)))


def summed(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, np.uint64), dtype=np.uint64)


def _places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64))
    return (h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64)


def _bloom_rows(size: int):
    @lean
    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            for own in [ids.to_numpy()] if pa.types.is_integer(ids.type) else (np.frombuffer(x, np.int64) for x in ids.to_pylist()):
                for at in _places(own, size):
                    np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        for low in range(0, len(at), 1 << 16):
            own = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words[own])], ["slot", "bits"])

    return run


def bloom_filter(ids: DataFrame, most_bits: int = 1 << 27) -> Broadcast:
    """Bits for a column of ids, or of packed arrays of them: ten each or more up to most_bits (16 MB); beyond, more ids pass by chance."""
    size = 1 << 20
    n = ids.count() if ids.dtypes[0][1] == "bigint" else int(ids.agg(F.sum(F.octet_length(ids.columns[0]))).first()[0] or 0) // 8
    while size < min(10 * n, most_bits):
        size *= 2
    rows = ids.mapInArrow(_bloom_rows(size), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(words)


def passing(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bits = words.view(np.uint8)
    out = np.ones(len(ids), bool)
    for at in _places(ids, 64 * len(words)):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def utf8_column(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def runs(batches, key_names: list[str]):
    """Split a stream sorted by key_names into one pa.Table for each key."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        table = part if rest is None else pa.concat_tables([rest, part])
        change = np.zeros(table.num_rows, bool)
        for name in key_names:
            values = table[name].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        at = 0
        for cut in cuts.tolist():
            yield table.slice(at, cut - at)
            at = cut
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


#: Ids that are sent to rows of texts (32 MB), at most.
MOST_IDS = 1 << 22


def sent_ids(ids: DataFrame, most: int) -> Broadcast | None:
    """A column of integer ids, ascending, for among; None if there are more than most."""
    ids = ids.where(F.col(ids.columns[0]).isNotNull())
    if ids.count() > most:
        return None
    return ids.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()[0].to_numpy()))


def among(rows: DataFrame, ids: DataFrame, sent: Broadcast | None) -> DataFrame:
    """The rows whose id is among ids, as sent_ids sent them; so texts aren't shuffled, else they are joined."""
    (name,) = ids.columns
    if sent is None:
        return rows.join(sorted_join(ids), name, "left_semi")

    def there(own: pa.Array) -> pa.Array:
        held, asked = sent.value, own.fill_null(0).to_numpy(zero_copy_only=False)
        found = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked if len(held) else np.zeros(len(asked), bool)
        return pa.array(found & own.is_valid().to_numpy(zero_copy_only=False))

    return rows.where(F.arrow_udf(there, "boolean")(name))


def sorted_join(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and sorted: tables that grow with the input are not gathered by the driver, whatever the session's threshold for broadcasts."""
    return df.hint("shuffle_merge")


#: Edges that one task takes, in some 100 MB.
FEW_EDGES = 1 << 20


@lean
def _merger(batches):
    """(node, comp) of all edges at once: roots are hooked to their least neighbour until none has one."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    nodes, ends = np.unique(np.concatenate([*(x[0] for x in parts), *(x[1] for x in parts), np.zeros(0, np.int64)]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    for at in range(0, len(nodes), 1 << 16):
        own = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["node", "comp"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of a link; comp is one node of its component.

    Rounds of hooking each vertex to its least neighbour, pointer jumping and
    contraction; all state is in shared tables. Once FEW_EDGES edges or fewer are left,
    one task finds the rest, as a round costs some ten shuffles, however little it
    reads. The number of rounds grows with the logarithm of the number of vertices.
    """
    edges = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while (left := edges.count()) > FEW_EDGES:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "parent")
        while True:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            jumped = materialize(parent.join(sorted_join(up), "comp").select("node", F.col("up").alias("comp"), (F.col("up") != F.col("comp")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("node", "comp")
            if not moved:
                break
        to_a = parent.select(F.col("node").alias("a"), F.col("comp").alias("ra"))
        to_b = parent.select(F.col("node").alias("b"), F.col("comp").alias("rb"))
        edges = materialize(edges.join(sorted_join(to_a), "a").join(sorted_join(to_b), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
        labels = parent if labels is None else renamed(labels, parent)
    if not left:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if labels is None else labels
    rest = materialize(edges.coalesce(1).mapInArrow(_merger, "node long, comp long"), "merged")
    return rest if labels is None else renamed(labels, rest)


def renamed(labels: DataFrame, parent: DataFrame) -> DataFrame:
    """labels with their components' own components."""
    up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return materialize(labels.join(sorted_join(up), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
