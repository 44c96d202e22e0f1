"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window of an item is contained in a document only if all its shingles are. So a
window is indexed under one necessary shingle, that which the documents have most
rarely, with the shingle's place in it. Both sides are tables: rarity is one count over
the documents, and the index is joined by hash, whatever the size of the benchmark.

Where they are read, documents pass two Bloom filters of fixed size: one of the
prefix shingles, whose places propose windows, and, after bounds on position and length,
one of whole windows. What passes is joined to the index by shingle, place and length,
and by a digest of its very words, which verifies the containment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import GOLD, WordHash, bloom_filter, lean, materialize, mix, ngram_hashes, passing, small_batches, utf8_column

#: Word characters are ASCII digits and letters and all that isn't ASCII; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOWS = "item string, n int, digest binary, whole long, shingles array<struct<token:long,offset:int>>"
FOUND = "row_id long, doc_id long, n_words long, proposed array<struct<start:long,n:int,offset:int,token:long,digest:binary>>"
#: Parts of a hot window's or shingle's rows.
SALTS = 16


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def digest_of(words: list[bytes]) -> bytes:
    """16 bytes that tell the very words of a window."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _windower(window: int, shingle: int):
    """All windows of items, with their shingles; a window shorter than a shingle is one."""

    @lean
    def run(batches):
        hashes, schema = WordHash(), pa.schema([("item", pa.string()), ("n", pa.int32()), ("digest", pa.binary()), ("whole", pa.int64()), ("shingles", pa.list_(pa.struct([("token", pa.int64()), ("offset", pa.int32())])))])
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8_column(batch.column(1)), strict=True):
                words = words_of(text)
                n, own = min(window, len(words)), hashes.of(words)
                tokens = signed(ngram_hashes(own, min(n, shingle)))
                whole = signed(ngram_hashes(own, n))
                each = n - min(n, shingle) + 1
                for low in range(0, len(whole) if n else 0, 4096):
                    at = range(low, min(low + 4096, len(whole)))
                    yield pa.RecordBatch.from_pylist([{"item": item, "n": n, "digest": digest_of(words[k : k + n]), "whole": whole[k], "shingles": [{"token": tokens[k + j], "offset": j} for j in range(each)]} for k in at], schema=schema)

    return run


def _counter(shingles, sizes: list[int]):
    """Occurrences in the documents of the shingles that pass the filter, added up within a task."""

    @lean
    def run(batches):
        hashes, keys, counts, rest, held = WordHash(), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            own, n = np.unique(np.concatenate([*rest, np.zeros(0, np.uint64)]), return_counts=True)
            every, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
            return every, np.bincount(place, np.concatenate([counts, n]), len(every)).astype(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in utf8_column(batch.column(0).slice(at, 256)):
                    own = hashes.of(words_of(text))
                    for n in sizes:
                        grams = ngram_hashes(own, n)
                        some = grams[passing(shingles.value, grams.view(np.int64))]
                        if len(some):
                            rest.append(some)
                            held += len(some)
                if held > 1 << 18:
                    (keys, counts), rest, held = merged(), [], 0
                if len(keys) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["token", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["token", "n"])

    return run


def propose(own: np.ndarray, sizes: list[int], shingle: int, prefix: np.ndarray, whole: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, n, offset, token) of the places where a window may occur in a document of word hashes."""
    out = []
    for n in sizes:
        k = min(n, shingle)
        tokens = ngram_hashes(own, k)
        at = np.flatnonzero(passing(prefix, tokens.view(np.int64))) if len(tokens) else tokens.astype(np.int64)
        for offset in range(n - k + 1):
            start = at - offset
            start = start[(start >= 0) & (start + n <= len(own))]  # bounds on position and length
            if len(start):
                grams = own[start]
                for j in range(1, n):
                    grams = grams * GOLD + own[start + j]
                start = start[passing(whole, mix(grams + np.uint64(n)).view(np.int64))]
                out += [(s, n, offset, t) for s, t in zip(start.tolist(), signed(tokens[start + offset]), strict=True)]
    return out


def _finder(prefix, whole, sizes: list[int], shingle: int):
    place = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32()), ("offset", pa.int32()), ("token", pa.int64()), ("digest", pa.binary())]))

    @lean
    def run(batches):
        hashes, row = WordHash(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, sizes_, found = batch.slice(at, 256), [], []
                for text in utf8_column(part.column(1)):
                    words = words_of(text)
                    sizes_.append(len(words))
                    found.append([{"start": s, "n": n, "offset": o, "token": t, "digest": digest_of(words[s : s + n])} for s, n, o, t in propose(hashes.of(words), sizes, shingle, prefix.value, whole.value)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column(0), pa.array(sizes_, pa.int64()), pa.array(found, place)], ["row_id", "doc_id", "n_words", "proposed"])
                row += part.num_rows

    return run


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated for each row of docs.

    n_hit counts document words inside any occurrence of a window of `window`
    consecutive item words (the whole item if it has fewer, but some); items are
    the ids of items with such windows, sorted as strings and comma-joined.

    Null and empty texts have no words, and such items no windows. Items without an id
    are ignored. Repeated items count once, repeated documents each; windows that several
    items have count for each of them, and of equally rare shingles the least hash is
    taken. Without items or documents nothing is contaminated. A text is in one task's
    memory, however long; its occurrences are rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    windows = materialize(items.mapInArrow(_windower(window, shingle), WINDOWS), "windows")
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most `window`
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    own = materialize(windows.dropDuplicates(["n", "digest"]).select("n", "digest", "whole", F.explode("shingles").alias("s")).select("n", "digest", "whole", "s.*"), "shingles")
    shingles = bloom_filter(own.select("token").distinct())
    rarity = rows.select("text").mapInArrow(_counter(shingles, sorted({min(n, shingle) for n in sizes})), "token long, n long").groupBy("token").agg(F.sum("n").alias("rarity"))
    rarity = materialize(rarity, "rarity")
    first = F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "token", "offset")).alias("f")
    index = materialize(own.join(rarity, "token", "left").groupBy("n", "digest", "whole").agg(first).select("n", "digest", "whole", "f.token", "f.offset"), "index")

    prefix, whole = bloom_filter(index.select("token").distinct()), bloom_filter(index.select("whole"))
    found = materialize(rows.mapInArrow(_finder(prefix, whole, sizes, shingle), FOUND), "found")
    for used in (shingles, prefix, whole):
        used.destroy()
    asked = found.where(F.size("proposed") > 0).select("row_id", F.inline("proposed")).withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int"))
    hits = asked.join(salted(index.drop("whole")), ["token", "offset", "n", "digest", "salt"]).select("row_id", "start", "n", "digest", "salt")
    hits = materialize(hits, "hits")

    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row_id").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = hits.select("row_id", new.alias("new")).groupBy("row_id").agg(F.sum("new").alias("n_hit"))
    owners = windows.select("n", "digest", "item").distinct()
    owned = hits.select("row_id", "n", "digest", "salt").distinct().join(salted(owners), ["n", "digest", "salt"])
    owned = owned.groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias("own"))
    out = found.select("row_id", "doc_id", "n_words").join(covered, "row_id", "left").join(owned, "row_id", "left")
    listed = F.coalesce(F.array_join("own", ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("own").isNull(), 0).otherwise(F.size("own")).cast("long").alias("n_items"), listed.alias("items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
