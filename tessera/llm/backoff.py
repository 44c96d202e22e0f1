"""Stupid-backoff scores of documents from n-gram counts over the whole corpus.

Documents are read in blocks. A block sends its distinct n-grams and their numbers to
the shards of their hashes, where those of all blocks meet: the count table, sorted by
n-gram, is summed there, and joined back to the blocks that asked. Rows between stages
hold compressed arrays, one for each block and shard, so that no n-gram is shuffled more
than once a block, however frequent; a row for each n-gram of each document would
exceed the disk. The score of a word is its n-gram's count over its context's, or
`alpha` times the score of the next shorter n-gram where the count is below `least`; a
document's score is the sum of their logarithms.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WordHash, lean, materialize, mix, ngram_hashes, small_batches, spread, squeezed, steps, summed, utf8_column

BLOCK = "block long, ids array<long>, sizes array<int>, words binary"
ASKED = "shard int, block long, keys binary, counts binary, large binary"
#: Words of a block and shard, and documents of a block.
BLOCK_WORDS = 1 << 20
SHARD_WORDS = 1 << 20


def blocks_of(batches, block_words: int):
    """(block, ids, words of each document) of some block_words words; a block's number comes from its content.

    The same rows in the same order give the same blocks again.
    """
    ids, docs, total = [], [], 0

    def closed() -> tuple[int, list, list[list[bytes]]]:
        content = [(x or 0) & ((1 << 64) - 1) for x in ids] + [len(x) for x in docs] + [sum(x is None for x in ids), *(WordHash.of_text(x) for x in docs)]
        key = mix(np.array(content, np.uint64) + mix(np.arange(len(content), dtype=np.uint64)))
        return int(np.bitwise_xor.reduce(key).view(np.int64)), ids, docs

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for doc, text in zip(part.column(0).to_pylist(), utf8_column(part.column(1)), strict=True):
                own = (text or b"").lower().split()
                ids.append(doc)
                docs.append(own)
                total += len(own)
                if total >= block_words or len(ids) >= block_words:
                    yield closed()
                    ids, docs, total = [], [], 0
    if ids:
        yield closed()


def _blocker(block_words: int):
    @lean
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for block, ids, docs in blocks_of(batches, block_words):
            words = press.compress(b" ".join(b" ".join(x) for x in docs if x))
            row = ([block], [ids], [[len(x) for x in docs]], [words])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)], ["block", "ids", "sizes", "words"])

    return run


def grams(words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length n, hashes of the n-grams that end at each place; 0 where a document has begun since."""
    inside = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for n in range(1, order + 1):
        h = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            h[n - 1 :] = np.maximum(ngram_hashes(words, n), 1)
        h[inside < n - 1] = 0
        out.append(h)
    return out


def _asker(order: int, shards: int, block_words: int):
    @lean
    def run(batches):
        hashes = WordHash()
        for block, _, docs in blocks_of(batches, block_words):
            words = np.concatenate([*(hashes.of(x) for x in docs), np.zeros(0, np.uint64)])
            asked = np.concatenate([x[x > 0] for x in grams(words, np.array([len(x) for x in docs], np.int64), order)])
            keys, counts = np.unique(asked, return_counts=True)
            # the high bits choose the shard, so that a shard's keys stay in order
            cuts = np.searchsorted((keys >> np.uint64(32)).astype(np.int64) * shards >> 32, np.arange(shards + 1))
            some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            for low in range(0, len(some), 256):
                own = some[low : low + 256]
                counted = [packed(counts[cuts[k] : cuts[k + 1]]) for k in own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int32()), pa.array([block] * len(own), pa.int64()), pa.array([steps(keys[cuts[k] : cuts[k + 1]]) for k in own], pa.binary()),
                    pa.array([x[0] for x in counted], pa.binary()), pa.array([x[1] for x in counted], pa.binary()),
                ], ["shard", "block", "keys", "counts", "large"])

    return run


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """One byte each; those of 255 or more follow in eight."""
    return squeezed(np.minimum(counts, 255).astype(np.uint8)), counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(small: bytes, large: bytes) -> np.ndarray:
    out = spread(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def _summer(table: pa.Table) -> pa.Table:
    """All requests of a shard: sums for each."""
    keys = [summed(x) for x in table["keys"].to_pylist()]
    counts = np.concatenate([unpacked(a, b) for a, b in zip(table["counts"].to_pylist(), table["large"].to_pylist(), strict=True)])
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - np.uint64(1)) != 0)
    sums = np.add.reduceat(counts[order], first)
    back = np.empty(len(joined), np.int64)
    back[order] = np.repeat(sums, np.diff(np.append(first, len(joined))))
    cuts = np.cumsum([0, *map(len, keys)])
    answers = [packed(back[cuts[k] : cuts[k + 1]]) for k in range(len(keys))]
    return pa.table({"block": table["block"], "shard": table["shard"], "counts": pa.array([a for a, _ in answers], pa.binary()), "large": pa.array([b for _, b in answers], pa.binary())})


def _scorer(order: int, alpha: float, least: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block (or copies of one) and the sums for its n-grams, shard by shard.

        score leaves out the number of all words, which n_alone words are to be divided by.
        """
        right = right.take(pa.compute.sort_indices(right, [("shard", "ascending")]))
        sums = sums_of_first(right) if right.num_rows else np.zeros(0, np.int64)  # equal blocks ask alike; one answer serves them
        ids, sizes = left["ids"][0].as_py(), np.array(left["sizes"][0].as_py(), np.int64)
        words = WordHash().of(zstandard.ZstdDecompressor().decompress(left["words"][0].as_py()).split())
        own = grams(words, sizes, order)
        # one sort finds the distinct n-grams, in the order in which they were asked for, and their places; 0 is no n-gram
        keys, place = np.unique(np.concatenate(own), return_inverse=True)
        if len(keys) and keys[0] == 0:
            sums = np.concatenate([[0], sums])
        if len(keys) != len(sums):
            raise ValueError("a block's n-grams differ from those that it asked for: its rows must read the same twice")
        count = np.split(sums[place], order) if len(keys) else [x.astype(np.int64) for x in own]
        value, alone = np.log(np.maximum(count[0], 1)), np.ones(len(words), bool)
        for n in range(2, order + 1):
            context = np.concatenate([[0], count[n - 2][:-1]])
            there = own[n - 1] > 0
            seen = there & (count[n - 1] >= least)
            value = np.where(seen, np.log(np.maximum(count[n - 1], 1) / np.maximum(context, 1)), np.where(there, value + math.log(alpha), value))
            alone &= ~seen
        doc = np.repeat(np.arange(len(sizes)), sizes)
        scores, single = np.bincount(doc, value, len(sizes)), np.bincount(doc, alone, len(sizes)).astype(np.int64)
        copies = left.num_rows
        return pa.table({"doc_id": pa.array(ids * copies, pa.int64()), "n_words": pa.array(np.tile(sizes, copies)), "score": pa.array(np.tile(scores, copies)), "n_alone": pa.array(np.tile(single, copies))})

    def sums_of_first(right: pa.Table) -> np.ndarray:
        shard = right["shard"].to_numpy()
        rows = np.flatnonzero(np.diff(shard, prepend=-1))
        part = right.take(pa.array(rows))
        return np.concatenate([unpacked(a, b) for a, b in zip(part["counts"].to_pylist(), part["large"].to_pylist(), strict=True)])

    return score


def stupid_backoff(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, least: int = 2, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shards: int | None = None) -> DataFrame:
    """doc_id, n_words, score, mean_score of every row of docs.

    Words are runs between ASCII white space, A-Z in lower case. Counts are over all
    rows, copies included. The n-gram of length n that ends at a word is used if it
    lies in the document and has been counted `least` times or more; each step down
    costs a factor `alpha`. score is the sum of natural logarithms, mean_score its
    mean. The first words of a document have shorter n-grams without that factor.

    Texts that are null or without words have n_words 0, score 0 and a null
    mean_score. Repeated rows get a row each; a null id stays null. An empty table
    gives an empty result. A text longer than a block is a block of its own, in one
    task's memory. There is a shard for every shard_words words of some 6 bytes, with no
    upper limit, so that tasks stay bounded. docs is read twice and must give the same
    rows in the same order, as files do. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = rows.mapInArrow(_asker(order, shards or max(12, int(n_bytes) // 6 // shard_words), block_words), ASKED)
    sums = asked.groupBy("shard").applyInArrow(_summer, "block long, shard int, counts binary, large binary")
    blocks = rows.mapInArrow(_blocker(block_words), BLOCK)
    scored = blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_scorer(order, alpha, least), "doc_id long, n_words long, score double, n_alone long")
    scored = materialize(scored, "scored")
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    scored = scored.select("doc_id", "n_words", (F.col("score") - F.col("n_alone") * math.log(max(1, total))).alias("score"))
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
