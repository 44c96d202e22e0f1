"""Document fingerprints by consistent weighted sampling.

Each term of a document has a weight, 1 + ln(count). For every coordinate a term
draws r and c from Gamma(2, 1) and b from [0, 1), all fixed by its hash, and
    t = floor(ln(weight) / r + b),  ln a = ln(c) - r * (t - b) - r.
The term with the least a, together with its t, is the sample. Two documents have
the same sample with a probability equal to their generalised Jaccard similarity,
the sum of the least weights over the sum of the greatest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import GOLD, WordHash, distinct, lean, materialize, mix, small_batches

LOWEST = -(1 << 63)
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gammas(terms: np.ndarray, coords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln(c) of every term and coordinate; some terms at a time, so that they stay in a core's cache."""
    out = tuple(np.empty((len(terms), coords), np.float32) for _ in range(3))
    for low in range(0, len(terms), 256):
        for whole, part in zip(out, _gammas(terms[low : low + 256], coords), strict=True):
            whole[low : low + 256] = part
    return out


def _gammas(terms: np.ndarray, coords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    salt = mix(np.arange(1, coords + 1, dtype=np.uint64) * GOLD)
    one = mix(terms[:, None] ^ salt[None, :])
    two = mix(one + GOLD)
    low = np.uint64((1 << 24) - 1)

    def uniform(x: np.ndarray, shift: int) -> np.ndarray:
        return (((x >> np.uint64(shift)) & low).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)

    r = -np.log(uniform(one, 0) * uniform(one, 24))
    c = -np.log(uniform(two, 0) * uniform(two, 24))
    b = ((one >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
    return r, b, np.log(c)


def with_single(r: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """r, b, ln(c) and the ln a of a term of weight 1."""
    return r, b, c, c - r * (1 - b)


def bag(words: list[bytes], hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes in order and their weights."""
    terms, counts = np.unique(hashes.of(words), return_counts=True)
    return terms, (1 + np.log(counts)).astype(np.float32)


def sample(terms: np.ndarray, weights: np.ndarray, params, at: np.ndarray, coords: int) -> np.ndarray:
    """32 bits for each coordinate; zeros without terms. params: of a list of terms, at: the places in it.

    A weight of 1 has t = 0 whatever the term, so that ln a of single words comes ready with the parameters.
    """
    if not len(terms):
        return np.zeros(coords, np.uint32)
    best, pick, level = None, None, None
    cols = np.arange(coords)
    for low in range(0, len(terms), 2048):
        own, w = at[low : low + 2048], weights[low : low + 2048]
        a = params[3][own]
        several = np.flatnonzero(w != 1)
        r, b, c = (x[own[several]] for x in params[:3])
        above = np.floor(np.log(w[several, None]) / r + b)
        a[several] = c - r * (above - b + 1)
        k = a.argmin(axis=0)
        place = np.searchsorted(several, k)
        t = np.vstack([above, np.zeros((1, coords), np.float32)])[np.where(np.append(several, -1)[place] == k, place, len(several)), cols]
        if best is None:
            best, pick, level = a[k, cols], k, t
        else:
            better = a[k, cols] < best
            best = np.where(better, a[k, cols], best)
            pick = np.where(better, k + low, pick)
            level = np.where(better, t, level)
    out = mix(terms[pick] ^ (level.astype(np.int64).view(np.uint64) * GOLD)) >> np.uint64(32)
    return np.maximum(out.astype(np.uint32), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; documents without terms are like each other and like no others."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _worker(coords: int, batch_terms: int):
    def fingerprints(pairs: list[tuple[int, str, str]], hashes: WordHash) -> list[tuple]:
        """Of (doc_id, text, next text) in order, where neighbours share terms."""
        bags, rest = {}, {}
        for doc, (_, text, following) in enumerate(pairs):
            other = edited(text, following)
            bags[doc, 0] = bag(text.encode().lower().split(), hashes)
            bags[doc, 1] = bag(other.encode().lower().split(), hashes)
            rest[doc] = hashlib.sha256(other.encode()).hexdigest()
        last = bag(pairs[-1][2].encode().lower().split(), hashes)
        terms = distinct(np.concatenate([x[0] for x in bags.values()] + [last[0]]))
        sigs: dict = {}
        # parameters of a slice of the terms at a time would cost a merge; long lists go document by document
        params = with_single(*gammas(terms, coords)) if len(terms) <= 4 * batch_terms else None
        for key, (own, weights) in [*bags.items(), ((len(pairs), 0), last)]:
            if params is not None:
                sigs[key] = sample(own, weights, params, np.searchsorted(terms, own), coords)
            else:
                sigs[key] = sample_long(own, weights)
        return [(d, len(text), rest[k], sigs[k, 0].astype(">u4").tobytes().hex(), sigs[k, 1].astype(">u4").tobytes().hex(), likeness(sigs[k, 0], sigs[k, 1]), likeness(sigs[k, 0], sigs[k + 1, 0])) for k, (d, text, _) in enumerate(pairs)]

    def sample_long(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best = np.full(coords, np.inf, np.float32)
        out = np.zeros(coords, np.uint32)
        for low in range(0, len(terms), 4096):
            own, w = terms[low : low + 4096], weights[low : low + 4096]
            r, b, c = gammas(own, coords)
            t = np.floor(np.log(w[:, None]) / r + b)
            a = c - r * (t - b + 1)
            k = a.argmin(axis=0)
            rows = (k, np.arange(coords))
            sig = np.maximum((mix(own[k] ^ (t[rows].astype(np.int64).view(np.uint64) * GOLD)) >> np.uint64(32)).astype(np.uint32), 1)
            out = np.where(a[rows] < best, sig, out)
            best = np.minimum(a[rows], best)
        return out

    @lean
    def run(batches):
        hashes = WordHash()
        names = [x.split()[0] for x in ROW.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, bucket = None, None  # the document before, which waits for its next one
        todo: list[tuple[int, str, str]] = []
        size = 0

        def flush():
            rows = fingerprints(todo, hashes)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                for b, own, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if held is not None and b == bucket:
                        todo.append((*held, text or ""))
                        size += len(held[1])
                    held = (doc, text or "") if own else None
                    bucket = b
                    if todo and (size >= 6 * batch_terms or held is None):
                        yield flush()
                        todo, size = [], 0
        if todo:
            yield flush()

    return run


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coords: int = 64, bucket_bytes: int = 4 << 20, max_buckets: int = 1 << 17, batch_terms: int = 60_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, which borrows from the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many, or all, of the text that follows by ascending doc_id (after the last: the
    first). Terms are words between ASCII white space, A-Z in lower case. near_edited
    and near_next are shares of equal samples, estimates of generalised Jaccard similarity.

    A null text counts as empty; texts without words have a fingerprint of zeros.
    Rows of equal doc_id follow one another by text. A null doc_id comes first. A
    single row is followed by itself. Other columns are ignored.

    Documents are cut into up to max_buckets buckets of about bucket_bytes or more by
    ranges of the id, whose bounds come from a quantile sketch; each bucket also gets the first row of the
    next one, so that one shuffle of the texts serves all. A bucket is streamed in order
    by one task, whatever its size (some 800 MB at 100 TB); rows of one id are in one bucket.
    A very long text's terms are sampled in slices.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not count:
        return spark.createDataFrame([], ROW)
    n = max(1, min(count, max_buckets, -(-int(total or 0) // bucket_bytes)))
    bounds = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    low = np.array([int(x) for x in bounds], np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(low, ids.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(LOWEST))))
    firsts = materialize(rows.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(LOWEST))).alias("low")), "firsts")
    order = [r[0] for r in firsts.select("bucket").orderBy("bucket").collect()]  # one for each bucket
    before = {b: order[k - 1] for k, b in enumerate(order)}
    link = spark.createDataFrame(list(before.items()), "bucket int, previous int")
    starts = firsts.join(link, "bucket").select("low", "previous")  # one for each bucket
    heads = rows.withColumn("low", F.coalesce("doc_id", F.lit(LOWEST))).join(F.broadcast(starts), "low")
    heads = heads.groupBy("previous").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.col("previous").alias("bucket"), F.lit(False).alias("own"), F.lit(None).cast("long").alias("doc_id"), "text")
    dealt = rows.select("bucket", F.lit(True).alias("own"), "doc_id", "text").union(heads)
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("own"), F.asc_nulls_first("doc_id"), F.coalesce("text", F.lit("")))
    return dealt.mapInArrow(_worker(coords, batch_terms), ROW)

