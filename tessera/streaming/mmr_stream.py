"""Arrival-order edge MMRs over a stream: state is the peaks of an edge, at most 32."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame

ROOTS = "eid long, k long, root string, lo long, hi long"
STATE = "k long, heights array<int>, hashes array<string>, los array<long>, his array<long>, tail long"


def u32(x: int) -> bytes:
    return int(x).to_bytes(4, "big")


def append(peaks: list[tuple], k: int, tid: str, start: int, end: int) -> int:
    """Add a leaf to the peaks (height, hash, lo, hi) and merge once for each trailing 1 bit of k."""
    peaks.append((0, hashlib.sha256(bytes.fromhex(tid) + u32(start) + u32(end)).hexdigest(), start, end))
    while k & 1:
        right, left = peaks.pop(), peaks.pop()
        data = b"".join(bytes.fromhex(h) + u32(lo) + u32(hi) for _, h, lo, hi in (left, right))
        peaks.append((left[0] + 1, hashlib.sha256(data).hexdigest(), min(left[2], right[2]), max(left[3], right[3])))
        k >>= 1
    return len(peaks)


def root(peaks: list[tuple], k: int) -> str:
    return hashlib.sha256(u32(k) + b"".join(bytes.fromhex(h) + u32(lo) + u32(hi) for _, h, lo, hi in peaks)).hexdigest()


def _step(safe: bool):
    def step(key, frames, state):
        k, heights, hashes, los, his, tail = state.get if state.exists else (0, [], [], [], [], 0)
        peaks = list(zip(heights, hashes, los, his, strict=True))
        rows = pd.concat(list(frames)).sort_values(["arrival_seq"])
        for tid, start, end in zip(rows["tid"], rows["start_ts"], rows["end_ts"], strict=True):
            if safe and start < tail:
                continue  # late for its edge
            append(peaks, k, tid, int(start), int(end))
            k, tail = k + 1, max(tail, int(start))
        state.update((k, [p[0] for p in peaks], [p[1] for p in peaks], [p[2] for p in peaks], [p[3] for p in peaks], tail))
        yield pd.DataFrame({"eid": [key[0]], "k": [k], "root": [root(peaks, k)], "lo": [min((p[2] for p in peaks), default=0)], "hi": [max((p[3] for p in peaks), default=0)]})

    return step


def stream_roots(entries: DataFrame, *, time_safe: bool = False) -> DataFrame:
    """Roots of the edges that a micro-batch touches; entries: eid, tid, start_ts, end_ts, arrival_seq.

    time_safe drops entries that start before the latest start their edge has seen.
    """
    return entries.groupBy("eid").applyInPandasWithState(_step(time_safe), ROOTS, STATE, "update", "NoTimeout")
