"""Count-min sketches: bounded ones, collected as a bitmap of counters, and ones dealt over shards by range of hash.

In a dealt sketch every range of hashes has a line of its own, of fixed size, so its load is the same for any input. A
part sends a range its windows' places there (FINGER_BITS each, as gaps), which give the counters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.blocks import cuts, expand, scaled, shrink
from tidewire.llm.textkit import mix

SLICE = 1 << 20
DEPTH = 2
#: Bits of a place in a range, and log2 of the counters of a range.
FINGER_BITS, COUNTER_BITS = 26, 26
SCHEMA = "line int, slice int, once binary, twice binary"
_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.binary())


def spots(hashes: np.ndarray, line: int, width: int) -> np.ndarray:
    """The counter of each hash on a line of the sketch."""
    return scaled(hashes if line == 0 else mix(hashes ^ np.uint64(line * 0x9E3779B97F4A7C15 & (2**64 - 1))), width)


def part(hashes: np.ndarray, shared: np.ndarray, width: int) -> pa.RecordBatch:
    """Sketch of distinct hashes; ``shared`` says which count twice or more already. Counts stop at 2."""
    out = []
    for line in range(DEPTH):
        at = spots(hashes, line, width)
        order = np.argsort(at, kind="stable")
        at, two = at[order], shared[order]
        a, b = cuts(at)
        at, two = at[a], (b - a > 1) | two[a]
        piece = at // SLICE
        for x, y in zip(*cuts(piece)):
            here, twice = at[x:y] - piece[x] * SLICE, two[x:y]
            out.append((line, int(piece[x]), shrink(here), shrink(here[twice])))
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(_KINDS)], ["line", "slice", "once", "twice"])


def merge(parts: DataFrame) -> DataFrame:
    """Bits of the counters that reach 2 over all parts."""

    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(SLICE, np.uint8)
        for once, twice in zip(table.column("once").to_pylist(), table.column("twice").to_pylist()):
            at = expand(once)
            count[at] = np.minimum(count[at] + 1, 2)
            count[expand(twice)] = 2
        return pa.table({"line": table.column("line")[:1], "slice": table.column("slice")[:1], "bits": pa.array([np.packbits(count == 2).tobytes()], pa.binary())})

    return parts.groupBy("line", "slice").applyInArrow(run, "line int, slice int, bits binary")


def collect(parts: DataFrame, width: int) -> list[bytes]:
    """The merged bitmap: DEPTH lines of ``width`` bits, so its size is bounded by the caller's width."""
    bits = [np.zeros(-(-width // SLICE) * SLICE // 8, np.uint8) for _ in range(DEPTH)]
    merged = merge(parts).toArrow()
    for line, piece, data in zip(*(merged.column(c) for c in ("line", "slice", "bits"))):
        start = piece.as_py() * SLICE // 8
        bits[line.as_py()][start : start + SLICE // 8] = np.frombuffer(data.as_buffer(), np.uint8)
    return [x.tobytes() for x in bits]


def places(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The range, of n equal ones, of each hash, and its place there; both in the hashes' order."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    shard = (high * np.uint64(n) + (low * np.uint64(n) >> np.uint64(32))) >> np.uint64(32)
    return shard.astype(np.int64), (hashes * np.uint64(n) >> np.uint64(64 - FINGER_BITS)).astype(np.int64)


def estimated_repeated(fingers: np.ndarray, shared: np.ndarray, bits: int = COUNTER_BITS) -> np.ndarray:
    """Which places in one range have a count of 2 or more; ``shared`` ones count twice. All that do have, and others only below FINGER_BITS."""
    at = (fingers >> (FINGER_BITS - bits)).astype(np.uint32)
    near = np.sort(at)
    twice = np.sort(np.r_[near[1:][near[1:] == near[:-1]], at[shared]])
    bits_of = np.zeros((1 << bits) + 7 >> 3, np.uint8)  # a bit for each counter: a byte would be 64 MB in every worker
    if len(twice):
        byte = twice >> np.uint32(3)
        a, _ = cuts(byte)
        bits_of[byte[a]] = np.bitwise_or.reduceat(np.left_shift(1, twice & np.uint32(7)).astype(np.uint8), a)
    return (bits_of[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
