"""Blocks of documents that exchange packed hash arrays with hash-range shards.

Counting every window or n-gram of a corpus as a row of its own costs far more shuffle than the text. So documents are
packed into blocks of a few MB; a block sends each shard one sorted array of its distinct hashes, the shard answers each
block with one array, and the block is read again beside the answers. Hot groups of copies meet inside a block first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


def _write(batches: list[pa.RecordBatch], level: int) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(batches).combine_chunks()  # a column's text is compressed as one
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read(payload: bytes) -> pa.Table:
    """Rows of a block."""
    return pa.ipc.open_stream(payload).read_all()


def pack(docs: DataFrame, text: str = "text", limit: int = BLOCK_BYTES, level: int = 1) -> DataFrame:
    """Rows (block, payload): each payload has consecutive rows of a partition with at most ``limit`` bytes of text, or one row.

    ``level``: effort of the compression; 9 takes a fifth off the shuffled text of level 1 at some five times its seconds.

    A block's number depends on its place in the input, so the input must give the same partitions when read again, as
    files do. The result is dealt by block; plans that use it more than once share that exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, size
            row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_write(held, level)], pa.large_binary())], ["block", "payload"])
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            at = 0
            while at < len(ends):
                used = ends[at - 1] if at else 0
                to = int(np.searchsorted(ends, used + limit - size, "right"))
                if to <= at and held:
                    yield block()
                    continue
                to = max(to, at + 1)
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - used)
                at = to
                if size >= limit:
                    yield block()
        if held:
            yield block()

    return docs.mapInArrow(run, "block long, payload binary").repartition("block")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0


def shards(docs: DataFrame, total_bytes: int, shard_bytes: int) -> int:
    """So many shards that each has about ``shard_bytes`` of text's hashes, and every task has some."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total_bytes // shard_bytes, 1)


def scaled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes as numbers from 0 to n - 1 (n < 2**32), in the same order."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of sorted keys, and their ends."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


def shrink(positions: np.ndarray) -> bytes:
    """Sorted distinct positions as compressed gaps."""
    gaps = np.diff(positions, prepend=0)
    big = gaps // 65535
    if big.any():
        at = np.cumsum(big + 1) - 1
        short = np.full(int(big.sum()) + len(gaps), 65535, np.uint16)
        short[at] = gaps % 65535
    else:
        short = gaps.astype(np.uint16)
    return zlib.compress((short >> 8).astype(np.uint8).tobytes() + (short & 255).astype(np.uint8).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    short = raw[: len(raw) // 2].astype(np.int64) << 8 | raw[len(raw) // 2 :]
    return np.cumsum(short)[short != 65535]


def shrink_marked(positions: np.ndarray, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Runs of sorted distinct positions below 2**31, each with a mark: the mark is the last bit of the gap, gaps have as many bytes as a run needs, equal bytes stand together for the shuffle's compression."""
    gaps = np.diff(positions, prepend=0)
    gaps[starts] = positions[starts]
    value = gaps << 1 | marks
    planes = np.ascontiguousarray(value.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    wide = [max(1, x.bit_length() + 7 >> 3) for x in np.maximum.reduceat(value, starts).tolist()]
    return [planes[:n, a:b].tobytes() for n, a, b in zip(wide, starts.tolist(), ends.tolist())]


def expand_marked(data: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and marks of all runs, joined."""
    ends = np.cumsum(sizes)
    planes = np.zeros((4, int(sizes.sum())), np.uint8)
    for x, n, end in zip(data, sizes.tolist(), ends.tolist()):
        planes[: len(x) // n, end - n : end] = np.frombuffer(x, np.uint8).reshape(-1, n)
    value = np.ascontiguousarray(planes.T).view("<u4").ravel()
    at = np.cumsum(value >> 1, dtype=np.int64)
    return at - np.repeat(np.r_[0, at[ends[:-1] - 1]], sizes), (value & 1).astype(bool)


def in_order(hashes: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit hashes. These are sorted with their places in the low bits, which is faster than to sort places; where the high bits don't tell all apart, places are sorted."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low, high = hashes.min(), hashes.max()
    free = np.uint64(64 - int(high - low).bit_length() if high > low else 0)
    mask = np.uint64((1 << len(hashes).bit_length()) - 1)
    order = (np.sort((hashes - low << free) & ~mask | np.arange(len(hashes), dtype=np.uint64)) & mask).astype(np.int64)
    got = hashes[order]
    return order if (got[1:] >= got[:-1]).all() else np.argsort(hashes, kind="stable")


def column(table: pa.Table, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays of a binary column, joined, and the length of each."""
    parts = [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(x) for x in parts], np.int64)
