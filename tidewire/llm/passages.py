"""Removal of passages that repeat across documents, with a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewire.llm import sketch
from tidewire.llm.blocks import BLOCK_BYTES, column, cuts, expand_marked, in_order, pack, read, shards, shrink_marked, text_bytes
from tidewire.llm.tables import texts_in_small_batches
from tidewire.llm.textkit import buffers, give_back, mix, run_hashes, tidy, word_hashes, word_spans

WINDOW = 13
#: Bytes of text whose windows one range of hashes has, on average.
SHARD_BYTES = 8 << 20
ANSWERS = "block long, shard long, n long, bits binary"
QUESTIONS = "shard long, block long, n long, bits binary, hashes binary, checks binary, ids binary"
#: What a block tells itself (n of its own rows): windows that an earlier document of the block has, windows asked about, the range of each, further windows like one of these, and that one.
LATE, ASKED, RANGES, ALIKE, LIKE = range(5)
_LAST = np.iinfo(np.int64).max


class Words:
    """Words of a block, and the first word of each of its windows."""

    def __init__(self, table: pa.Table, k: int):
        self.k = k
        self.data, self.offs = buffers(table.column("text"))
        self.starts, self.ends, self.rows = word_spans(self.data, self.offs)
        self.each = np.maximum(np.diff(self.rows) - k + 1, 0)
        self.at = np.arange(self.each.sum()) + np.repeat(self.rows[:-1] - np.cumsum(self.each) + self.each, self.each)


class Windows(Words):
    """All windows of a block with their hashes and their documents' ids, in the order of hashes; ``group`` numbers the distinct hashes."""

    def __init__(self, table: pa.Table, k: int):
        super().__init__(table, k)
        self.hashes = self._hashes(False)
        ids = pc.fill_null(table.column("doc_id").combine_chunks().cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)
        self.order = in_order(self.hashes)
        h, self.ids = self.hashes[self.order], np.repeat(ids, self.each)[self.order]
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        self.first, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.distinct = h[self.first]
        self.least = np.minimum.reduceat(self.ids, self.first) if len(h) else self.ids

    def _hashes(self, second: bool) -> np.ndarray:
        return mix(run_hashes(word_hashes(self.data, self.starts, self.ends, second=second), self.k)[self.at])

    def fingers(self, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Range and place there of the windows, each pair once, whether it counts twice or more, and each distinct hash's index among them."""
        shard, finger = sketch.places(self.distinct, n_shards)
        new = np.r_[True, (shard[1:] != shard[:-1]) | (finger[1:] != finger[:-1])][: len(shard)]
        at = np.flatnonzero(new)
        if len(at):
            shared = self.least != np.maximum.reduceat(self.ids, self.first)
            shared = np.maximum.reduceat(shared, at) | (np.diff(np.r_[at, len(shard)]) > 1)
        else:
            shared = new
        return shard[at], finger[at], shared, np.cumsum(new) - 1

    def checks(self) -> np.ndarray:
        """Second hashes of the windows."""
        return self._hashes(True)


def drop_repeated_passages(docs: DataFrame, k: int = WINDOW, block_bytes: int = BLOCK_BYTES, counter_bits: int = sketch.COUNTER_BITS, keep_layout: bool = False) -> DataFrame:
    """Remove each word that a window of ``k`` words covers which also starts in a document of smaller doc_id.

    Windows are judged on the input. Returns all columns of ``docs`` (with doc_id and text), where ``text`` has the kept
    words joined by one space, and ``n_words``, ``n_removed``; with ``keep_layout`` a text that loses nothing stays as it
    is. Null text stays null with 0 words. Rows of equal doc_id do
    not remove each other's words; a null doc_id comes after all others. Empty table: no rows.

    Three passes: blocks' places of windows are counted by range of hashes, which tells
    each block what windows may repeat; only these are grouped exactly, again by range, to find their least doc_id; each
    block gets one bit for every window that it asked about: whether an earlier document elsewhere has it. Windows are
    equal if two independent hashes of 64 bits are. A block's work in a pass grows with its own text only, and what it
    does for each range is a slice.
    """
    texts_in_small_batches(docs.sparkSession)
    n_shards = shards(docs, text_bytes(docs), SHARD_BYTES)
    blocks = pack(docs, limit=block_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                shard, finger, shared, _ = Windows(read(payload.as_py()), k).fingers(n_shards)
                a, b = cuts(shard)
                if len(a):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard[a]), pa.array(np.full(len(a), number)), pa.array(b - a), pa.array(shrink_marked(finger, shared, a, b), pa.binary()),
                    ], names=["shard", "block", "n", "fingers"])
                give_back()

    @tidy
    def estimate(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        fingers, shared = expand_marked(table.column("fingers").to_pylist(), sizes)
        return _bits(table, sketch.estimated_repeated(fingers, shared, counter_bits), sizes)

    @tidy
    def ask(block: pa.Table, got: pa.Table) -> pa.Table:
        if not (block.num_rows and got.num_rows):
            return questions([])
        return asked_about(block.column("block")[0].as_py(), Windows(read(block.column("payload")[0].as_py()), k), _joined(got), n_shards)

    @tidy
    def answer(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:  # what a block told itself
            return table.select(["block", "shard", "n", "bits"])
        hashes, sizes = column(table, "hashes", "u8")
        checks, _ = column(table, "checks", "u8")
        ids, _ = column(table, "ids", "i8")
        order = in_order(hashes)
        h, c = hashes[order], checks[order]
        same, alike = h[1:] == h[:-1], c[1:] == c[:-1]
        if (same & ~alike).any():  # different windows of one hash
            order = np.lexsort((checks, hashes))
            h, c = hashes[order], checks[order]
            same, alike = h[1:] == h[:-1], c[1:] == c[:-1]
        a = np.flatnonzero(np.r_[True, ~(same & alike)])
        least = np.empty_like(ids)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], a), np.diff(np.r_[a, len(h)]))
        return _bits(table, least < ids, sizes)

    sent = blocks.mapInArrow(count, "shard long, block long, n long, fingers binary")
    estimates = sent.groupBy("shard").applyInArrow(estimate, ANSWERS)
    asked = blocks.groupBy("block").cogroup(estimates.groupBy("block")).applyInArrow(ask, QUESTIONS)
    answers = asked.groupBy("shard").applyInArrow(answer, ANSWERS)
    names = docs.columns
    schema = docs.select("*").schema.add("n_words", "long").add("n_removed", "long")
    empty = pa.schema([(n, t) for n, t in _arrow_fields(docs)] + [("n_words", pa.int64()), ("n_removed", pa.int64())]).empty_table()

    @tidy
    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        if not block.num_rows:
            return empty
        table = read(block.column("payload")[0].as_py())
        w = Words(table, k)
        late = np.zeros(len(w.at), bool)
        if got.num_rows:
            mine = pc.less(got.column("shard"), 0)
            told = got.filter(mine)
            own = dict(zip(told.column("n").to_pylist(), told.column("bits").to_pylist()))
            asked = np.flatnonzero(_unpacked(own[ASKED], len(late)))
            late[asked[np.argsort(np.frombuffer(own[RANGES], _range_type(n_shards)), kind="stable")]] = _joined(got.filter(pc.invert(mine)))
            late[np.frombuffer(own[ALIKE], "u4")] = late[np.frombuffer(own[LIKE], "u4")]
            late |= _unpacked(own[LATE], len(late))
        edge = np.zeros(len(w.starts) + 1, np.int8)
        edge[w.at[late]] += 1
        edge[w.at[late] + k] -= 1
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        sizes = np.diff(w.rows)
        removed = sizes - np.diff(np.r_[0, np.cumsum(~gone)][w.rows])
        valid = table.column("text").is_valid().to_numpy()
        table = table.set_column(names.index("text"), "text", _kept(w, gone, removed, valid, keep_layout).cast(table.schema.field("text").type))
        return table.append_column("n_words", pa.array(sizes, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def asked_about(number: int, w: Windows, may: np.ndarray, n_shards: int) -> pa.Table:
    """What a block tells itself, and its windows that may repeat, for each range; ``may`` has a mark for each place that the block sent."""
    may = may[w.fingers(n_shards)[3]]
    late = w.ids > w.least[w.group]
    at = np.flatnonzero(~late & may[w.group])
    group = w.group[at]
    first = np.r_[True, group[1:] != group[:-1]][: len(at)]
    which = w.order[at[first]]
    own = {LATE: _marks(w.order[late], len(w.at)), ASKED: _marks(which, len(w.at)), ALIKE: w.order[at[~first]].astype("u4"), LIKE: which[(np.cumsum(first) - 1)[~first]].astype("u4")}
    which.sort()
    shard, _ = sketch.places(w.hashes[which], n_shards)
    own[RANGES] = shard.astype(_range_type(n_shards))
    by = np.argsort(own[RANGES], kind="stable")
    which, shard = which[by], shard[by]
    ids = np.empty_like(w.ids)
    ids[w.order] = w.ids
    packed = w.hashes[which].tobytes(), w.checks()[which].tobytes(), ids[which].tobytes()
    rows = [(-1 - number, number, n, x.tobytes(), b"", b"", b"") for n, x in own.items()]
    for a, b in zip(*(x.tolist() for x in cuts(shard))):
        rows.append((int(shard[a]), number, b - a, b"", *(x[8 * a : 8 * b] for x in packed)))
    return questions(rows)


def questions(rows: list[tuple]) -> pa.Table:
    names = ("shard", "block", "n", "bits", "hashes", "checks", "ids")
    return pa.table([pa.array([r[j] for r in rows], pa.int64() if j < 3 else pa.binary()) for j in range(len(names))], names=names)


def _range_type(n_shards: int) -> str:
    return "u2" if n_shards <= 1 << 16 else "u4"


def _kept(w: Words, gone: np.ndarray, removed: np.ndarray, valid: np.ndarray, keep_layout: bool) -> pa.Array:
    """Each row's words that are not gone, joined by one space, all rows at once; with ``keep_layout`` the text itself if none is."""
    row = np.repeat(np.arange(len(removed)), np.diff(w.rows))
    whole = (removed == 0) & keep_layout
    stay = np.flatnonzero(~gone & ~whole[row])
    more = np.r_[row[stay][1:] == row[stay][:-1], False][: len(stay)]  # another word follows in the row
    text, edge = w.data.copy(), np.zeros(len(w.data) + 2, np.int8)
    text[w.ends[stay[more]]] = 32
    full = np.flatnonzero(whole & (np.diff(w.offs) > 0))
    edge[w.starts[stay]] += 1
    edge[w.ends[stay] + more] -= 1
    edge[w.offs[full]] += 1
    edge[w.offs[full + 1]] -= 1
    part = np.cumsum(edge[: len(text)], dtype=np.int8).view(bool)
    ends = np.r_[0, np.cumsum(part)][w.offs]
    return pa.LargeStringArray.from_buffers(len(removed), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text[part]), pa.array(valid).buffers()[1])


def _bits(table: pa.Table, marks: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Marks of all rows of a shard, dealt to these rows."""
    ends = np.cumsum(sizes)
    bits = [np.packbits(marks[e - s : e]).tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _marks(at: np.ndarray, n: int) -> np.ndarray:
    """The n marks that are set at these places, packed."""
    marks = np.zeros(n, bool)
    marks[at] = True
    return np.packbits(marks)


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)


def _joined(answers: pa.Table) -> np.ndarray:
    """Marks of a block from all shards, in their order."""
    rows = sorted(zip(answers.column("shard").to_pylist(), answers.column("n").to_pylist(), answers.column("bits").to_pylist()))
    return np.concatenate([np.zeros(0, bool), *(_unpacked(bits, n) for _, n, bits in rows)])


def _arrow_fields(df: DataFrame) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [(f.name, f.type) for f in to_arrow_schema(df.schema)]
