"""Bounded Bloom filters of ids, which keep rows out of a shuffle that a join would drop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import sketch
from tidewire.llm.blocks import scaled
from tidewire.llm.tables import cut
from tidewire.llm.textkit import mix

#: Ids of which a filter is made for a broadcast: 16 bits each are 16 MB. More are for a join.
MAX_IDS = 1 << 23
#: Ids that pass a filter wrongly and are broadcast to be left out; some 14 in a thousand of a table's other ids pass.
MAX_WRONG = 1 << 20


def membership(values: DataFrame, name: str, count: int) -> tuple[int, bytes]:
    """Width and bits of a filter with two positions of each long."""
    width = max(1 << 16, 16 * count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch.column(0).drop_null().to_numpy().view(np.uint64))
            spots = np.unique(np.r_[mix(h), mix(~h)])
            yield sketch.part(spots, np.ones(len(spots), bool), width)

    return width, sketch.collect(values.select(name).mapInArrow(run, sketch.SCHEMA), width)[0]


def may_have(rows: DataFrame, name: str, known: tuple[int, bytes], nulls: bool = False) -> DataFrame:
    """Rows whose long ``name`` may be in a filter; rows with null too if ``nulls``."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, bits = shared.value
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            h = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False).view(np.uint64)
            valid = batch.column(name).is_valid().to_numpy(zero_copy_only=False)
            keep = valid
            for x in (mix(h), mix(~h)):
                at = scaled(x, width)
                keep = keep & ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)
            yield batch.filter(pa.array(keep | ~valid if nulls else keep))

    return rows.mapInArrow(run, rows.schema)


def having(rows: DataFrame, name: str, wanted: DataFrame, most: int = 2 * MAX_IDS) -> DataFrame:
    """Rows whose long ``name`` is among the ``name`` of wanted, exactly.

    Up to ``most`` wanted ids go to the rows as a filter, with the list of ids that pass it wrongly, so that of a row only
    its id is shuffled. With more of either, rows are joined by shuffle.
    """
    wanted, count = wanted.select(name), wanted.count()
    if count <= most:
        known = membership(wanted, name, count)
        wrong = cut(may_have(rows.select(name), name, known).distinct().join(wanted, name, "left_anti"))
        rows = may_have(rows, name, known)
        if wrong.count() <= MAX_WRONG:
            return rows.join(F.broadcast(wrong), name, "left_anti")
    return rows.join(wanted, name, "left_semi")
