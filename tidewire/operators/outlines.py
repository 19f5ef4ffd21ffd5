"""Outlines of regions within a budget of vertices: one pass over each ring tells what every tolerance would leave of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tidewire.operators.lineage import cut

#: Vertices of a unit, the first tolerance in degrees, how often it is doubled, and how many tolerances a ring must span.
BUDGET, TOLERANCE, ROUNDS, SPAN = 4000, 0.0005, 12, 4
_TOLERANCES = TOLERANCE * 2.0 ** np.arange(ROUNDS)
_PASS = StructType([StructField("levels", ArrayType(IntegerType())), StructField("counts", ArrayType(LongType())), StructField("extents", ArrayType(DoubleType()))])


def _weights(xy: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each vertex of rings, which begin at ``starts``, the greatest squared tolerance below which Douglas and Peucker's rule keeps it.

    The rule splits at the farthest vertex whatever the tolerance is, and stops where that is near: so a vertex stays while its own distance
    and those of all splits above it exceed the tolerance. The splits of one depth are made together for all rings.
    """
    weight = np.zeros(len(xy))
    a, b = starts, np.append(starts[1:], len(xy)) - 1
    weight[a] = weight[b] = np.inf
    above = np.full(len(a), np.inf)
    while True:
        wide = b - a >= 2
        a, b, above = a[wide], b[wide], above[wide]
        if not len(a):
            return weight
        n = b - a - 1
        first = np.cumsum(n) - n
        span = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(span)) - first[span] + a[span] + 1
        side, arm = xy[b] - xy[a], xy[at] - xy[a[span]]
        length = (side**2).sum(axis=1)
        dot = (arm * side[span]).sum(axis=1)
        along = np.clip(np.divide(dot, length[span], out=np.zeros(len(dot)), where=length[span] > 0), 0, 1)
        away = ((arm - along[:, None] * side[span]) ** 2).sum(axis=1)
        most = np.maximum.reduceat(away, first)
        hits = np.flatnonzero(away == most[span])
        m = at[hits[np.searchsorted(hits, first)]]  # the first of the farthest
        split = most > 0
        a, b, m, w = a[split], b[split], m[split], np.minimum(above, most)[split]
        weight[m] = w
        a, b, above = np.concatenate([a, m]), np.concatenate([m, b]), np.concatenate([w, w])


def _extents(xy: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return (np.maximum.reduceat(xy, starts) - np.minimum.reduceat(xy, starts)).max(axis=1)


def levels_of_all(lng: np.ndarray, lat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``levels_of`` many rings, one after another with ``sizes`` vertices, at once: levels of vertices, counts and extents of rings by round."""
    xy = np.column_stack([lng, lat]).astype(float)
    levels, counts, extents = np.full(len(xy), ROUNDS, dtype=np.int32), np.zeros((ROUNDS + 1, len(sizes)), np.int64), np.zeros((ROUNDS + 1, len(sizes)))
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return levels, counts.T, extents.T
    sizes = sizes[filled]
    ring, weight = np.repeat(np.arange(len(sizes)), sizes), _weights(xy, np.cumsum(sizes) - sizes)
    now, left = np.arange(len(xy)), sizes
    counts[0, filled], extents[0, filled] = left, _extents(xy, np.cumsum(left) - left)
    for r, tolerance in enumerate(_TOLERANCES):
        if (left > 4).any():
            of = ring[now]
            stays = weight[now] > tolerance**2
            few = (np.bincount(of[stays], minlength=len(sizes)) < 4)[of]
            place = np.arange(len(now)) - (np.cumsum(left) - left)[of]
            stays = np.where((left <= 4)[of], True, np.where(few, place < 4, stays))
            levels[now[~stays]] = r
            now = now[stays]
            left = np.bincount(ring[now], minlength=len(sizes))
        counts[r + 1, filled], extents[r + 1, filled] = left, _extents(xy[now], np.cumsum(left) - left)
    return levels, counts.T, extents.T


def levels_of(lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, list[int], list[float]]:
    """How many rounds each vertex stays, and the ring's vertices and extent before the first round and after each.

    A ring of at most four vertices stays as it is; one of which a round would leave fewer becomes the first four that it had.
    """
    levels, counts, extents = levels_of_all(lng, lat, np.array([len(lng)]))
    return levels, counts[0].tolist(), extents[0].tolist()


@F.arrow_udf(_PASS)
def _passed(rings: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in rings:
        sizes = batch[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        levels, counts, extents = levels_of_all(*(x.flatten().to_numpy(zero_copy_only=False) for x in batch), sizes)
        lists = lambda values, lengths, kind: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values.ravel(), kind))
        each = np.full(len(sizes), ROUNDS + 1)
        yield pa.StructArray.from_arrays([lists(levels, sizes, pa.int32()), lists(counts, each, pa.int64()), lists(extents, each, pa.float64())], ["levels", "counts", "extents"])


def _first(rule) -> F.Column:
    """The first round for which the rule holds, or ROUNDS."""
    return F.coalesce(*(F.when(rule(r), r) for r in range(ROUNDS)), F.lit(ROUNDS))


def simplified(rings: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows (unit_id, polygon, ring, points) with the vertices that keep each unit within the budget, if a tolerance of the twelve does.

    rings: unit_id, polygon, ring, points (array of structs with lng, lat; ring 0 is a polygon's outer one); further columns are not read. A
    unit within the budget stays as it is. Else it takes the first tolerance that brings it there, or the last. With each tolerance, holes
    that span less than four times it go, as they were before it, then rings are simplified, and polygons whose outer ring spans less go with
    their holes; the polygon of least number always stays. Rows without unit, polygon or ring are left out, as are points without a
    coordinate; a repeated row counts again; a ring without points (or null) stays empty.

    A unit's rings stay apart: they meet only in sums by round, so a unit of very many rings is no task of its own.
    """
    whole = F.filter(F.coalesce("points", F.array()), lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())
    given = rings.where("unit_id IS NOT NULL AND polygon IS NOT NULL AND ring IS NOT NULL").select("unit_id", "polygon", "ring", whole.alias("points"))
    coordinates = (F.transform("points", lambda p: p["lng"].cast("double")), F.transform("points", lambda p: p["lat"].cast("double")))
    done = given.withColumn("_p", _passed(*coordinates)).select("unit_id", "polygon", "ring", "points", "_p.*")
    small = lambda r, at: F.col("extents")[at] < F.lit(float(_TOLERANCES[r] * SPAN))
    done = cut(done.withColumn("_out", F.when(F.col("ring") == 0, _first(lambda r: small(r, r + 1))).otherwise(_first(lambda r: small(r, r)))))
    main = done.groupBy("unit_id").agg(F.min("polygon").alias("_main"))
    outer = done.where("ring = 0").groupBy("unit_id", "polygon").agg(F.max("_out").alias("_polygon_out"))
    outer = outer.join(main, "unit_id").select("unit_id", "polygon", F.when(F.col("polygon") == F.col("_main"), ROUNDS).otherwise(F.col("_polygon_out")).alias("_polygon_out"))
    gone = F.coalesce("_polygon_out", F.lit(ROUNDS))
    alive = done.join(outer, ["unit_id", "polygon"], "left").withColumn("_gone", F.when(F.col("ring") == 0, gone).otherwise(F.least(gone, F.col("_out"))))
    sums = alive.groupBy("unit_id").agg(F.sum(F.col("counts")[0]).alias("_all"), *(F.sum(F.when(F.col("_gone") > r, F.col("counts")[r + 1]).otherwise(0)).alias(f"_n{r}") for r in range(ROUNDS)))
    chosen = F.when(F.col("_all") <= budget, -1).otherwise(F.least(_first(lambda r: F.col(f"_n{r}") <= budget), F.lit(ROUNDS - 1)))
    kept = alive.join(sums.select("unit_id", chosen.alias("_round")), "unit_id").where(F.col("_gone") > F.col("_round"))
    paired = F.filter(F.arrays_zip("points", "levels"), lambda x: x["levels"] > F.col("_round"))
    return kept.select("unit_id", "polygon", "ring", F.transform(paired, lambda x: x["points"]).alias("points"))
