"""K-means of integer vectors over blocks of kd-trees.

Every block of vectors has a balanced tree whose nodes hold the count, the sum and the bounding box of their vectors. A round
walks the trees with the centroids that may still be nearest to something in a node: a centroid that another one beats at the
corner of the box that favours it most is left out, a node with one centroid left is assigned whole, and leaves are settled
exactly. Trees are built and written once; each round reads them and sends one sum a centroid and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.tables import Scratch

DIM, K, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Vectors of a tree and of a leaf, at most.
BLOCK, LEAF = 4096, 32
#: Numbers that a step over the nodes of a level works on at once.
AT_ONCE = 1 << 21
_EXACT = float(2**52)


def limit(dim: int) -> int:
    """Largest size of a component for which every squared distance is a 64-bit integer."""
    return int(((2**62) / max(dim, 1)) ** 0.5) // 2


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v) of the vectors with exactly ``dim`` components, none null, not finite or beyond ``limit`` once scaled; ``v`` are whole numbers."""
    e = F.col("embedding")
    scaled = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float(limit(dim)))), F.lit(False)))
    return vectors.where(e.isNotNull() & (F.size(e) == dim) & fine).select("vec_id", scaled.alias("v"))


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """A balanced tree: the order of the points, and by level the nodes' lower and upper corners and sums.

    Node i of level l has the points from n * i >> l to n * (i + 1) >> l; a node is split at the middle of its widest side.
    """
    n, order = len(points), np.arange(len(points))
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    for level in range(depth):
        for i in range(1 << level):
            a, m, b = n * i >> level, n * (2 * i + 1) >> (level + 1), n * (i + 1) >> level
            part = points[order[a:b]]
            side = int(np.argmax(part.max(0) - part.min(0)))
            order[a:b] = order[a:b][np.argpartition(part[:, side], m - a)]
    p = points[order]
    starts = (n * np.arange(1 << depth)) >> depth
    low, high, total = [np.minimum.reduceat(p, starts)], [np.maximum.reduceat(p, starts)], [np.add.reduceat(p, starts)]
    for _ in range(depth):
        low.append(np.minimum(low[-1][::2], low[-1][1::2]))
        high.append(np.maximum(high[-1][::2], high[-1][1::2]))
        total.append(total[-1][::2] + total[-1][1::2])
    return order, low[::-1], high[::-1], total[::-1]


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and centres."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4.0 * top * top * points.shape[1] < _EXACT:  # all partial sums are whole doubles
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centres], 1)


def survivors(low: np.ndarray, high: np.ndarray, centres: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which centroids of each node stay: not those that are strictly farther than another one from every point of the box."""
    out = alive.copy()
    step = max(1, AT_ONCE // centres.size)
    for a in range(0, len(low), step):
        lo, hi, on = low[a : a + step], high[a : a + step], alive[a : a + step]
        middle = np.where(on, distances(lo + hi, 2 * centres), np.iinfo(np.int64).max)  # of twice the box's middle
        best = centres[middle.argmin(1)]
        toward = centres[None] - best[:, None]
        corner = np.where(toward > 0, hi[:, None], lo[:, None])
        lead = (toward * (centres[None] + best[:, None] - 2 * corner)).sum(2)  # distance of the centroid less that of the best one, at the corner
        out[a : a + step] = on & (lead <= 0)
    return out


class Tree:
    """A block's tree and its vectors, in the tree's order."""

    def __init__(self, row: dict, dim: int):
        self.n = row["n"]
        self.points = np.frombuffer(row["points"], row["kind"]).reshape(self.n, dim).astype(np.int64)
        self.low, self.high, self.total = (np.frombuffer(row[c], np.int64).reshape(-1, dim) for c in ("low", "high", "total"))

    def assign(self, centres: np.ndarray) -> tuple[list[tuple[int, int, int, np.ndarray]], np.ndarray, np.ndarray]:
        """Whole nodes (first, end, centroid, sum), and the other points' places with their centroids."""
        whole, n = [], self.n
        nodes, alive, at, level = np.zeros(1, np.int64), np.ones((1, len(centres)), bool), 0, 0
        while True:
            here = at + nodes
            alive = survivors(self.low[here], self.high[here], centres, alive)
            settled = alive.sum(1) == 1
            for i, c in zip(nodes[settled], alive[settled].argmax(1)):
                whole.append((int(n * i >> level), int(n * (i + 1) >> level), int(c), self.total[at + i]))
            nodes, alive = nodes[~settled], alive[~settled]
            at += 1 << level
            if at >= len(self.low) or not len(nodes):
                break
            nodes, alive, level = np.c_[2 * nodes, 2 * nodes + 1].ravel(), np.repeat(alive, 2, 0), level + 1
        if not len(nodes):
            return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = n * nodes >> level, n * (nodes + 1) >> level
        places = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
        away = np.where(np.repeat(alive, b - a, 0), distances(self.points[places], centres), np.iinfo(np.int64).max)
        return whole, places, away.argmin(1)


TREE_SCHEMA = "ids array<{id}>, n int, kind string, points binary, low binary, high binary, total binary"


def grow(vectors: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Trees over the vectors (vec_id, v) of each partition, one for each ``block`` of them."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                points = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)
                order, *corners = build(points, leaf)
                top = int(np.abs(points).max(initial=0))
                form = "i2" if top < 2**15 else "i4" if top < 2**31 else "i8"
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id").take(pa.array(order)))
                parts = [points[order].astype(form), *(np.concatenate(x) for x in corners)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int32()), pa.array([form]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["ids", "n", "kind", "points", "low", "high", "total"])

    return vectors.mapInArrow(run, TREE_SCHEMA.format(id=kind))


def first_centres(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the least hashes, in their order; repeated ids are told apart by the components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [r.v for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def round_sums(trees: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of the vectors nearest to each centroid. Every task sends one row a centroid and component, Spark adds them up."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(batch.slice(i, 1).to_pylist()[0], dim)
                whole, places, nearest = tree.assign(centres)
                for a, b, c, total in whole:
                    sums[c, :dim] += total
                    sums[c, dim] += b - a
                if len(places):
                    order = np.argsort(nearest, kind="stable")
                    first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
                    c = nearest[order][first]
                    sums[c, :dim] += np.add.reduceat(tree.points[places][order], first)
                    sums[c, dim] += np.diff(np.r_[first, len(order)])
        some = np.flatnonzero(sums[:, dim])
        at = (some[:, None] * (dim + 1) + np.arange(dim + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[some].ravel(), pa.int64())], ["at", "x"])

    needed = trees.select(F.array().cast("array<int>").alias("ids"), "n", "kind", "points", "low", "high", "total")
    rows = needed.mapInArrow(run, "at long, x long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    got = {r["at"]: int(r.x) for r in rows}
    return {c: (got[c * (dim + 1) + dim], [got[c * (dim + 1) + j] for j in range(dim)]) for c in range(k) if c * (dim + 1) + dim in got}


def assignments(trees: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (vec_id, cluster, distance) of all vectors."""
    kind = trees.schema["ids"].dataType.elementType.simpleString()
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                tree = Tree(block.drop_columns(["ids"]).to_pylist()[0], dim)
                cluster = np.zeros(tree.n, np.int64)
                whole, places, nearest = tree.assign(centres)
                for a, b, c, _ in whole:
                    cluster[a:b] = c
                cluster[places] = nearest
                away = ((tree.points - centres[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([block.column("ids").flatten(), pa.array(cluster, pa.int32()), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def clusters(vectors: DataFrame, dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of all vectors (vec_id, embedding) that ``quantised`` keeps.

    Centroids start as the vectors of the ``k`` least id hashes (fewer if there are fewer vectors), move ``rounds`` times to the
    floored mean of their vectors, and stay where they are without any; ties go to the smaller number. Vectors of another
    length, with components that are null, not finite or too large for 64-bit distances, and null vectors have no row.
    Repeated rows count each; ids may be null or repeat. A sum of distances beyond 64 bits is null. Other columns are left aside. Empty table: no rows. The driver holds
    ``k`` centroids and their sums only.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = quantised(vectors, dim, scale)
    trees = scratch.keep(grow(whole))
    start = first_centres(whole, k, seed)
    if not start:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = [list(map(int, c)) for c in start]
    for _ in range(rounds):
        for c, (n, total) in round_sums(trees, np.array(centres, np.int64)).items():
            centres[c] = [x // n for x in total]
    rows = scratch.keep(assignments(trees, np.array(centres, np.int64)))
    scratch.drop(trees)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))  # k rows
    names = F.array(*(F.lit(digest(c)) for c in centres))
    facts = sums.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.sum("own").over(W.partitionBy()).try_cast("long").alias("inertia"), F.element_at(names, F.col("cluster") + 1).alias("centroid_sha256"))
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

