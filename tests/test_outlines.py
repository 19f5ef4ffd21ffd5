import math
import random

from tidewire.operators import outlines

SCHEMA = "unit_id string, polygon int, ring int, points array<struct<lng: double, lat: double>>, levels string"


def away(p, a, b):
    (px, py), (ax, ay), (bx, by) = p, a, b
    dx, dy = bx - ax, by - ay
    t = max(0, min(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2


def thin(ring, tolerance):
    if len(ring) < 3:
        return ring
    far = max(range(1, len(ring) - 1), key=lambda i: (away(ring[i], ring[0], ring[-1]), -i))
    if away(ring[far], ring[0], ring[-1]) <= tolerance**2:
        return [ring[0], ring[-1]]
    return thin(ring[: far + 1], tolerance)[:-1] + thin(ring[far:], tolerance)


def span(ring):
    return max(max(v) - min(v) for v in zip(*ring, strict=True))


def round_by_round(unit, budget):
    """unit: {polygon: {ring: points}}; each round works on what the last one left."""
    size = lambda u: sum(len(r) for p in u.values() for r in p.values())
    if size(unit) <= budget:
        return unit
    tolerance, main = 0.0005, min(unit)
    for _ in range(12):
        rings = {p: {k: r for k, r in x.items() if k == 0 or span(r) >= 4 * tolerance} for p, x in unit.items()}
        short = lambda r: (t if len(t := thin(r, tolerance)) >= 4 else r[:4]) if len(r) > 4 else r  # noqa: E731, B023
        rings = {p: {k: short(r) for k, r in x.items()} for p, x in rings.items()}
        unit = {p: x for p, x in rings.items() if p == main or span(x[0]) >= 4 * tolerance}
        if size(unit) <= budget:
            break
        tolerance *= 2
    return unit


def blob(rng, n, radius):
    x, y = rng.uniform(-9, 9), rng.uniform(-9, 9)
    at = [(x + radius * rng.uniform(0.7, 1) * math.cos(2 * math.pi * i / n), y + radius * rng.uniform(0.7, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return at + at[:1]


def test_like_round_by_round(spark):
    rng = random.Random(3)
    units = {f"u{u}": {p: {r: blob(rng, rng.choice([3, 4, 9, 60, 300]), 10 ** rng.uniform(-3.5, 0.3) / (1 + r)) for r in range(rng.choice([1, 1, 2, 4]))} for p in range(rng.choice([1, 5, 12]))} for u in range(12)}
    units["small"] = {4: {0: blob(rng, 20, 1)}}
    units["hard"] = {p: {0: blob(rng, 9, 90)} for p in range(60)}
    rows = [(u, p, r, at, "clash") for u, x in units.items() for p, rings in x.items() for r, at in rings.items()]
    got = {}
    for row in outlines.simplified(spark.createDataFrame(rows, SCHEMA), 300).collect():
        got.setdefault(row.unit_id, {}).setdefault(row.polygon, {})[row.ring] = [tuple(p) for p in row.points]
    assert got == {u: round_by_round(x, 300) for u, x in units.items()}
    assert got["small"] == units["small"] and sum(len(r[0]) for r in got["hard"].values()) > 300
    assert any(len(got[u]) < len(units[u]) for u in units) and any(len(got[u][p]) < len(units[u][p]) for u in got for p in got[u])


def test_odd_rows(spark):
    point = (1.0, 2.0)
    rows = [("a", 0, 0, None, None), ("a", 0, 1, [], None), ("b", 0, 0, [point] * 9, None), ("b", 0, 0, [point] * 9, None), ("c", 1, 2, [point, (None, 1.0), None], None), (None, 0, 0, [point], None), ("d", None, 0, [point], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.unit_id, r.ring, len(r.points)) for r in outlines.simplified(df).collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("b", 0, 9), ("b", 0, 9), ("c", 2, 1)]
    assert sorted((r.unit_id, len(r.points)) for r in outlines.simplified(df, 2).where("unit_id = 'b'").collect()) == [("b", 4), ("b", 4)]
    assert outlines.simplified(df.limit(0)).count() == 0


def test_many_rings_at_once_are_like_each_alone():
    import numpy as np

    rng = random.Random(5)
    rings = [blob(rng, n, 10 ** rng.uniform(-3.5, 0.3)) for n in (3, 4, 5, 9, 60, 300, 4, 700)] + [[], [(1.0, 2.0)], [(1.0, 2.0)] * 9, blob(rng, 40, 2)]
    at = np.array([p for r in rings for p in r])
    levels, counts, extents = outlines.levels_of_all(at[:, 0], at[:, 1], np.array([len(r) for r in rings]))
    first = 0
    for i, ring in enumerate(rings):
        own = np.array(ring).reshape(-1, 2)
        alone = outlines.levels_of(own[:, 0], own[:, 1])
        assert (alone[0].tolist(), alone[1], alone[2]) == (levels[first : first + len(ring)].tolist(), counts[i].tolist(), extents[i].tolist())
        first += len(ring)
        now, tolerance = ring, 0.0005
        for r in range(outlines.ROUNDS):
            now = (t if len(t := thin(now, tolerance)) >= 4 else now[:4]) if len(now) > 4 else now
            assert counts[i][r + 1] == len(now)
            tolerance *= 2
