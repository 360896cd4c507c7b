"""Overlays on rings: areas against an exact integration by slabs, and shapes of known areas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import overlay, polygons

RINGS = "poly_id int, part int, hole boolean, ring array<struct<x:double,y:double>>"


def slab_area(polys, inside):
    """Area of the points whose winding numbers satisfy inside: between two neighbouring x of vertices and crossings all sides are straight and apart."""
    segs = [(k, *r[i], *r[(i + 1) % len(r)]) for k, rings in polys.items() for r in rings for i in range(len(r))]
    xs = {s[1] for s in segs}
    for i, (_, ax, ay, bx, by) in enumerate(segs):
        for _, cx, cy, dx, dy in segs[:i]:
            cross = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if cross:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / cross
                if 0 <= t <= 1:
                    xs.add(ax + t * (bx - ax))
    total = 0.0
    xs = sorted(xs)
    for a, b in zip(xs, xs[1:]):
        m, w = (a + b) / 2, dict.fromkeys(polys, 0)
        hits = sorted((ay + (m - ax) / (bx - ax) * (by - ay), k, 1 if bx > ax else -1) for k, ax, ay, bx, by in segs if min(ax, bx) < m < max(ax, bx))
        for (y, k, turn), after in zip(hits, [*hits[1:], None]):
            w[k] += turn
            if after and inside(w):
                total += (after[0] - y) * (b - a)
    return total


def star(pick, cx, cy, n, crossing=False):
    turns = sorted(pick.random() for _ in range(n))
    if crossing:
        pick.shuffle(turns)
    return [(round(cx + (r := pick.uniform(1, 4)) * math.cos(7 * t), 3) if crossing else round(cx + (r := pick.uniform(1, 4)) * math.cos(2 * math.pi * t), 3), round(cy + r * math.sin(7 * t if crossing else 2 * math.pi * t), 3)) for t in turns]


def signed(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2


def frame(spark, rows):
    return spark.createDataFrame([(k, i, h, [tuple(map(float, p)) for p in r]) for k, i, h, r in rows], RINGS)


def area_of(df):
    return {(r["out"], r["other"]): r["area"] for r in overlay.areas(df).collect()}


@pytest.fixture(scope="module")
def scene():
    pick = random.Random(3)
    rows, polys = [], {}
    for k in range(9):
        ring = star(pick, pick.uniform(0, 8), pick.uniform(0, 8), 9)
        ring = ring if signed(ring) > 0 else ring[::-1]
        rows.append((k, 0, False, ring[::-1] if k % 2 else ring))
        polys[k] = [ring]
    # shared sides, touching corners, equal polygons and a hole
    for k, (x, y, w) in enumerate([(0, 0, 2), (2, 0, 2), (2, 2, 2), (0, 0, 2), (1, 1, 2)], 20):
        ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        rows.append((k, 0, False, ring))
        polys[k] = [ring]
    hole = [(1.5, 1.5), (1.5, 2.5), (2.5, 2.5), (2.5, 1.5)]
    rows.append((24, 0, True, hole[::-1]))
    polys[24].append(hole)
    return rows, polys


@pytest.mark.parametrize("square", [1.7, 40.0])
def test_areas_equal_integration(spark, scene, square):
    rows, polys = scene
    rings = frame(spark, rows)
    mask = [k for k in polys if k % 3 == 0]
    masked = lambda w: any(w[m] for m in mask)
    near = lambda a, b: {k: v for k, v in a.items() if v > 1e-9} == pytest.approx({k: v for k, v in b.items() if v > 1e-9}, abs=1e-6)
    assert near(area_of(overlay.union(rings, square)), {(0, -1): slab_area(polys, lambda w: any(w.values()))})
    of_mask = rings.filter(F.col("poly_id").isin(mask))
    assert near(area_of(overlay.intersect(rings, of_mask, square)), {(k, -1): slab_area(polys, lambda w: w[k] and masked(w)) for k in polys})
    assert near(area_of(overlay.subtract(rings, of_mask, square)), {(k, -1): slab_area(polys, lambda w: w[k] and not masked(w)) for k in polys})
    lower = lambda k: [j for j in polys if (-j % 4, j) < (-k % 4, k)]
    assert near(area_of(overlay.resolve(rings, F.pmod(-F.col("poly_id"), F.lit(4)), square)), {(k, -1): slab_area(polys, lambda w: w[k] and not any(w[j] for j in lower(k))) for k in polys})
    got = {(r.a, r.b): r.shared for r in overlay.overlaps(rings, square).collect()}
    want = {(a, b): slab_area(polys, lambda w: w[a] and w[b]) for a in polys for b in polys if a < b}
    assert near(got, {k: v for k, v in want.items() if v > 1e-7})
    kinds = {(r.a, r.b): r.kind for r in overlay.overlaps(rings.filter("poly_id >= 20"), square).collect()}
    assert kinds == {(20, 23): "within", (20, 24): "overlaps", (21, 24): "overlaps", (22, 24): "overlaps", (23, 24): "overlaps"}


@pytest.mark.parametrize("square", [1.7, 40.0])
def test_rings_close_and_have_the_area_of_their_pieces(spark, scene, square):
    rows, polys = scene
    for found in (overlay.union(frame(spark, rows), square), overlay.subtract(frame(spark, rows), frame(spark, rows[:3]), square)):
        rings = overlay.rings_of(found)
        want = {k[0]: v for k, v in area_of(found).items()}
        got = {r.poly_id: r.area for r in polygons.measures(rings).collect()}
        assert got == pytest.approx(want, abs=1e-6)
        for r in rings.collect():
            points = [(p.x, p.y) for p in r.ring]
            assert (signed(points) < 0) == r.hole and len(set(points)) == len(points)


def test_crossing_rings_are_repaired(spark):
    pick = random.Random(9)
    rows = [(k, 0, False, star(pick, 0, 0, n, crossing=True)) for k, n in enumerate([4, 5, 7, 9, 12, 15])]
    rows.append((6, 0, False, [(0, 0), (2, 2), (2, 0), (0, 2)]))
    rows += [(7, 0, False, [(0, 0), (1, 1)]), (8, 0, False, [])]
    fixed = overlay.repair(frame(spark, rows), 2.3)
    got = {r.poly_id: r.area for r in polygons.measures(fixed).collect()}
    want = {k: slab_area({k: [r if signed(r) > 0 else r[::-1]]}, lambda w: w[k]) for k, _, _, r in rows[:7]}
    assert got == pytest.approx(want, abs=1e-6) and got[6] == pytest.approx(2)
    again = {r.poly_id: r.area for r in polygons.measures(overlay.repair(fixed, 3.1)).collect()}
    assert again == pytest.approx(got, abs=1e-6)


def test_sides_through_corners_of_squares(spark):
    # with the same shift in x and y, these diagonals met corners of squares and some lost pieces
    at = [(k, 4.0 * (k % 10), 4.0 * (k // 10)) for k in range(400)]
    rows = [(k, 0, False, [(x, y), (x + 2, y + 2), (x + 2, y), (x, y + 2)]) for k, x, y in at]
    got = overlay.repair(frame(spark, rows), 4.0).groupBy("poly_id").count().collect()
    assert {r["poly_id"]: r["count"] for r in got} == {k: 2 for k, _, _ in at}


def test_buffers_have_their_closed_areas(spark):
    box = [(0, 0), (10, 0), (10, 4), (0, 4)]
    corner = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 8), (0, 8)]
    rows = [(1, 0, False, box), (2, 0, False, box), (3, 0, False, corner), (4, 0, False, box), (4, 0, True, [(4, 1), (6, 1), (6, 3), (4, 3)]), (5, 0, False, box)]
    d = F.when(F.col("poly_id") == 2, -1.0).when(F.col("poly_id") == 5, -2.5).when(F.col("poly_id") == 4, 0.25).otherwise(1.0)
    got = {r.poly_id: r.area for r in polygons.measures(overlay.buffer(frame(spark, rows), d, 3.7)).collect()}
    disc = lambda r: 32 * r * r * math.sin(2 * math.pi / 64)
    want = {1: 40 + 28 + disc(1), 2: 16.0, 4: 40 + 7 + disc(0.25) - 1.5 * 1.5, 3: 32 + 36 + disc(1) * 5 / 4 - 1}
    assert got == pytest.approx(want, abs=1e-6)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert overlay.union(none, 1.0).count() == 0 and overlay.rings_of(overlay.union(none, 1.0)).count() == 0
    assert overlay.alignment(none, 1.0).first().aligned and np.isclose(overlay.alignment(none, 1.0).first().sum_area, 0)


def test_buffers_take_of_a_circle_what_the_strips_leave(spark):
    ring = [(0, 0), (9, 1), (10, 6), (5, 3.5), (4.9, 3.4), (1, 7)]  # sharp, blunt and inward corners and a short side
    rows = frame(spark, [(1, 0, False, ring)])
    got = overlay._around(rows, F.lit(0.5), 64)
    # two corners of a right angle or less take about a quarter of the circle's 64 sides
    sizes = [len(r.ring) for r in got.collect()]
    assert sum(sizes) < 6 * 4 + 2 * 64 + 4 * 45
    whole = polygons.circle(F.col("x"), F.col("y"), F.lit(0.5), 64)
    discs = spark.createDataFrame([(1, float(x), float(y)) for x, y in ring], "poly_id int, x double, y double").select("poly_id", F.lit(0).alias("part"), F.lit(False).alias("hole"), whole.alias("ring"))
    area = lambda df: overlay.areas(overlay.union(df, 2.3)).first()["area"]
    assert area(got) == pytest.approx(area(got.unionByName(discs)), abs=1e-7)


def test_rings_of_small_results_need_no_links(spark, monkeypatch):
    rows = [(k, 0, False, [(3 * k, 0), (3 * k + 2, 0), (3 * k + 2, 2), (3 * k, 2)]) for k in range(20)] + [(30, 0, False, [(0, 5), (2, 5), (1, 6)]), (31, 0, False, [(1, 6), (2, 7), (0, 7)])]
    found = overlay.pieces(overlay.sides(frame(spark, rows), F.least(F.col("poly_id"), F.lit(30))), "union", 1.7)
    read = lambda df: sorted((r.space, r.part, r.hole, [tuple(p) for p in r.ring]) for r in df.collect())
    monkeypatch.setattr(overlay, "PIECES", 0)
    linked = read(overlay.rings_of(found))
    monkeypatch.undo()
    monkeypatch.setattr(overlay, "_rings_by_links", None)
    assert read(overlay.rings_of(found)) == linked and len(linked) == 22
