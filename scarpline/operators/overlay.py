"""Set operations on polygons, on their rings: union, intersection, difference, priorities, overlaps, repair and buffers.

Sides are dealt to squares. In each square they are cut where they cross or touch, and each piece gets the winding numbers of all polygons
on both of its sides: from the square's corner, whose windings are running sums over the sides that cross its row, along the left border
and then to the piece. A piece bounds a result where only one of its sides is inside, so no square has to be whole and results
close across squares: pieces are linked end to start, and loops are told by doubling the links. Squares lie askew to round numbers, so no
corner or border meets a vertex. Coordinates are rounded to the tolerance. A polygon is what its rings wind around, whatever the number
of times, with outer rings one way and holes the other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.operators.batches import by_groups
from scarpline.operators.polygons import POINTS, _sides, clean_ring, ring_area
from scarpline.operators.scratch import checkpointed

#: Where the lines between squares lie, in squares: no combination of both numbers by fractions is a fraction, so no side between round places meets a corner.
SHIFT, SHIFT_Y = 0.3819660112501051, 0.7320508075688772
TOLERANCE = 1e-9
#: Results of at most so many pieces are closed in one task, larger ones by joins.
PIECES = 20_000
#: Spaces of at most so many sides are taken whole, others by squares.
WHOLE = 1_000
PIECE = "space long, out long, other long, x1 double, y1 double, x2 double, y2 double"


def sides(rings: DataFrame, space: Column, kind: int = 0, rank: Column | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Sides (space, poly, kind, rank, x1, y1, x2, y2), outer rings counter-clockwise and holes clockwise.

    Only polygons of one space meet. kind is 0 for subjects and 1 for masks. Empty rings and rings of fewer than three points have no sides.
    """
    near = lambda v: F.bround(v / tolerance) * tolerance
    ring = clean_ring(F.transform("ring", lambda p: F.struct(near(p["x"]).alias("x"), near(p["y"]).alias("y"))))
    own = rings.select(space.cast("long").alias("space"), F.col("poly_id").cast("long").alias("poly"), F.lit(kind).alias("kind"), (F.lit(0) if rank is None else rank).cast("double").alias("rank"), F.coalesce("hole", F.lit(False)).alias("hole"), ring.alias("ring"))
    turned = own.withColumn("ring", F.when((ring_area(F.col("ring")) < 0) != F.col("hole"), F.reverse("ring")).otherwise(F.col("ring")))
    each = turned.select("space", "poly", "kind", "rank", F.explode(_sides(F.col("ring"))).alias("s"))
    return each.select("space", "poly", "kind", "rank", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def _squared(own: DataFrame, square: float) -> DataFrame:
    """Each side in every square (row, col) that it passes."""
    at = lambda v, shift: F.floor(v / square - shift)
    line = lambda k: (k + SHIFT_Y) * square
    rows = own.withColumn("row", F.explode(F.sequence(at(F.least("y1", "y2"), SHIFT_Y), at(F.greatest("y1", "y2"), SHIFT_Y))))
    x_at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    low, high = F.greatest(F.least("y1", "y2"), line(F.col("row"))), F.least(F.greatest("y1", "y2"), line(F.col("row") + 1))
    a, b = F.coalesce(x_at(low), F.least("x1", "x2")), F.coalesce(x_at(high), F.greatest("x1", "x2"))
    slack = square * 1e-9  # a border crossed within rounding is crossed for both of its squares
    return rows.withColumn("col", F.explode(F.sequence(at(F.least(a, b) - slack, SHIFT), at(F.greatest(a, b) + slack, SHIFT))))


def _corners(own: DataFrame, square: float) -> DataFrame:
    """The winding number (space, row, col, poly, kind, rank, w) of each polygon around the lower left corner of each square, where it is not 0."""
    line = lambda k: (k + SHIFT_Y) * square
    first, last = F.ceil(F.least("y1", "y2") / square - SHIFT_Y), F.ceil(F.greatest("y1", "y2") / square - SHIFT_Y) - 1
    rows = own.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    x = F.col("x1") + (F.col("x2") - F.col("x1")) * ((line(F.col("row")) - F.col("y1")) / (F.col("y2") - F.col("y1")))
    # to the right of a side that goes up there is one turn less
    met = rows.withColumns({"col": F.floor(x / square - SHIFT), "w": F.when(F.col("y2") > F.col("y1"), -1).otherwise(1)})
    key = ["space", "poly", "kind", "rank", "row"]
    order = Window.partitionBy(*key).orderBy("col")
    runs = met.groupBy(*key, "col").agg(F.sum("w").alias("w")).withColumns({"w": F.sum("w").over(order), "to": F.lead("col").over(order)}).filter("w <> 0 AND to > col")
    return runs.select("space", "poly", "kind", "rank", "row", F.explode(F.sequence(F.col("col") + 1, "to")).alias("col"), "w")


def _cuts(x1, y1, x2, y2, box, tolerance) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(side, x, y) of all places at which a side ends or is cut within a box, rounded; each side's own in order."""
    n = len(x1)
    dx, dy = x2 - x1, y2 - y1
    length = np.hypot(dx, dy)
    side, t, px, py = [], [], [], []

    def put(i, at, x, y):
        side.append(i)
        t.append(at)
        px.append(x)
        py.append(y)

    def on(x, y, k):
        off = np.abs((x - x1[k]) * dy[k] - (y - y1[k]) * dx[k]) / length[k]
        along = ((x - x1[k]) * dx[k] + (y - y1[k]) * dy[k]) / length[k]
        return (off <= tolerance) & (along >= -tolerance) & (along <= length[k] + tolerance)

    every = np.arange(n)
    put(every, np.zeros(n), x1, y1)
    put(every, np.ones(n), x2, y2)
    left, right, low, high = box
    with np.errstate(divide="ignore", invalid="ignore"):
        for limit, start, step in ((left, x1, dx), (right, x1, dx), (low, y1, dy), (high, y1, dy)):
            at = (limit - start) / step
            i = np.flatnonzero((at > 0) & (at < 1))
            across = start is x1
            put(i, at[i], np.full(len(i), limit) if across else x1[i] + at[i] * dx[i], y1[i] + at[i] * dy[i] if across else np.full(len(i), limit))
        for lo in range(0, n, 256):
            i = slice(lo, lo + 256)
            cross = dx[i, None] * dy - dy[i, None] * dx
            ox, oy = x1 - x1[i, None], y1 - y1[i, None]
            at, to = (ox * dy - oy * dx) / cross, (ox * dy[i, None] - oy * dx[i, None]) / cross
            a, b = np.nonzero((at > 0) & (at < 1) & (to > 0) & (to < 1))
            # sides meet once: where an end lies on the other side, no second place some roundings away may cut them
            k = a + lo
            apart = ~(on(x1[b], y1[b], k) | on(x2[b], y2[b], k) | on(x1[k], y1[k], b) | on(x2[k], y2[k], b))
            a, b = a[apart], b[apart]
            # both sides of a crossing have the point of the one that comes first, so the points are the same
            one, two = np.minimum(a + lo, b), np.maximum(a + lo, b)
            first = a + lo < b
            where = np.where(first, at[a, b], to[a, b])
            put(a + lo, at[a, b], x1[one] + where * dx[one], y1[one] + where * dy[one])
            # vertices on a side
            for vx, vy in ((x1, y1), (x2, y2)):
                ox, oy = vx - x1[i, None], vy - y1[i, None]
                off = np.abs(ox * dy[i, None] - oy * dx[i, None]) / length[i, None]
                at = (ox * dx[i, None] + oy * dy[i, None]) / length[i, None] ** 2
                a, b = np.nonzero((off <= tolerance) & (at > 0) & (at < 1))
                put(a + lo, at[a, b], vx[b], vy[b])
    side, t, px, py = (np.concatenate(c) for c in (side, t, px, py))
    order = np.lexsort((t, side))
    near = lambda v: np.round(v / tolerance) * tolerance + 0.0
    return side[order], near(px[order]), near(py[order])


def _windings(ax, ay, bx, by, net, corner, box) -> tuple[np.ndarray, np.ndarray]:
    """The winding numbers (pieces by polygons) left and right of pieces that go up, or to the right where they are level."""
    left, _, low, _ = box
    mx, my = (ax + bx) / 2, (ay + by) / 2
    level = ay == by
    x_low, x_high, y_low, y_high = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    up, east = np.sign(by - ay), np.sign(bx - ax)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope_x, slope_y = (bx - ax) / (by - ay), (by - ay) / (bx - ax)
    sides_of = np.empty((2, len(ax), net.shape[1]))
    for lo in range(0, len(ax), 256):
        i = slice(lo, lo + 256)
        with np.errstate(invalid="ignore"):
            # along the left border up to the piece, then to the right; by all four comparisons the way is a trifle above, or right of, the middle
            y_left = ay + (left - ax) * slope_y
            border = (x_low <= left) & (left < x_high) & (low < y_left) & (y_left <= my[i, None])
            x_here = ax + (my[i, None] - ay) * slope_x
            row = (y_low <= my[i, None]) & (my[i, None] < y_high) & (left < x_here) & (x_here < mx[i, None])
            # along the lower border to below the piece, then up
            x_low_border = ax + (low - ay) * slope_x
            bottom = (y_low <= low) & (low < y_high) & (left < x_low_border) & (x_low_border <= mx[i, None])
            y_here = ay + (mx[i, None] - ax) * slope_y
            column = (x_low <= mx[i, None]) & (mx[i, None] < x_high) & (low < y_here) & (y_here < my[i, None])
        itself = np.arange(len(ax)) == np.arange(len(ax))[i, None]
        row &= ~itself
        column &= ~itself
        across = (border * east - row * up) @ net + corner
        below = (column * east - bottom * up) @ net + corner
        own = net[i]
        sides_of[0, i] = np.where(level[i, None], below + own, across)
        sides_of[1, i] = np.where(level[i, None], below, across - own)
    return sides_of[0], sides_of[1]


def _union(w, kind, rank, poly):
    yield 0, -1, ((w != 0) & (kind == 0)).any(1)


def _each(w, kind, rank, poly):
    for p in np.flatnonzero(kind == 0):
        yield poly[p], -1, w[:, p] != 0


def _intersect(w, kind, rank, poly):
    masked = ((w != 0) & (kind == 1)).any(1)
    for p in np.flatnonzero(kind == 0):
        yield poly[p], -1, (w[:, p] != 0) & masked


def _subtract(w, kind, rank, poly):
    masked = ((w != 0) & (kind == 1)).any(1)
    for p in np.flatnonzero(kind == 0):
        yield poly[p], -1, (w[:, p] != 0) & ~masked


def _first(w, kind, rank, poly):
    order = np.lexsort((poly, rank))
    taken = np.zeros(len(w), bool)
    for p in order:
        yield poly[p], -1, (w[:, p] != 0) & ~taken
        taken |= w[:, p] != 0


def _pairs(w, kind, rank, poly):
    inside = w != 0
    for p, q in zip(*np.nonzero(inside.T.astype(int) @ inside)):
        if poly[p] < poly[q]:
            yield poly[p], poly[q], inside[:, p] & inside[:, q]


RULES: dict[str, Callable] = {"union": _union, "each": _each, "intersect": _intersect, "subtract": _subtract, "first": _first, "pairs": _pairs}


def _box(rows, square: float | None):
    """The borders (left, right, low, high) of a group's square, or of one around all its sides."""
    if square is None:
        xs, ys = np.concatenate([rows["x1"], rows["x2"]]), np.concatenate([rows["y1"], rows["y2"]])
        return xs.min() - 1, xs.max() + 1, ys.min() - 1, ys.max() + 1
    row, col = rows["row"][0], rows["col"][0]
    return tuple((k + shift) * square for k, shift in ((col, SHIFT), (col + 1, SHIFT), (row, SHIFT_Y), (row + 1, SHIFT_Y)))


def _cut_square(square: float | None, tolerance: float):
    """The pieces (ends, windings left and right, whether they lie in it) of a square, or of a whole space where there is none, with its polygons."""

    def run(columns, first, last):
        rows = {c: v[first:last] for c, v in columns.items()}
        space = rows["space"][0]
        is_side = np.ones(last - first, bool) if square is None else np.isnan(rows["w"])
        if not is_side.any():
            return None
        box = _box(rows, square)
        _, whose, index = np.unique(rows["poly"] * 2 + rows["kind"], return_index=True, return_inverse=True)
        corner = np.zeros(len(whose))
        if not is_side.all():
            corner[index[~is_side]] = rows["w"][~is_side]
        sides_here = {c: rows[c][is_side] for c in ("x1", "y1", "x2", "y2")}
        side, px, py = _cuts(*sides_here.values(), box, tolerance)
        here = np.flatnonzero((side[1:] == side[:-1]) & ((px[1:] != px[:-1]) | (py[1:] != py[:-1])))
        ends = np.stack([px[here], py[here], px[here + 1], py[here + 1]], 1)
        # every piece once, upwards or to the right, with how often each polygon has it that way less the other way
        back = (ends[:, 1] > ends[:, 3]) | ((ends[:, 1] == ends[:, 3]) & (ends[:, 0] > ends[:, 2]))
        ends[back] = ends[back][:, [2, 3, 0, 1]]
        ends, which = np.unique(ends, axis=0, return_inverse=True)
        net = np.zeros((len(ends), len(whose)))
        owner = index[is_side][side[here]]
        np.add.at(net, (which.ravel(), owner), np.where(back, -1, 1))
        ax, ay, bx, by = ends.T
        kind, rank, poly = (rows[c][whose] for c in ("kind", "rank", "poly"))
        left, right = _windings(ax, ay, bx, by, net, corner, box)
        mx, my = (ax + bx) / 2, (ay + by) / 2
        own = (mx >= box[0]) & (mx < box[1]) & (my >= box[2]) & (my < box[3])
        return space, ends, left, right, own, box, (kind, rank, poly)

    return run


def _square_pieces(rule: str, square: float | None, tolerance: float):
    inside, cut = RULES[rule], _cut_square(square, tolerance)

    def run(columns, first, last):
        found = cut(columns, first, last)
        if found is None:
            return None
        space, ends, left, right, own, _, polygons = found
        out = []
        n = len(ends)
        for name, other, held in inside(np.concatenate([left, right]), *polygons):
            l, r = held[:n], held[n:]  # noqa: E741
            for at, flip in ((np.flatnonzero(own & l & ~r), False), (np.flatnonzero(own & r & ~l), True)):
                if len(at):
                    e = ends[at][:, [2, 3, 0, 1]] if flip else ends[at]
                    out.append((np.full(len(at), name, "int64"), np.full(len(at), other, "int64"), e))
        if not out:
            return None
        names, others, e = (np.concatenate(v) for v in zip(*out))
        return {"space": np.full(len(e), space, "int64"), "out": names, "other": others, "x1": e[:, 0], "y1": e[:, 1], "x2": e[:, 2], "y2": e[:, 3]}

    return run


def _square_shares(square: float, tolerance: float):
    """What a square's pieces add to the area that each two polygons share, around the square's corner, and to the way around it; a polygon with itself is one pair."""
    cut = _cut_square(square, tolerance)

    def run(columns, first, last):
        found = cut(columns, first, last)
        if found is None:
            return None
        space, ends, left, right, own, box, (_, _, poly) = found
        x, y = box[0], box[2]
        ax, ay, bx, by = (ends[own] - np.array([x, y, x, y])).T
        l, r = (left[own] != 0).astype(float), (right[own] != 0).astype(float)  # noqa: E741
        added = [l.T @ (v[:, None] * l) - r.T @ (v[:, None] * r) for v in (ax * by - bx * ay, bx - ax, by - ay)]
        p, q = np.nonzero(np.triu((added[0] != 0) | (added[1] != 0) | (added[2] != 0)))
        full = lambda v, kind: np.full(len(p), v, kind)
        return {"space": full(space, "int64"), "out": poly[p], "other": poly[q], "x": full(x, float), "y": full(y, float)} | {c: v[p, q] for c, v in zip(("turn", "dx", "dy"), added)}

    return run


def shares(own: DataFrame, square: float, tolerance: float = TOLERANCE) -> DataFrame:
    """The area (space, out, other, area) of the overlap of each two polygons of sides(), out < other, and of each polygon (out = other).

    A square adds up its pieces for all its pairs at once, so no pair's boundary is stored; rows are few for a pair.
    """
    key = ["space", "out", "other"]
    parts = by_groups(_dealt(own, square), ["space", "row", "col"], ["poly", "x1", "y1", "x2", "y2"], _square_shares(square, tolerance), "space long, out long, other long, x double, y double, turn double, dx double, dy double")
    # around a corner of each result, so that large coordinates cancel first
    at = lambda c: F.col(c) - F.min(c).over(Window.partitionBy(*key))
    return parts.withColumn("part", F.col("turn") + at("x") * F.col("dy") - at("y") * F.col("dx")).groupBy(*key).agg((F.sum("part") / 2).alias("area"))


def _dealt(own: DataFrame, square: float) -> DataFrame:
    """The sides of each square (row, col), and the winding numbers w around its corner."""
    dealt = _squared(own, square)
    active = dealt.select("space", "row", "col").distinct()
    corners = _corners(own, square).join(active, ["space", "row", "col"], "left_semi")
    return dealt.withColumn("w", F.lit(None).cast("double")).unionByName(corners.withColumn("w", F.col("w").cast("double")), allowMissingColumns=True)


def pieces(own: DataFrame, rule: str, square: float, tolerance: float = TOLERANCE) -> DataFrame:
    """The boundary (space, out, other, x1, y1, x2, y2) of the results of a rule over sides(), with the inside to the left of each piece.

    Rules: union (out 0), each (every polygon by itself), intersect and subtract (every subject with the masks), first (every polygon
    without those of a lower rank, of equal ones a lower poly_id), pairs (the overlap of out and other, out < other). A task holds the sides
    of one square, so the square should be chosen to have some dozens of them.
    """
    return by_groups(_dealt(own, square), ["space", "row", "col"], ["poly", "x1", "y1", "x2", "y2"], _square_pieces(rule, square, tolerance), PIECE)


def areas(found: DataFrame) -> DataFrame:
    """The area (space, out, other, area) of each result of pieces()."""
    # from a point of each result, so that large coordinates cancel first
    at = found.groupBy("space", "out", "other").agg(F.min("x1").alias("ox"), F.min("y1").alias("oy"))
    x, y = (lambda c: F.col(c) - F.col("ox")), (lambda c: F.col(c) - F.col("oy"))
    return found.join(at, ["space", "out", "other"]).groupBy("space", "out", "other").agg((F.sum(x("x1") * y("y2") - x("x2") * y("y1")) / 2).alias("area"))


def _ring(columns, first, last):
    """One loop's vertices in order, without those on a straight line, from its least one."""
    ids, following, x, y = (columns[c][first:last].tolist() for c in ("id", "next", "x1", "y1"))
    place = dict(zip(ids, zip(following, x, y)))
    at, walk = ids[0], []
    for _ in range(len(place)):
        at, *p = place[at]
        walk.append(p)
    p = np.array(walk)
    before, behind = np.roll(p, 1, 0), np.roll(p, -1, 0)
    a, b = p - before, behind - p
    bend = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9 * (np.hypot(*a.T) * np.hypot(*b.T))
    p = p[bend] if bend.sum() >= 3 else p
    p = np.roll(p, -np.lexsort((p[:, 1], p[:, 0]))[0], 0)
    turned = np.roll(p, -1, 0)
    area = float(((p[:, 0] - p[0, 0]) * (turned[:, 1] - p[0, 1]) - (turned[:, 0] - p[0, 0]) * (p[:, 1] - p[0, 1])).sum() / 2)
    ring = np.empty(1, object)
    ring[0] = [{"x": x, "y": y} for x, y in p.tolist()]
    return {"space": columns["space"][first : first + 1], "poly_id": columns["out"][first : first + 1], "other": columns["other"][first : first + 1], "part": columns["loop"][first : first + 1], "hole": np.array([area < 0]), "ring": ring}


def _loops(columns, first, last):
    """The rings of one result: each piece with the next one, and the loops that they make."""
    own = {c: v[first:last] for c, v in columns.items()}
    x1, y1, x2, y2 = (own[c] for c in ("x1", "y1", "x2", "y2"))
    while True:
        n = len(x1)
        _, at = np.unique(np.concatenate([x1 + 1j * y1, x2 + 1j * y2]), return_inverse=True)
        start, end = at.ravel()[:n], at.ravel()[n:]
        order = np.argsort(start, kind="stable")
        low, high = np.searchsorted(start[order], end), np.searchsorted(start[order], end, "right")
        met = high > low
        if met.all():
            break
        own = {c: v[met] for c, v in own.items()}
        x1, y1, x2, y2 = (own[c] for c in ("x1", "y1", "x2", "y2"))
    if not n:
        return None
    following = order[low]
    for i in np.flatnonzero(high - low > 1):
        some = order[low[i] : high[i]]
        ax, ay, bx, by = x2[i] - x1[i], y2[i] - y1[i], x2[some] - x1[some], y2[some] - y1[some]
        back = (x2[some] == x1[i]) & (y2[some] == y1[i])
        following[i] = some[np.argmax(np.where(back, -4.0, np.arctan2(ax * by - ay * bx, ax * bx + ay * by)))]
    loop, far = own["id"], following
    for _ in range(n.bit_length()):
        loop, far = np.minimum(loop, loop[far]), far[far]
    order = np.lexsort((own["id"], loop))
    sorted_ = {c: v[order] for c, v in (own | {"next": own["id"][following], "loop": loop}).items()}
    bounds = np.flatnonzero(np.r_[True, sorted_["loop"][1:] != sorted_["loop"][:-1], True]).tolist()
    rings = [_ring(sorted_, a, b) for a, b in zip(bounds, bounds[1:])]
    return {c: np.concatenate([r[c] for r in rings]) for c in rings[0]}


def _whole_rings(rule: str, tolerance: float):
    cut = _square_pieces(rule, None, tolerance)

    def run(columns, first, last):
        found = cut(columns, first, last)
        if found is None:
            return None
        order = np.lexsort((found["other"], found["out"]))
        found = {c: v[order] for c, v in found.items()} | {"id": np.arange(len(order))}
        new = (np.diff(found["out"]) != 0) | (np.diff(found["other"]) != 0)
        bounds = np.flatnonzero(np.r_[True, new, True]).tolist()
        rings = [r for r in (_loops(found, a, b) for a, b in zip(bounds, bounds[1:])) if r is not None]
        return {c: np.concatenate([r[c] for r in rings]) for c in rings[0]} if rings else None

    return run


def closed(rings: DataFrame, dealt: Callable[[DataFrame], DataFrame], rule: str, square: float, most: int = 1) -> DataFrame:
    """rings_of() the pieces() of dealt(rings), a function to sides() of which each polygon is a space.

    A corner of a ring becomes at most so many sides. Polygons of at most WHOLE sides are cut and closed in one task, many to a task, so neither
    squares nor corners nor pieces of them are stored; others are dealt to squares. Rings are few bytes but much work, so they are spread first.
    """
    n = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    corners = F.sum(F.size("ring")).over(Window.partitionBy("poly_id"))
    spread = checkpointed(rings.repartition(n, "poly_id").withColumn("_many", corners * most > WHOLE))
    kinds = f"space long, poly_id long, other long, part long, hole boolean, ring {POINTS}"
    found = by_groups(dealt(spread.filter("NOT _many")), ["space"], ["poly", "kind", "x1", "y1", "x2", "y2"], _whole_rings(rule, TOLERANCE), kinds)
    many = spread.filter("_many")
    return found if many.isEmpty() else found.unionByName(rings_of(pieces(dealt(many), rule, square)))


def rings_of(found: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Rings (space, poly_id, other, part, hole, ring) of pieces(): each loop is one, outer ones counter-clockwise; part names the loop.

    Where several pieces leave a point, a loop takes the sharpest turn to the left, so areas that touch in a point are rings of their own.
    A result of at most PIECES pieces is closed in one task. The loops of larger ones are told by doubling links, so a loop of n pieces takes
    log2 n rounds and only a loop's own vertices meet in a task.
    """
    key, kinds = ["space", "out", "other"], f"space long, poly_id long, other long, part long, hole boolean, ring {POINTS}"
    named = checkpointed(found.withColumn("id", F.xxhash64(*key, "x1", "y1", "x2", "y2")))
    many = checkpointed(named.groupBy(*key).count().filter(F.col("count") > PIECES).select(*key))
    if many.isEmpty():
        return by_groups(named, key, ["id"], _loops, kinds)
    few = by_groups(named.join(many, key, "left_anti"), key, ["id"], _loops, kinds)
    return few.unionByName(_rings_by_links(checkpointed(named.join(many, key, "left_semi")), key, kinds, max_rounds))


def _rings_by_links(named: DataFrame, key: list[str], kinds: str, max_rounds: int) -> DataFrame:
    there = named.select(*key, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("id").alias("next"))
    ax, ay, bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    # back along the same line is the last choice
    turn = F.when((F.col("x3") == F.col("x1")) & (F.col("y3") == F.col("y1")), -4.0).otherwise(turn)
    links = checkpointed(named.join(there, [*key, "x2", "y2"]).groupBy("id").agg(F.max_by("next", turn).alias("next")))
    state = links.select("id", "next", F.least("id", "next").alias("loop"))
    for _ in range(max_rounds):
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("loop").alias("its"))
        joined = checkpointed(state.join(ahead, "next").select("id", F.col("far").alias("next"), F.least("loop", "its").alias("new"), "loop"))
        moved = joined.filter("new <> loop").limit(1).count()
        state = joined.select("id", "next", F.col("new").alias("loop"))
        if not moved:
            break
    full = named.join(links, "id").join(state.select("id", "loop"), "id").select(*key, "id", "next", "loop", "x1", "y1")
    return by_groups(full, [*key, "loop"], ["id"], _ring, kinds)


def union(rings: DataFrame, square: float, space: Column | None = None) -> DataFrame:
    """VE-3: pieces of the union of all polygons, or of those of each value of space."""
    return pieces(sides(rings, F.lit(0) if space is None else space), "union", square)


def intersect(rings: DataFrame, mask: DataFrame, square: float) -> DataFrame:
    """VE-4: pieces of each polygon's part inside the union of the mask's; polygons without any have none."""
    return pieces(sides(rings, F.lit(0)).unionByName(sides(mask, F.lit(0), 1)), "intersect", square)


def subtract(rings: DataFrame, mask: DataFrame, square: float) -> DataFrame:
    """VE-5, VE-16: pieces of each polygon's part outside the union of the mask's."""
    return pieces(sides(rings, F.lit(0)).unionByName(sides(mask, F.lit(0), 1)), "subtract", square)


def resolve(rings: DataFrame, rank: Column, square: float) -> DataFrame:
    """VE-14: pieces of each polygon without what polygons of a lower rank cover."""
    return pieces(sides(rings, F.lit(0), rank=rank), "first", square)


def repair(rings: DataFrame, square: float) -> DataFrame:
    """VE-6: rings (poly_id, part, hole, ring) that don't cross themselves or one another, around all that a polygon's rings wind around."""
    return closed(rings, lambda some: sides(some, F.col("poly_id")), "each", square).select("poly_id", "part", "hole", "ring")


def overlaps(rings: DataFrame, square: float, tolerance: float = 1e-7) -> DataFrame:
    """VE-11: pairs (a, b, shared, kind) of polygons that share some area, a < b; kind is overlaps, within or contains."""
    # rings are few bytes but much work, so they are spread first
    spread = rings.repartition(int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "poly_id")
    found = checkpointed(shares(sides(spread, F.lit(0)), square))
    sizes = found.filter("out = other").select("out", "area")
    shared = found.filter("out < other").select(F.col("out").alias("a"), F.col("other").alias("b"), F.col("area").alias("shared")).filter(F.col("shared") > tolerance)
    met = shared.join(sizes.select(F.col("out").alias("a"), F.col("area").alias("sa")), "a").join(sizes.select(F.col("out").alias("b"), F.col("area").alias("sb")), "b")
    kind = F.when(F.col("shared") >= F.col("sa") - tolerance, "within").when(F.col("shared") >= F.col("sb") - tolerance, "contains").otherwise("overlaps")
    return met.select("a", "b", "shared", kind.alias("kind"))


def alignment(rings: DataFrame, square: float, tolerance: float = 1e-7) -> DataFrame:
    """VE-10, AG-11: one row with the sum of areas, the area of the union, and whether they agree."""
    own = sides(rings, F.lit(0))
    total = lambda rule, name: areas(pieces(own, rule, square)).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias(name))
    return total("each", "sum_area").join(total("union", "union_area")).withColumn("aligned", F.abs(F.col("sum_area") - F.col("union_area")) <= tolerance)


def disc_part(at: Column, d: Column, start: Column, span: Column, corners: int) -> Column:
    """A ring of the part of the circle around a place, of the given number of corners, between two directions, and of some more to both sides and behind.

    It reaches beyond both directions by a corner or two, and half the distance to the other side of the place, so no crack is left to what lies there.
    """
    turn = 2 * np.pi / corners
    first, last = F.floor(start / turn) - 1, F.ceil((start + span) / turn) + 1
    out = lambda r, angle: F.struct((at["x"] + r * F.cos(angle)).alias("x"), (at["y"] + r * F.sin(angle)).alias("y"))
    return F.concat(F.array(out(-d / 2, start + span / 2)), F.transform(F.sequence(first, last), lambda k: out(d, F.pmod(k, F.lit(corners)) * turn)))


def _around(rings: DataFrame, distance: Column, corners: int) -> DataFrame:
    """Rings of what lies within a distance of each polygon's sides: a strip along each side, and of the circle around each vertex what the strips leave out."""
    each = rings.select("poly_id", F.abs(distance).alias("d"), _sides(F.col("ring")).alias("all")).select("poly_id", "d", "all", F.posexplode("all").alias("seq", "s"))
    a, b = F.col("s.a"), F.col("s.b")
    length = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    nx, ny = -(b["y"] - a["y"]) / length * F.col("d"), (b["x"] - a["x"]) / length * F.col("d")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    strip = F.array(at(a["x"] - nx, a["y"] - ny), at(b["x"] - nx, b["y"] - ny), at(b["x"] + nx, b["y"] + ny), at(a["x"] + nx, a["y"] + ny))
    before = F.get("all", F.pmod(F.col("seq") - 1, F.size("all")))["a"]
    ux, uy, vx, vy = a["x"] - before["x"], a["y"] - before["y"], b["x"] - a["x"], b["y"] - a["y"]
    bend = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    start = F.atan2(uy, ux) + F.when(bend > 0, -np.pi / 2).otherwise(bend + np.pi / 2)
    disc = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda k: at(a["x"] + F.col("d") * F.cos(k * (2 * np.pi / corners)), a["y"] + F.col("d") * F.sin(k * (2 * np.pi / corners))))
    # strips shorter than the distance do not cover the rest of the circle, nor do those that go straight on without a crack
    part = (length >= F.col("d")) & (F.hypot(ux, uy) >= F.col("d")) & (F.abs(bend) > 1e-3) & F.lit(corners >= 16)
    disc = F.when(part, disc_part(a, F.col("d"), start, F.abs(bend), corners)).otherwise(disc)
    shapes = each.filter(length > 0).select("poly_id", F.explode(F.array(strip, disc)).alias("ring"))
    return shapes.select("poly_id", F.lit(0).alias("part"), F.lit(False).alias("hole"), "ring")


def buffer(rings: DataFrame, distance: Column, square: float, corners: int = 64) -> DataFrame:
    """VE-9, VE-13 on a plane: rings of polygons grown by a distance, or shrunk where it is negative; what shrinks to nothing goes.

    A polygon grows by the strips and circles around its sides, and shrinks by them; circles have the given number of corners.
    """

    def dealt(some):
        near = lambda sign, kind: sides(_around(some.filter(distance * sign > 0), distance, corners), F.col("poly_id"), kind)
        own = sides(some.filter(distance.isNotNull()), F.col("poly_id"))
        # all sides that belong to a polygon count as its own, so it grows by those of kind 0 and is cut by those of kind 1
        return own.unionByName(near(1, 0)).unionByName(near(-1, 1))

    # a corner has its side, the strip's four and those of its circle
    return closed(rings, dealt, "subtract", square, corners + 8).select("poly_id", "part", "hole", "ring")
