"""Topological relations of any points, segments and polygons: concave ones, with holes, of several parts.

A shape is an array of rings, each an array of vertices in integer micro-degrees and not closed, with the interior on its
left: outer rings counter-clockwise, holes clockwise. One ring of one vertex is a point, one of two a segment.

All is exact: boundaries are cut where they meet, at rational points, and each piece and each meeting point is classified
against the other shape, which gives the nine-intersection matrix. That is a loop over the vertices of two shapes, so it
runs in Python, by Arrow batches, and only for pairs that are not both convex (see topology).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from fractions import Fraction
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import topology

Point = tuple  # of two ints or fractions
INSIDE, EDGE, OUTSIDE = range(3)


def _turn(p: Point, q: Point, r: Point):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _between(p: Point, q: Point, r: Point) -> bool:
    """Whether r, on the line of p and q, lies on the segment."""
    return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])


class Shape:
    def __init__(self, rings: Iterable[Iterable[Point]]) -> None:
        self.rings = [[(int(x), int(y)) for x, y in r] for r in rings if len(r)]
        most = max((len(r) for r in self.rings), default=0)
        self.dim = min(most, 3) - 1
        self.sides = [(r[i], r[(i + 1) % len(r)]) for r in self.rings if len(r) > 1 for i in range(len(r) if len(r) > 2 else 1)]

    def locate(self, p: Point) -> int:
        """Whether a point is in the interior, on the boundary or outside."""
        if self.dim < 1:
            return INSIDE if any(p == r[0] for r in self.rings) else OUTSIDE
        if self.dim == 1:
            for a, b in self.sides:
                if _turn(a, b, p) == 0 and _between(a, b, p):
                    return EDGE if p in (a, b) else INSIDE
            return OUTSIDE
        odd = False
        for a, b in self.sides:
            t = _turn(a, b, p)
            if t == 0 and _between(a, b, p):
                return EDGE
            if (a[1] > p[1]) != (b[1] > p[1]) and (t > 0) == (b[1] > a[1]):
                odd = not odd
        return INSIDE if odd else OUTSIDE


def _cuts(side: tuple[Point, Point], others: list[tuple[Point, Point]], points: list[Point]) -> list[Point]:
    """The points of a segment, in order, at which it meets other segments or points, and its ends."""
    p, q = side
    found = {p, q}
    dx, dy = q[0] - p[0], q[1] - p[1]
    for a, b in others:
        if max(a[0], b[0]) < min(p[0], q[0]) or max(p[0], q[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(p[1], q[1]) or max(p[1], q[1]) < min(a[1], b[1]):
            continue
        s, t = _turn(p, q, a), _turn(p, q, b)
        if s == 0 and _between(p, q, a):
            found.add(a)
        if t == 0 and _between(p, q, b):
            found.add(b)
        if (s > 0) != (t > 0) and s and t:
            u, v = _turn(a, b, p), _turn(a, b, q)
            if u and v and (u > 0) != (v > 0):
                k = Fraction(u, u - v)
                found.add((p[0] + k * dx, p[1] + k * dy))
    found |= {r for r in points if _turn(p, q, r) == 0 and _between(p, q, r)}
    return sorted(found, key=lambda r: (r[0] - p[0]) * dx + (r[1] - p[1]) * dy)


def matrix(a: Shape, b: Shape) -> str:
    """The nine characters of the two shapes' nine-intersection matrix."""
    m = [[-1] * 3 for _ in range(3)]
    m[OUTSIDE][OUTSIDE] = 2

    def put(x: int, y: int, d: int) -> None:
        m[x][y] = max(m[x][y], d)

    ends = [[r[0] for r in s.rings if len(r) == 1] for s in (a, b)]
    nodes = {p for s in ends for p in s}
    pieces: list[list[tuple[Point, Point]]] = [[], []]
    for k, (own, other) in enumerate(((a, b), (b, a))):
        for side in own.sides:
            at = _cuts(side, other.sides, ends[1 - k])
            nodes.update(at)
            pieces[k] += list(zip(at, at[1:], strict=False))
    for p in nodes:
        put(a.locate(p), b.locate(p), 0)
    same = {tuple(x) for x in pieces[1]}
    for k, (own, other) in enumerate(((a, b), (b, a))):
        row = EDGE if own.dim == 2 else INSIDE
        for p, q in pieces[k]:
            at = other.locate((Fraction(p[0] + q[0], 2), Fraction(p[1] + q[1], 2)))
            put(*((row, at) if k == 0 else (at, row)), 1)
            if own.dim == other.dim == 2:
                # the area left of the piece is the shape's, that on its right isn't
                if at != EDGE:
                    inner, outer = (INSIDE, at), (OUTSIDE, at)
                    for x, y in (inner, outer):
                        put(*((x, y) if k == 0 else (y, x)), 2)
                elif k == 0:
                    together = (p, q) in same
                    for x, y in ([(INSIDE, INSIDE)] if together else [(INSIDE, OUTSIDE), (OUTSIDE, INSIDE)]):
                        put(x, y, 2)
    for k, (own, other) in enumerate(((a, b), (b, a))):
        if own.dim == 2 and other.dim < 2:  # no line or point covers an area
            put(*((INSIDE, OUTSIDE) if k == 0 else (OUTSIDE, INSIDE)), 2)
    return "".join("F" if d < 0 else str(d) for row in m for d in row)


def holds(m: str, relation: str, dim_a: int, dim_b: int) -> bool:
    """Whether a matrix shows a relation of shapes of the given dimensions."""
    masks = topology.MASKS[relation]
    if relation == "crosses":
        masks = masks[:1] if dim_a < dim_b else masks[1:2] if dim_a > dim_b else masks[2:] if dim_a == dim_b == 1 else ()
    if relation == "overlaps":
        masks = () if dim_a != dim_b else masks[1:] if dim_a == 1 else masks[:1]
    return any(re.fullmatch(x.replace("T", "[012]").replace("*", "."), m) for x in masks)


def _shape(rings) -> Shape | None:
    return None if rings is None else Shape([[(v["x"], v["y"]) for v in r] for r in rings])


@pandas_udf(T.StringType())
def relate(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matrix of two shapes; null where one is null."""
    return pd.Series([None if x is None or y is None else matrix(_shape(x), _shape(y)) for x, y in zip(a, b, strict=True)], dtype=object)


def related(a: Column, b: Column, relation: str) -> Column:
    """Whether two shapes stand in a relation; null where one is null."""

    @pandas_udf(T.BooleanType())
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None:
                out.append(None)
            else:
                p, q = _shape(p), _shape(q)
                out.append(holds(matrix(p, q), relation, p.dim, q.dim))
        return pd.Series(out, dtype=object)

    return test(a, b)


def either(ring_a: Column, rings_a: Column, ring_b: Column, rings_b: Column, relation: str) -> Column:
    """related() of places with a ring, and with rings where the ring alone doesn't tell their shape: natively where both
    are convex; only other pairs reach Python as more than nulls."""
    odd = rings_a.isNotNull() | rings_b.isNotNull()
    whole = lambda ring, rings: F.when(odd, F.coalesce(rings, F.array(ring)))
    return F.coalesce(related(whole(ring_a, rings_a), whole(ring_b, rings_b), relation), topology.related(ring_a, ring_b, relation))


# ---- any polygons and boxes, natively ------------------------------------------------------------

TURNED = {"contains": "within", "within": "contains", "covers": "coveredby", "coveredby": "covers"}


def sides(rings: Column) -> Column:
    """The sides of polygons, from their left to their right end, in half micro-degrees; null where a ring is none."""
    n = lambda r: F.size(r) - 1

    def side(p: Column, q: Column) -> Column:
        first = p["x"] <= q["x"]
        pick = lambda a, b, k: (F.when(first, a[k]).otherwise(b[k]) * 2).cast("long")
        return F.named_struct(F.lit("px"), pick(p, q, "x"), F.lit("py"), pick(p, q, "y"), F.lit("qx"), pick(q, p, "x"), F.lit("qy"), pick(q, p, "y"))

    of_ring = lambda r: F.transform(F.sequence(F.lit(0), n(r)), lambda i: side(F.get(r, i), F.get(r, F.when(i == n(r), 0).otherwise(i + 1))))
    return F.when(F.forall(rings, lambda r: F.size(r) > 2), F.flatten(F.transform(rings, of_ring)))


def _against_box(all_sides: Column, box: dict[str, Column]) -> tuple[Column, Callable[[bool], Column]]:
    """Whether a box's middle is in polygons, by their sides, and whether a side meets the box, or strictly the open one."""
    x0, y0, x1, y1 = (box[k] * 2 for k in ("xmin", "ymin", "xmax", "ymax"))
    cx, cy = box["xmin"] + box["xmax"], box["ymin"] + box["ymax"]
    turn = lambda e, x, y: (e["qx"] - e["px"]) * (y - e["py"]) - (e["qy"] - e["py"]) * (x - e["px"])

    def meets(strictly: bool) -> Column:
        before = (lambda a, b: a < b) if strictly else (lambda a, b: a <= b)

        def one(e: Column) -> Column:
            near = before(x0, e["qx"]) & before(e["px"], x1) & before(y0, F.greatest(e["py"], e["qy"])) & before(F.least(e["py"], e["qy"]), y1)
            # as the side runs to the right, the corner farthest to its left is an upper one
            rises = e["qy"] >= e["py"]
            left, right = F.when(rises, turn(e, x0, y1)).otherwise(turn(e, x1, y1)), F.when(rises, turn(e, x1, y0)).otherwise(turn(e, x0, y0))
            return near & before(F.lit(0), left) & before(right, F.lit(0))

        return F.exists(all_sides, one)

    above = lambda e: ((e["py"] > cy) != (e["qy"] > cy)) & ((turn(e, cx, cy) > 0) == (e["qy"] > e["py"]))
    return F.aggregate(all_sides, F.lit(False), lambda odd, e: odd != above(e)), meets


#: Each way, a polygon's box has so many tiles; a bit for each goes into a long.
TILES = 4


def tiles(all_sides: Column, own: dict[str, Column]) -> Column:
    """Of polygons, by their sides and box: the size of the box's tiles (the last ones may be larger), which tiles they cover,
    and which open ones they meet. Null for what has no sides or is too small."""
    gx, gy = (F.floor((own[b] - own[a]) / F.lit(TILES)).cast("long") for a, b in (("xmin", "xmax"), ("ymin", "ymax")))
    at = lambda low, high, g, i: low + g * i if i < TILES else high
    tile = lambda i, j: {f"{x}{m}": at(own[f"{x}min"], own[f"{x}max"], g, k + (m == "max")) for x, g, k in (("x", gx, i), ("y", gy, j)) for m in ("min", "max")}
    bits = F.array(*(F.named_struct(F.lit("bit"), F.lit(1 << (TILES * j + i)).cast("long"), *(x for k, v in tile(i, j).items() for x in (F.lit(k), v))) for i, j in product(range(TILES), range(TILES))))

    def where(strictly: bool) -> Column:
        def add(n: Column, t: Column) -> Column:
            middle, meets = _against_box(all_sides, {k: t[k] for k in ("xmin", "ymin", "xmax", "ymax")})
            return n + F.when(middle & ~meets(True) if strictly else middle | meets(True), t["bit"]).otherwise(F.lit(0).cast("long"))

        return F.aggregate(bits, F.lit(0).cast("long"), add)

    return F.when(all_sides.isNotNull() & (gx > 0) & (gy > 0), F.named_struct(F.lit("gx"), gx, F.lit("gy"), gy, F.lit("covered"), where(True), F.lit("met"), where(False)))


def meets_by_tiles(of: Column, own: dict[str, Column], box: dict[str, Column]) -> Column:
    """Whether polygons meet a rectangle or point that meets their box, where their tiles tell: by all the closed tiles that it
    touches. A polygon that it meets has inner points as near as one likes to where, so it meets one of these, opened; and one
    of these that is covered has a point in common with it. Else null."""

    def span(low: str, high: str, g: Column) -> tuple[Column, Column]:
        index = lambda v: F.greatest(F.lit(0), F.least(F.lit(TILES - 1), F.floor(v / g).cast("int")))
        return index(box[low] - own[low] - 1), index(box[high] - own[low])

    (x0, x1), (y0, y1) = span("xmin", "xmax", of["gx"]), span("ymin", "ymax", of["gy"])
    one, row = F.lit(1).cast("long"), (1 << TILES) - 1
    shift = lambda n: F.call_function("shiftleft", one, n)
    # a bit for each touched column, as often as there are touched rows: of (2^4k - 1) / 15 every fourth bit is set
    columns = shift(x1 + 1) - shift(x0)
    rows = ((shift(TILES * (y1 + 1)) - shift(TILES * y0)) / F.lit(row)).cast("long")
    touched = columns * rows
    return F.when(of["met"].bitwiseAND(touched) == 0, False).when(of["covered"].bitwiseAND(touched) != 0, True)


def related_to_box(all_sides: Column, own: dict[str, Column], box: dict[str, Column], relation: str) -> Column:
    """Whether polygons, by their sides and box, stand in a relation to a rectangle or point that is the other box. Exact:
    without a side in the open box, its middle tells on which side of the border all of it lies."""
    middle, meets = _against_box(all_sides, box)
    point = box["xmin"] == box["xmax"]
    meet, covers = middle | meets(False), F.when(point, middle | meets(False)).otherwise(middle & ~meets(True))
    inner = F.when(point, middle & ~meets(False)).otherwise(middle | meets(True))
    covered = (box["xmin"] <= own["xmin"]) & (own["xmax"] <= box["xmax"]) & (box["ymin"] <= own["ymin"]) & (own["ymax"] <= box["ymax"])
    return {
        "intersects": lambda: meet, "disjoint": lambda: ~meet, "covers": lambda: covers, "coveredby": lambda: covered,
        "contains": lambda: F.when(point, inner).otherwise(covers), "within": lambda: covered, "equals": lambda: covered & covers,
        "touches": lambda: meet & ~inner, "overlaps": lambda: ~point & inner & ~covers & ~covered, "crosses": lambda: F.lit(False),
    }[relation]()


# ---- columns of whole shapes ---------------------------------------------------------------------


def double_area(rings: Column) -> Column:
    """Twice the area: holes, which run clockwise, count as negative."""
    return F.aggregate(rings, F.lit(0).cast("bigint"), lambda s, r: s + topology.double_area(r))


def box(rings: Column) -> dict[str, Column]:
    return topology.ring_box(F.flatten(rings))
