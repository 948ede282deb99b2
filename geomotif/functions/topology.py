"""Topological relations of convex geometries, exact on integer coordinates, as native column expressions.

A geometry is an array of vertices struct<x: bigint, y: bigint>, counter-clockwise and not closed: one vertex is a
point, two a segment, more a convex polygon. Cross products of micro-degrees fit 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks of the dimensionally extended nine-intersection model. T: any dimension, F: empty, *: whatever.
MASKS = {
    "equals": ("T*F**FFF*",),
    "disjoint": ("FF*FF****",),
    "touches": ("FT*******", "F**T*****", "F***T****"),
    "contains": ("T*****FF*",),
    "covers": ("T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"),
    "intersects": ("T********", "*T*******", "***T*****", "****T****"),
    "within": ("T*F**F***",),
    "coveredby": ("T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"),
    "crosses": ("T*T******", "T*****T**", "0********"),
    "overlaps": ("T*T***T**", "1*T***T**"),
}


def mask_regex(relation: str) -> str:
    """A regular expression for the nine-character matrices that satisfy a relation."""
    return "^(" + "|".join(m.replace("T", "[012]").replace("*", ".") for m in MASKS[relation]) + ")$"


def satisfies(matrix: Column, relation: str, dim_a: Column | int = 2, dim_b: Column | int = 2) -> Column:
    """Whether a matrix shows a relation. Crosses and overlaps ask for dimensions as well."""
    a, b = F.lit(dim_a) if isinstance(dim_a, int) else dim_a, F.lit(dim_b) if isinstance(dim_b, int) else dim_b
    hit = matrix.rlike(mask_regex(relation))
    if relation == "crosses":
        first, second, third = (matrix.rlike(mask_regex("crosses").replace("|".join(m.replace("T", "[012]").replace("*", ".") for m in MASKS["crosses"]), m.replace("T", "[012]").replace("*", "."))) for m in MASKS["crosses"])
        return (first & (a < b)) | (second & (a > b)) | (third & (a == 1) & (b == 1))
    if relation == "overlaps":
        return (a == b) & F.when(a == 1, matrix.rlike("^1.[012]...[012]..$")).otherwise(matrix.rlike("^[012].[012]...[012]..$"))
    return hit


def dimension(g: Column) -> Column:
    return F.least(F.size(g), F.lit(3)) - 1


def _edges(g: Column) -> Column:
    """Directed edges struct<p, q>; a segment has both directions, a point none."""
    n = F.size(g)
    edge = lambda i: F.struct(F.get(g, i).alias("p"), F.get(g, (i + 1) % n).alias("q"))
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), edge)).otherwise(F.array().cast("array<struct<p:struct<x:bigint,y:bigint>,q:struct<x:bigint,y:bigint>>>"))


def _cross(e: Column, v: Column) -> Column:
    p, q = e["p"], e["q"]
    return (q["x"] - p["x"]) * (v["y"] - p["y"]) - (q["y"] - p["y"]) * (v["x"] - p["x"])


def ring_box(g: Column) -> dict[str, Column]:
    xs, ys = F.transform(g, lambda v: v["x"]), F.transform(g, lambda v: v["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def _boxes_meet(a: Column, b: Column) -> Column:
    p, q = ring_box(a), ring_box(b)
    return (p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"])


def covers(a: Column, b: Column) -> Column:
    p, q = ring_box(a), ring_box(b)
    boxed = (p["xmin"] <= q["xmin"]) & (q["xmax"] <= p["xmax"]) & (p["ymin"] <= q["ymin"]) & (q["ymax"] <= p["ymax"])
    return boxed & F.forall(_edges(a), lambda e: F.forall(b, lambda v: _cross(e, v) >= 0))


def intersects(a: Column, b: Column) -> Column:
    parted = lambda g, h: F.exists(_edges(g), lambda e: F.forall(h, lambda v: _cross(e, v) < 0))
    return _boxes_meet(a, b) & ~parted(a, b) & ~parted(b, a)


def interiors_meet(a: Column, b: Column) -> Column:
    """Whether interiors have a common point; the interior of a point is the point itself."""
    parted = lambda g, h: F.exists(_edges(g), lambda e: F.forall(h, lambda v: _cross(e, v) <= 0))
    small = (F.size(a) < 3) & (F.size(b) < 3)
    p, q = ring_box(a), ring_box(b)
    line = F.forall(_edges(a), lambda e: F.forall(b, lambda v: _cross(e, v) == 0)) & F.forall(_edges(b), lambda e: F.forall(a, lambda v: _cross(e, v) == 0))
    stretch = (F.least(p["xmax"], q["xmax"]) > F.greatest(p["xmin"], q["xmin"])) | (F.least(p["ymax"], q["ymax"]) > F.greatest(p["ymin"], q["ymin"]))
    both_points = (F.size(a) == 1) & (F.size(b) == 1)
    inside = lambda s, t: (F.size(s) == 2) & (F.size(t) == 1) & (F.get(t, F.lit(0)) != F.get(s, F.lit(0))) & (F.get(t, F.lit(0)) != F.get(s, F.lit(1)))
    lines = F.when(both_points, F.lit(True)).when(line, stretch | inside(a, b) | inside(b, a)).otherwise(~parted(a, b) & ~parted(b, a))
    return intersects(a, b) & F.when(small, lines).otherwise(~parted(a, b) & ~parted(b, a))


def contains(a: Column, b: Column) -> Column:
    return covers(a, b) & interiors_meet(a, b)


def relate(a: Column, b: Column) -> Column:
    """The nine-character matrix of two geometries that are points or polygons."""
    da, db = dimension(a), dimension(b)
    meet, ii = intersects(a, b), interiors_meet(a, b)
    ab, ba = covers(a, b), covers(b, a)
    pa, pb = da == 0, db == 0
    strict = lambda g, h: F.forall(_edges(g), lambda e: F.forall(h, lambda v: _cross(e, v) > 0))

    def share_side(e, f):
        on = (_cross(e, f["p"]) == 0) & (_cross(e, f["q"]) == 0)
        along = lambda v: (e["q"]["x"] - e["p"]["x"]) * (v["x"] - e["p"]["x"]) + (e["q"]["y"] - e["p"]["y"]) * (v["y"] - e["p"]["y"])
        lo, hi = F.least(along(f["p"]), along(f["q"])), F.greatest(along(f["p"]), along(f["q"]))
        return on & (F.least(hi, along(e["q"])) > F.greatest(lo, F.lit(0)))

    side = F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: share_side(e, f)))
    borders = meet & ~strict(a, b) & ~strict(b, a)
    f = F.lit("F")
    dim = lambda test, d: F.when(test, F.lit(d)).otherwise(f)
    area = F.concat(
        dim(ii, "2"), dim(ii & ~ba, "1"), dim(~ba, "2"),
        dim(ii & ~ab, "1"), F.when(borders & side, "1").when(borders, "0").otherwise("F"), dim(~ba, "1"),
        dim(~ab, "2"), dim(~ab, "1"), F.lit("2"),
    )
    points = F.when(meet, "0FFFFFFF2").otherwise("FF0FFF0F2")
    area_point = F.when(ii, "0F2FF1FF2").when(meet, "FF20F1FF2").otherwise("FF2FF10F2")
    point_area = F.when(ii, "0FFFFF212").when(meet, "F0FFFF212").otherwise("FF0FFF212")
    return F.when(pa & pb, points).when(pb, area_point).when(pa, point_area).otherwise(area)


def related(a: Column, b: Column, relation: str) -> Column:
    """Whether the geometries stand in a relation."""
    if relation == "intersects":
        return intersects(a, b)
    if relation == "disjoint":
        return ~intersects(a, b)
    if relation == "contains":
        return contains(a, b)
    if relation == "within":
        return contains(b, a)
    if relation == "covers":
        return covers(a, b)
    if relation == "coveredby":
        return covers(b, a)
    if relation == "equals":
        return covers(a, b) & covers(b, a)
    if relation == "touches":
        return intersects(a, b) & ~interiors_meet(a, b)
    same = dimension(a) == dimension(b)
    mixed = interiors_meet(a, b) & ~covers(a, b) & ~covers(b, a)
    if relation == "overlaps":
        return same & (dimension(a) != 1) & mixed
    if relation == "crosses":
        return mixed & (~same | (dimension(a) == 1))
    raise ValueError(f"unknown relation {relation!r}")


def flat(g: Column, box: dict[str, Column]) -> Column:
    """Whether a geometry is a point or the rectangle that its box is; then boxes tell all its relations to others such."""
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    corners = [corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")]
    turned = [g == F.array(*corners[i:], *corners[:i]) for i in range(4)]
    whole = (F.size(g) == 4) & (box["xmin"] < box["xmax"]) & (box["ymin"] < box["ymax"]) & (turned[0] | turned[1] | turned[2] | turned[3])
    return F.coalesce((F.size(g) == 1) | whole, F.lit(False))


def boxes_related(p: dict[str, Column], q: dict[str, Column], relation: str) -> Column:
    """related() of two geometries that are flat, by their boxes."""
    meet = (p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"])
    within = lambda s, t: (t["xmin"] <= s["xmin"]) & (s["xmax"] <= t["xmax"]) & (t["ymin"] <= s["ymin"]) & (s["ymax"] <= t["ymax"])
    point_p, point_q = p["xmin"] == p["xmax"], q["xmin"] == q["xmax"]
    # a point's interior is itself; open boxes meet, also if one is a point
    open_ = (p["xmin"] < q["xmax"]) & (q["xmin"] < p["xmax"]) & (p["ymin"] < q["ymax"]) & (q["ymin"] < p["ymax"])
    inner = F.when(point_p & point_q, meet).otherwise(open_)
    mixed = inner & ~within(q, p) & ~within(p, q)
    return {
        "intersects": meet, "disjoint": ~meet, "covers": within(q, p), "coveredby": within(p, q), "contains": within(q, p) & inner, "within": within(p, q) & inner,
        "equals": within(q, p) & within(p, q), "touches": meet & ~inner, "overlaps": (point_p == point_q) & mixed, "crosses": (point_p != point_q) & mixed,
    }[relation]


def relation_label(a: Column, b: Column) -> Column:
    """The first of contains, within, intersects and disjoint that holds."""
    return F.when(contains(a, b), "contains").when(contains(b, a), "within").when(intersects(a, b), "intersects").otherwise("disjoint")


def cover_label(a: Column, b: Column) -> Column:
    """As relation_label, by covering: contact along a border counts."""
    return F.when(covers(a, b), "contains").when(covers(b, a), "within").when(intersects(a, b), "intersects").otherwise("disjoint")


def all_relations(a: Column, b: Column) -> Column:
    """All relations that hold, in the order of the mask table."""
    return F.array_compact(F.array(*(F.when(related(a, b, r), F.lit(r)) for r in MASKS)))


def is_convex(g: Column) -> Column:
    """Whether every vertex lies on or left of every edge."""
    return F.forall(_edges(g), lambda e: F.forall(g, lambda v: _cross(e, v) >= 0))


def double_area(g: Column) -> Column:
    return F.aggregate(_edges(g), F.lit(0).cast("bigint"), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
