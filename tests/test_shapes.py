"""Relations of concave shapes, holes and parts, by hand and against a fine grid of sample points."""

import random

import pytest
from pyspark.sql import functions as F

from geomotif.functions import shapes, topology
from geomotif.functions.shapes import Shape, holds, matrix
from geomotif.sources import poi as P

L = [[(0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40)]]
RING = [[(0, 0), (40, 0), (40, 40), (0, 40)], [(10, 10), (10, 30), (30, 30), (30, 10)]]
TWO = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(30, 0), (40, 0), (40, 10), (30, 10)]]
square = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
point = lambda x, y: [[(x, y)]]


def names(a, b):
    a, b = Shape(a), Shape(b)
    m = matrix(a, b)
    assert matrix(b, a) == "".join(m[3 * j + i] for i in range(3) for j in range(3))
    return {r for r in topology.MASKS if holds(m, r, a.dim, b.dim)}


@pytest.mark.parametrize(
    "a,b,want",
    [
        (L, point(5, 30), "contains covers intersects"),
        (L, point(20, 20), "disjoint"),
        (L, point(10, 20), "covers intersects touches"),
        (L, square(2, 2, 6), "contains covers intersects"),
        (L, square(5, 5, 10), "intersects overlaps"),
        (L, square(20, 20, 5), "disjoint"),
        (L, square(10, 10, 30), "intersects touches"),
        (L, square(0, 0, 40), "coveredby intersects within"),
        (L, L, "equals contains covers coveredby within intersects"),
        (RING, square(12, 12, 5), "disjoint"),
        (RING, square(10, 10, 20), "intersects touches"),
        (RING, square(2, 2, 5), "contains covers intersects"),
        (RING, square(5, 5, 10), "intersects overlaps"),
        (RING, square(0, 0, 40), "coveredby intersects within"),
        (RING, point(20, 20), "disjoint"),
        (RING, point(10, 20), "covers intersects touches"),
        (RING, square(5, 5, 30), "intersects overlaps"),
        (TWO, square(20, 2, 5), "disjoint"),
        (TWO, square(32, 2, 5), "contains covers intersects"),
        (TWO, square(10, 0, 20), "intersects touches"),
        (TWO, [[(-5, 5), (50, 5)]], "crosses intersects"),
        (RING, [[(15, 15), (25, 25)]], "disjoint"),
        (L, [[(0, 0), (40, 0)]], "covers intersects touches"),
        (L, [[(5, 5), (5, 20)]], "contains covers intersects"),
        (L, [[(5, 35), (35, 5)]], "crosses intersects"),
    ],
)
def test_relations_by_hand(a, b, want):
    assert names(a, b) == set(want.split())


def test_convex_shapes_agree_with_the_native_relations(spark):
    rng = random.Random(1)
    kinds = lambda: rng.choice((lambda: square(rng.randint(0, 6), rng.randint(0, 6), rng.randint(1, 5)), lambda: point(rng.randint(0, 6), rng.randint(0, 6))))()
    pairs = [(kinds(), kinds()) for _ in range(150)]
    ring = "array<struct<x:bigint,y:bigint>>"
    t = spark.createDataFrame([(i, a[0], b[0]) for i, (a, b) in enumerate(pairs)], f"i int, a {ring}, b {ring}")
    got = t.select("i", "a", "b", topology.relate(F.col("a"), F.col("b")).alias("m"), shapes.relate(F.array("a"), F.array("b")).alias("w"), F.array_join(topology.all_relations(F.col("a"), F.col("b")), " ").alias("r")).collect()
    for r in got:
        assert r.m == r.w == matrix(Shape(pairs[r.i][0]), Shape(pairs[r.i][1]))
        assert set(r.r.split()) == names(*pairs[r.i])


def test_matrices_equal_counts_on_a_grid():
    """Random unions of cells as shapes: two-dimensional entries by looking at every cell."""
    rng = random.Random(5)

    def stairs():
        h = [rng.randint(1, 5) for _ in range(4)]
        top = [(x + d, y) for x, y in reversed(list(enumerate(h))) for d in (1, 0)]
        ring = [(0, 0), (4, 0), *top]
        ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
        dx, dy = rng.randint(0, 3), rng.randint(0, 3)
        return {(x + dx, y + dy) for x in range(4) for y in range(h[x])}, [[(x + dx, y + dy) for x, y in ring]]

    for _ in range(200):
        (ca, a), (cb, b) = stairs(), stairs()
        m = matrix(Shape(a), Shape(b))
        assert ((m[0] == "2"), (m[2] == "2"), (m[6] == "2")) == (bool(ca & cb), bool(ca - cb), bool(cb - ca))
        assert holds(m, "covers", 2, 2) == (cb <= ca) and holds(m, "equals", 2, 2) == (ca == cb)


WKT = {
    "POLYGON ((0 0, 0.00004 0, 0.00004 0.00001, 0.00001 0.00001, 0.00001 0.00004, 0 0.00004, 0 0))": L,
    "POLYGON((0 0,0 0.00004,0.00004 0.00004,0.00004 0,0 0),(0.00001 0.00001,0.00003 0.00001,0.00003 0.00003,0.00001 0.00003,0.00001 0.00001))": RING,
    "MULTIPOLYGON (((0 0, 0.00001 0, 0.00001 0.00001, 0 0.00001, 0 0)), ((0.00003 0, 0.00004 0, 0.00004 0.00001, 0.00003 0.00001, 0.00003 0)))": TWO,
}


def turned(r):
    k = r.index(min(r))
    return r[k:] + r[:k]


def test_text_keeps_every_ring(spark):
    t = spark.createDataFrame([(i, w) for i, w in enumerate(WKT)] + [(3, "POLYGON ((0 0, 0.00001 0, 0.00001 0.00001, 0 0.00001, 0 0))"), (4, "POINT (1 2)")], "osm_id long, geometry string")
    got = {r.osm_id: r for r in P.with_geometry(t).collect()}
    for i, want in enumerate(WKT.values()):
        assert [turned([tuple(v) for v in r]) for r in got[i].rings] == [turned(r) for r in want]
    assert got[3].rings is None and got[4].rings is None and (got[4].lon, got[4].lat) == (1.0, 2.0)
    assert (got[1].lon, got[1].lat) == pytest.approx((20e-6, 20e-6)) and (got[2].xmax, got[2].lon) == (40, pytest.approx(20e-6))
    assert got[0].lon == pytest.approx((400 * 20 + 300 * 5) / 700 / 1e6)
    back = P.with_geometry(P.with_geometry(t).select("osm_id", P.shape_wkt().alias("geometry"))).collect()
    assert {r.osm_id: (r.rings, r.ring, r.lon) for r in back} == {i: (r.rings, r.ring, r.lon) for i, r in got.items()}


def test_features_keep_every_ring(spark, tmp_path):
    t = P.from_rows(spark.createDataFrame([(i, "n", "park", w) for i, w in enumerate([*WKT, "POINT (1 2)"])], "osm_id long, name string, leisure string, geometry string"))
    P.write_geojson(t, f"{tmp_path}/g")
    got = {r.osm_id: r for r in P.read_geojson(spark, f"{tmp_path}/g").collect()}
    want = {r.osm_id: r for r in t.collect()}
    assert all((got[i].rings, got[i].ring, got[i].xmin, got[i].xmax) == (want[i].rings, want[i].ring, want[i].xmin, want[i].xmax) for i in range(4))


def test_polygons_and_boxes_are_related_natively_and_exactly(spark):
    star = [[(0, 0), (18, 6), (40, 1), (30, 18), (39, 40), (19, 30), (2, 38), (9, 20)], [(14, 14), (13, 24), (25, 25), (22, 13)]]
    bent = [[(0, 0), (40, 20), (0, 40), (20, 20)], [(40, 20), (60, 0), (60, 40)]]  # the parts touch in a point
    rng = random.Random(4)
    boxes = []
    for _ in range(150):
        x, y, w, h = rng.randrange(-4, 62), rng.randrange(-4, 42), rng.choice((0, 1, 3, 10, 20)), rng.choice((1, 2, 10, 20, 50))
        boxes.append((x, y, x + w, y + (h if w else 0)))
    boxes += [(0, 0, 40, 40), (10, 10, 30, 30), (0, 0, 60, 40), (-5, -5, 70, 70), (10, 0, 30, 10), (15, 15, 20, 20)]
    rows = [(f"{n}{i}", [[{"x": x, "y": y} for x, y in r] for r in s], *b) for n, s in (("L", L), ("R", RING), ("T", TWO), ("S", star), ("B", bent)) for i, b in enumerate(boxes)]
    t = spark.createDataFrame(rows, "id string, rings array<array<struct<x:bigint,y:bigint>>>, xmin long, ymin long, xmax long, ymax long")
    other = {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}
    got = t.withColumn("sides", shapes.sides(F.col("rings"))).select(*(shapes.related_to_box(F.col("sides"), shapes.box(F.col("rings")), other, r).alias(r) for r in topology.MASKS)).collect()
    for (i, rings, x0, y0, x1, y1), g in zip(rows, got, strict=True):
        p = Shape([[(v["x"], v["y"]) for v in r] for r in rings])
        q = Shape([[(x0, y0)] if x0 == x1 else [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]])
        m = matrix(p, q)
        assert {r for r in topology.MASKS if g[r]} == {r for r in topology.MASKS if holds(m, r, p.dim, q.dim)}, (i, x0, y0, x1, y1)


def test_boxes_tell_the_relations_of_rectangles_and_points(spark):
    spots = [(x, y, x + w, y + h) for x, y in ((0, 0), (2, 0), (2, 2), (4, 4), (1, 1)) for w, h in ((0, 0), (2, 2), (4, 4), (2, 4))]
    ring = lambda b: [{"x": x, "y": y} for x, y in ([(b[0], b[1])] if b[0] == b[2] else [(b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])])]
    cols = ("xmin", "ymin", "xmax", "ymax")
    t = spark.createDataFrame([(*a, ring(a), *b, ring(b)) for a in spots for b in spots], ", ".join(f"{s}{k} long" if k != "ring" else f"{s}ring array<struct<x:bigint,y:bigint>>" for s in "ab" for k in (*cols, "ring")))
    a, b = ({k: F.col(s + k) for k in cols} for s in "ab")
    assert t.where(~topology.flat(F.col("aring"), a)).count() == 0
    assert t.where(topology.flat(F.array(*(F.get("aring", F.lit(i)) for i in (0, 2, 1, 3))), a) & (F.size("aring") == 4)).count() == 0
    for r in topology.MASKS:
        assert t.where(topology.boxes_related(a, b, r) != topology.related(F.col("aring"), F.col("bring"), r)).count() == 0, r


def test_odd_shapes_and_boxes_need_no_python(spark):
    from geomotif import queries
    from geomotif.operators.match import match

    t = queries.odd_depots(spark, "/root/testdata/sf0.001")
    p = queries.edge(relation="covers", a="depot", b="BUILDING")
    assert "ArrowEvalPython" not in match(t, p)._jdf.queryExecution().optimizedPlan().toString()
    both = queries.edge(relation="intersects", a="depot", b="depot")
    assert "ArrowEvalPython" in match(t, both)._jdf.queryExecution().optimizedPlan().toString()


def test_rectangles_and_points_that_touch_meet_on_lines(spark):
    from geomotif.operators.match import match
    from geomotif.plans.pattern import Edge, Pattern, Vertex

    from .test_engine import table

    rng = random.Random(6)
    rows = [(i, [rng.choice("ab")], 2 * rng.randrange(12), 2 * rng.randrange(12), *rng.choice(((0, 0), (2, 2), (4, 2), (1, 3)))) for i in range(160)]
    p = Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", relation="touches"),))
    found = match(table(spark, rows), p)

    def touch(s, t):
        gaps = [abs(s[k] - t[k]) - s[k + 2] - t[k + 2] for k in (2, 3)]
        both = (s[4], s[5]) == (t[4], t[5]) == (0, 0)
        return max(gaps) == 0 and not both

    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(s[0], t[0]) for s in rows for t in rows if "a" in s[1] and "b" in t[1] and touch(s, t)} and len(got) > 100
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_cx" not in text and "sequence" not in text


def test_tiles_tell_what_polygons_meet_or_leave_it_open(spark):
    star = [[(0, 0), (18, 6), (40, 1), (30, 18), (39, 40), (19, 30), (2, 38), (9, 20)], [(14, 14), (13, 24), (25, 25), (22, 13)]]
    rng = random.Random(8)
    boxes = [(x, y, x + w, y + (h if w else 0)) for x, y, w, h in ((rng.randrange(-3, 42), rng.randrange(-3, 42), rng.choice((0, 1, 5, 12)), rng.choice((1, 4, 10))) for _ in range(250))]
    rows = [(f"{n}{i}", [[{"x": x, "y": y} for x, y in r] for r in s], *b) for n, s in (("L", L), ("R", RING), ("T", TWO), ("S", star), ("small", square(0, 0, 3))) for i, b in enumerate(boxes)]
    t = spark.createDataFrame(rows, "id string, rings array<array<struct<x:bigint,y:bigint>>>, xmin long, ymin long, xmax long, ymax long")
    other = {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}
    t = t.withColumn("own", F.struct(*(v.alias(k) for k, v in shapes.box(F.col("rings")).items()))).withColumn("sides", shapes.sides(F.col("rings")))
    own = {k: F.col("own")[k] for k in other}
    t = t.withColumn("tiles", shapes.tiles(F.col("sides"), own))
    meet = (own["xmin"] <= other["xmax"]) & (other["xmin"] <= own["xmax"]) & (own["ymin"] <= other["ymax"]) & (other["ymin"] <= own["ymax"])
    got = t.where(meet).select("id", shapes.related_to_box(F.col("sides"), own, other, "intersects").alias("want"), shapes.meets_by_tiles(F.col("tiles"), own, other).alias("told")).collect()
    assert all(r.told is None or r.told == r.want for r in got) and {r.told for r in got} == {True, False, None}
    assert all(r.told is None for r in got if r.id.startswith("small"))
    told = lambda n: [r.told is not None for r in got if r.id.startswith(n)]
    assert all(told("L")) and all(told("R")) and len(told("S")) > 100  # of the star, whose tiles all hold a side, nothing is told


def test_patterns_ask_tiles_before_sides(spark):
    from geomotif import queries
    from geomotif.operators.match import match

    t = queries.odd_depots(spark, "/root/testdata/sf0.01")
    for p in (queries.edge(relation="intersects", a="depot", b="BUILDING"), queries.edge(relation="intersects", a="BUILDING", b="depot"), queries.edge(0.0, 6000.0, relation="intersects", a="depot", b="BUILDING")):
        found = match(t, p)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert ".tiles" in text and "ArrowEvalPython" not in text
        whole = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if p.edges[0].vi == "a" and p.vertices[0].keyword == "depot" and p.edges[0].upper == float("inf"):
            first = {tuple(r) for r in whole.collect()}
        assert {tuple(r) for r in whole.collect()} == first and first
