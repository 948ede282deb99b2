"""Expressions by hand, and patterns against a brute-force search in plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from geomotif.functions import geo, topology
from geomotif.operators import ematch, grid, prep, report, search
from geomotif.operators.match import edge_matches, match, solve_by_edges, verify_late
from geomotif.plans import planner
from geomotif.plans.pattern import Edge, MultiPattern, MultiVertex, Pattern, Vertex
from geomotif.sources import poi as P
from geomotif.testing.patterns import STRUCTURES, random_pattern

WORDS = ("a", "b", "c", "d", "e", "f")
VERTEX = "array<struct<x:bigint,y:bigint>>"


def box(x, y, hx, hy):
    return [(x, y)] if hx == hy == 0 else [(x - hx, y - hy), (x + hx, y - hy), (x + hx, y + hy), (x - hx, y + hy)]


def table(spark, rows):
    """rows: (id, keywords, x, y, hx, hy) in micro-degrees."""
    data = []
    for i, kw, x, y, hx, hy in rows:
        data.append((i, f"n{i}", list(kw), x / 1e6, y / 1e6, x - hx, y - hy, x + hx, y + hy, box(x, y, hx, hy)))
    schema = f"osm_id long, name string, keywords array<string>, lon double, lat double, xmin long, ymin long, xmax long, ymax long, ring {VERTEX}"
    return spark.createDataFrame(data, schema)


def town(seed, n=70):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kw = rng.sample(WORDS, rng.choice((1, 1, 2)))
        big = rng.random() < 0.3
        x, y = -118_000 + rng.randrange(-9, 9) * 1000, 51_510_000 + rng.randrange(-6, 6) * 1000
        out.append((i, kw, x, y, *((3000, 2000) if big else (0, 0) if rng.random() < 0.3 else (300, 300))))
    return out


def rect_relation(a, b, kind):
    (_, _, ax, ay, aw, ah), (_, _, bx, by, bw, bh) = a, b
    meet = abs(ax - bx) <= aw + bw and abs(ay - by) <= ah + bh

    def contains(ax, ay, aw, ah, bx, by, bw, bh):
        if (bw, bh) == (0, 0) != (aw, ah):
            return abs(ax - bx) < aw and abs(ay - by) < ah
        return abs(ax - bx) <= aw - bw and abs(ay - by) <= ah - bh

    return {
        "intersects": meet, "disjoint": not meet,
        "contains": contains(ax, ay, aw, ah, bx, by, bw, bh), "within": contains(bx, by, bw, bh, ax, ay, aw, ah),
    }[kind]


def brute(rows, p):
    d = lambda s, t: geo.metres(s[3] / 1e6, s[2] / 1e6, t[3] / 1e6, t[2] / 1e6)
    ids = [v.id for v in p.vertices]
    word = {v.id: v.keyword for v in p.vertices}

    def holds(e, s, t):
        if not e.lower <= d(s, t) <= e.upper:
            return False
        if e.sign in (">", "<>") and any(word[e.vj] in o[1] and d(s, o) <= e.lower for o in rows):
            return False
        if e.sign in ("<", "<>") and any(word[e.vi] in o[1] and d(t, o) <= e.lower for o in rows):
            return False
        return not e.relation or rect_relation(s, t, e.relation)

    partial = [{}]
    for v in ids:
        step = []
        for f in partial:
            for o in rows:
                if word[v] in o[1]:
                    g = {**f, v: o}
                    if all(holds(e, g[e.vi], g[e.vj]) for e in p.edges if v in e.ends and e.vi in g and e.vj in g):
                        step.append(g)
        partial = step
    return {tuple(f[v][0] for v in ids) for f in partial}


def answers(df, p):
    return {tuple(r) for r in df.select(*(f"`{v.id}`" for v in p.vertices)).collect()}


@pytest.mark.parametrize("seed", range(8))
def test_random_patterns_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = town(seed, 40)
    t = table(spark, rows).cache()
    p = random_pattern(STRUCTURES[2 + seed % 7], WORDS, (0.0, 0.4, 1.0)[seed % 3], rng, scale=0.6)
    want = brute(rows, p)
    assert answers(match(t, p), p) == want
    assert answers(match(t, p, grid=False), p) == want
    assert answers(match(t, p, order="alternated"), p) == want
    if seed % 4 == 0:
        assert answers(solve_by_edges(t, p), p) == want
        assert answers(verify_late(t, p), p) == want


def test_reversed_edges_and_added_edges(spark):
    rows = town(5)
    t = table(spark, rows).cache()
    for sign, relation in itertools.product((">", "<", "<>", "-"), (None, "contains", "within")):
        e = Edge("0", "x", "y", 150, 900, sign, relation)
        vs = (Vertex("x", "a"), Vertex("y", "b"))
        p, q = Pattern(vs, (e,)), Pattern(vs, (e.reversed(),))
        assert answers(match(t, p), p) == answers(match(t, q), p) == brute(rows, p)
        more = Pattern(vs, (e, Edge("1", "y", "x", 0, 700)))
        assert answers(match(t, more), more) <= answers(match(t, p), p)


def test_edge_cases_of_patterns(spark):
    rows = [(1, ["a"], 0, 0, 0, 0), (2, ["a", "b"], 0, 0, 0, 0), (3, ["b"], 9000, 0, 0, 0), (4, ["c"], 0, 9000, 0, 0), (3, ["b"], 9000, 0, 0, 0)]
    t = table(spark, rows)
    one = lambda *e: Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", *e),))
    d = geo.metres(0, 0, 0, 0.009)
    assert answers(match(t, one(0, 0)), one()) == {(1, 2), (2, 2)}  # one place may fill both vertices
    assert answers(match(t, one(0, d, ">")), one()) == set()  # the co-located b excludes both, also with lower = 0
    assert answers(match(t, one(d, d + 1)), one()) == {(1, 3), (2, 3)}  # the bounds are inclusive
    assert answers(match(t, one()), one()) == {(1, 2), (2, 2), (1, 3), (2, 3)}
    missing = Pattern((Vertex("x", "a"), Vertex("y", "zzz")), (Edge("0", "x", "y", 0, 5),))
    assert match(t, missing).columns == ["x", "y"] and match(t, missing).count() == 0
    apart = Pattern((Vertex("x", "b"), Vertex("y", "c")))
    assert answers(match(t, apart), apart) == {(2, 4), (3, 4)}
    same = Pattern((Vertex("x", "b"), Vertex("y", "b")), (Edge("0", "x", "y", 10, 1e6),))
    assert answers(match(t, same), same) == {(2, 3), (3, 2)}
    multi = MultiPattern((MultiVertex("x", ("a", "c")), MultiVertex("y", ("b",))), (Edge("0", "x", "y", 0, d),))
    assert answers(match(t, multi), one()) == {(1, 2), (2, 2), (1, 3), (2, 3), (4, 2)}
    assert match(t, one(), limit=2).count() == 2
    assert match(t.where("false"), one()).count() == 0
    assert answers(edge_matches(t, one(0, 1).edges[0], one()), one()) == {(1, 2), (2, 2)}


SHAPES = {
    "point": [(0, 0)], "square": [(-10, -10), (10, -10), (10, 10), (-10, 10)], "inner": [(-5, -5), (5, -5), (5, 5), (-5, 5)],
    "side": [(10, -10), (30, -10), (30, 10), (10, 10)], "corner": [(10, 10), (20, 10), (20, 20), (10, 20)],
    "over": [(0, 0), (40, 0), (40, 5), (0, 5)], "far": [(90, 90), (95, 90), (95, 95), (90, 95)], "tri": [(-10, -10), (10, -10), (-10, 10)],
    "edge point": [(10, 3)],
}
WANT = {
    ("square", "square"): "equals contains covers intersects within coveredby", ("square", "inner"): "contains covers intersects",
    ("inner", "square"): "intersects within coveredby", ("square", "side"): "touches intersects", ("square", "corner"): "touches intersects",
    ("square", "over"): "intersects overlaps", ("square", "far"): "disjoint", ("square", "tri"): "contains covers intersects",
    ("square", "point"): "contains covers intersects", ("point", "square"): "intersects within coveredby",
    ("square", "edge point"): "touches covers intersects", ("edge point", "square"): "touches intersects coveredby", ("point", "point"): "equals contains covers intersects within coveredby",
    ("point", "far"): "disjoint", ("point", "edge point"): "disjoint", ("tri", "over"): "touches intersects",
}


def test_relations_of_pairs_by_hand(spark):
    t = spark.createDataFrame([(a, b, SHAPES[a], SHAPES[b]) for a, b in WANT], f"a string, b string, x {VERTEX}, y {VERTEX}")
    x, y = F.col("x"), F.col("y")
    m = topology.relate(x, y)
    by_mask = F.array_compact(F.array(*(F.when(topology.satisfies(F.col("m"), r, topology.dimension(x), topology.dimension(y)), F.lit(r)) for r in topology.MASKS)))
    rows = t.withColumn("m", m).select("a", "b", topology.all_relations(x, y).alias("r"), by_mask.alias("k"), topology.relation_label(x, y).alias("one"), "m").collect()
    order = list(topology.MASKS)
    for r in rows:
        want = sorted(WANT[r.a, r.b].split(), key=order.index)
        assert r.r == want, (r.a, r.b)
        assert r.k == want, (r.a, r.b, r.m)
        assert r.one == next(k for k in ("contains", "within", "intersects", "disjoint") if k in want)


def test_matrices_by_hand(spark):
    want = {("square", "inner"): "212FF1FF2", ("square", "side"): "FF2F11212", ("square", "corner"): "FF2F01212", ("square", "over"): "212101212", ("square", "far"): "FF2FF1212"}
    for (a, b), m in want.items():
        t = spark.createDataFrame([(SHAPES[a], SHAPES[b])], f"x {VERTEX}, y {VERTEX}")
        assert t.select(topology.relate(F.col("x"), F.col("y"))).first()[0] == m, (a, b)


def test_distances(spark):
    d = spark.range(1).select(geo.haversine(F.lit(51.5), F.lit(-0.1), F.lit(51.6), F.lit(0.2)).alias("d"), geo.euclidian(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)).alias("e")).first()
    assert d.d == pytest.approx(geo.metres(51.5, -0.1, 51.6, 0.2), rel=1e-12) and d.e == 5
    for lat, r in ((0, 1000), (51.5, 5000), (-80, 20000)):
        (s, _), (n, _) = geo.vertical_extremes(lat, 10, r)
        (_, w), (_, e) = geo.horizontal_extremes(lat, 10, r)
        for la, lo in ((s, 10), (n, 10), (lat, w), (lat, e)):
            assert geo.metres(lat, 10, la, lo) == pytest.approx(r, rel=1e-6)
        x0, y0, x1, y1 = geo.radius_bbox(lat, 10, r)
        for k in range(0, 360, 15):  # points on the circle lie in the box
            la = lat + geo.vertical_reach(r * math.cos(math.radians(k))) * 0.9999
            lo = 10 + geo.horizontal_reach(abs(r * math.sin(math.radians(k))), max(abs(la), abs(lat))) * (1 if k < 180 else -1) * 0.5
            assert y0 <= la <= y1 and x0 <= lo <= x1


def test_box_distances_against_samples(spark):
    rng = random.Random(1)
    for _ in range(6):
        a, b = ([rng.uniform(-1, 1), rng.uniform(50, 52)] for _ in "ab")
        a, b = (dict(zip(("xmin", "ymin", "xmax", "ymax"), (*p, p[0] + rng.random(), p[1] + rng.random()), strict=True)) for p in (a, b))
        lit = lambda q: {k: F.lit(v) for k, v in q.items()}
        lo, hi = spark.range(1).select(geo.boxes_dmin(lit(a), lit(b)), geo.boxes_dmax(lit(a), lit(b))).first()
        for _ in range(300):
            p, q = ((rng.uniform(z["xmin"], z["xmax"]), rng.uniform(z["ymin"], z["ymax"])) for z in (a, b))
            assert lo - 1e-6 <= geo.metres(p[1], p[0], q[1], q[0]) <= hi + 1e-6


def test_searches(spark):
    rows = town(3)
    t = table(spark, rows).cache()
    d = {r[0]: geo.metres(51.51, -0.118, r[3] / 1e6, r[2] / 1e6) for r in rows}
    has = lambda r, *k: set(k) & set(r[1])
    ids = lambda df: sorted(r.osm_id for r in df.collect())
    assert ids(search.in_circle(t, ["a", "b"], 51.51, -0.118, 400)) == sorted(r[0] for r in rows if has(r, "a", "b") and d[r[0]] <= 400)
    assert ids(search.in_annulus(t, "c", 51.51, -0.118, 100, 500)) == sorted(r[0] for r in rows if has(r, "c") and 100 < d[r[0]] <= 500)
    near = sorted((r for r in rows if has(r, "d")), key=lambda r: (d[r[0]], r[0]))[:4]
    assert [r.osm_id for r in search.nearest(t, "d", 51.51, -0.118, 4).collect()] == [r[0] for r in near]
    assert search.exists_in_circle(t, ["zz"], 51.51, -0.118, 1e6).first()[0] is False
    spot = next(r for r in rows if has(r, "e"))
    exact = d[spot[0]]
    assert spot[0] in ids(search.in_circle(t, ["e"], 51.51, -0.118, exact)) and spot[0] not in ids(search.in_circle(t, ["e"], 51.51, -0.118, exact, strict=True))
    assert ids(search.by_ids(t, [3, 5, 999])) == [3, 5]


def test_files_round_trip(spark, tmp_path):
    wkt = [
        (1, "A", "cafe", "", "POLYGON ((0 0, 0 0.01, 0.01 0.01, 0.01 0, 0 0))"), (2, None, None, "toys", "POINT (1.5 2.25)"),
        (3, "L", None, None, "LINESTRING (0 0, 0 2)"), (4, "none", None, None, "POINT (3 3)"),
    ]
    src = spark.createDataFrame(wkt, "osm_id long, name string, amenity string, shop string, geometry string")
    src.coalesce(1).write.option("header", True).option("sep", ";").csv(str(tmp_path / "in"))
    t = P.read_csv(spark, str(tmp_path / "in"), sep=";", tags=("amenity", "shop"), schema="osm_id long, name string, amenity string, shop string, geometry string")
    r = {x.osm_id: x for x in t.collect()}
    assert r[1].keywords == ["cafe"] and r[2].keywords == ["toys"] and r[4].keywords == [] and r[2].category == "shop,"
    assert [(v.x, v.y) for v in r[1].ring] == [(10000, 0), (10000, 10000), (0, 10000), (0, 0)]  # turned counter-clockwise
    assert (r[1].lon, r[1].lat) == (pytest.approx(0.005), pytest.approx(0.005)) and (r[3].lon, r[3].lat) == (0, 1)
    P.write_csv(t, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.where("osm_id = 2").first().geometry == "POINT (1.500000 2.250000)"
    P.write_geojson(t, str(tmp_path / "geo"))
    g = {x.osm_id: x for x in P.read_geojson(spark, str(tmp_path / "geo")).collect()}
    assert set(g) == {1, 2, 3, 4} and [(v.x, v.y) for v in g[1].ring] == [(v.x, v.y) for v in r[1].ring] and g[1].keywords == ["cafe"]
    lines = [x.value for x in spark.read.text(str(tmp_path / "geo")).collect()]
    (tmp_path / "fc.json").write_text('{"type":"FeatureCollection",\n"features":[' + ",\n".join(lines) + "]}")
    assert P.read_geojson(spark, str(tmp_path / "fc.json"), multi_line=True).count() == 4
    P.write_index(t, str(tmp_path / "index"), buckets=8)
    assert [x.osm_id for x in P.read_index(spark, str(tmp_path / "index"), ["toys"], buckets=8).collect()] == [2]
    assert P.read_index(spark, str(tmp_path / "index")).count() == 2


def test_index_answers_patterns(spark, tmp_path):
    rows = town(4)
    t = table(spark, rows)
    P.write_index(t, str(tmp_path / "i"))
    p = Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", 100, 800, ">"),))
    assert answers(match(P.read_index(spark, str(tmp_path / "i"), ["a", "b"]), p), p) == brute(rows, p)


def test_preparation(spark):
    t = spark.createDataFrame([("Fish & Chips!",), ("a-b  c",), (None,), ("",)], "s string")
    assert [r[0] for r in t.select(prep.normalise_tag(F.col("s"))).collect()] == ["Fish_Chips", "a_b_c", None, ""]
    assert prep.hull(prep.np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])).tolist() == [[0, 0], [4, 0], [4, 4], [0, 4]]
    grown = prep.offset(prep.np.array([(0, 0), (4, 0), (4, 4), (0, 4)]), 1.0)
    assert grown.min() == pytest.approx(-1) and grown.max() == pytest.approx(5) and len(grown) == 8
    rows = spark.createDataFrame([(i, [(0, 0)]) for i in range(2000)], f"osm_id long, ring {VERTEX}")
    half, more = prep.sample_fraction(rows, 0.5), prep.sample_fraction(rows, 0.7)
    assert 850 < half.count() < 1150 and half.join(more, "osm_id", "left_anti").count() == 0
    assert prep.first_fraction(rows, 0.25).count() == 501
    big = rows.limit(1).select(prep.buffered(100.0)("ring").alias("r")).first().r
    assert {(v.x, v.y) for v in big} == {(100, 0), (0, 100), (-100, 0), (0, -100)}
    regions = table(spark, [(9, ["r"], 0, 0, 500, 500), (8, ["r"], 0, 0, 900, 900)]).withColumn("name", F.concat(F.lit("r"), F.col("osm_id")))
    places = table(spark, [(1, ["a"], 10, 10, 5, 5), (2, ["a"], 700, 0, 5, 5)])
    assert {tuple(r) for r in prep.municipality(places, regions).collect()} == {(1, "r8")}


def test_grid_views(spark):
    rows = town(6)
    t = table(spark, rows)
    bounds = (-0.13, 51.50, -0.10, 51.52)
    n = grid.nodes(t, bounds, 4).collect()
    for level in range(5):
        assert sum(r.n for r in n if r.level == level) == len(rows)
    leaves = grid.leaves(t, bounds, 4, 10).collect()
    assert sum(r.n for r in leaves) == len(rows) and all(r.n <= 10 or r.level == 4 for r in leaves)
    key = leaves[0].quadkey
    x0, y0, x1, y1 = geo.quadkey_bbox(key, bounds)
    assert all(x0 - 1e-9 <= r.lon <= x1 + 1e-9 and y0 - 1e-9 <= r.lat <= y1 + 1e-9 for r in grid.in_subtree(t, bounds, key).collect())
    cells = grid.cell_stats(t, bounds, 3)
    pairs = {tuple(r) for r in grid.matching_cells(cells, cells, 0, 300).collect()}
    keyed = grid.with_quadkey(t, bounds, 3).select("osm_id", "quadkey", "lon", "lat").collect()
    for p, q in itertools.product(keyed, keyed):
        if geo.metres(p.lat, p.lon, q.lat, q.lon) <= 300:
            assert (p.quadkey, q.quadkey) in pairs


def test_solutions_as_json(spark):
    t = table(spark, [(1, ["a"], 0, 0, 0, 0), (2, ["b"], 1000, 0, 0, 0)])
    p = Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", 0, 500),))
    assert report.solutions_document(match(t, p)) == '{"solutions":[{"x":1,"y":2}]}'
    assert '"description":"n1 (a)"' in report.solutions_document(match(t, p), t)


def test_grid_plan_has_no_nested_loop(spark):
    t = table(spark, town(7))
    p = Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", 100, 500, "<>"),))
    plan = match(t, p)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert ematch.extent_of(t.where("false")).max_abs_lat == 0.0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_shuffled_for_distinctness_only_where_ids_repeat(spark):
    rows = town(9)
    p = Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", 0, 2000),))
    once, twice = table(spark, rows), table(spark, [*rows, *rows[:30]])
    assert "Aggregate" not in plan_of(match(once, p)) and "Aggregate" in plan_of(match(twice, p))
    assert sorted(map(tuple, match(once, p).collect())) == sorted(map(tuple, match(twice, p).collect())) == sorted(brute(rows, p))


def test_nested_loops_ask_cheap_bounds_first_and_lose_no_pair(spark):
    rng = random.Random(3)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(90.0, 7.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (89.99, 10.0), (89.99, -170.0)]
    spots += [(51.5 + rng.uniform(0, 0.02), -0.1 + rng.uniform(0, 0.02)) for _ in range(60)]
    t = spark.createDataFrame([(i, [w], lon, lat, 0, 0, 0, 0) for i, (lat, lon) in enumerate(spots) for w in "ab"], "osm_id long, keywords array<string>, lon double, lat double, xmin long, ymin long, xmax long, ymax long").cache()
    d = {(i, j): geo.metres(*p, *q) for i, p in enumerate(spots) for j, q in enumerate(spots)}
    for lower, upper in ((0, 0.001), (0, 700), (300, 1500), (0, 3e6), (1e-3, math.inf), (900, math.inf), (1.2e7, math.inf), (1e7, 1.9e7)):
        p = Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", lower, upper),))
        found = match(t, p, grid=False)
        assert answers(found, p) == {k for k, v in d.items() if lower <= v <= upper}
        text = plan_of(found)
        assert "Repartition" in text and "broadcast" in text
    ask = lambda *bounds: ematch.reachable("x", "y", *bounds, ematch.Extent(51.6))
    assert ask(0, 700) is not None and ask(900, math.inf) is not None and ask(0, math.inf) is None


def test_parts_of_a_pattern_are_solved_apart(spark):
    rows = town(11, 40)
    t = table(spark, rows)
    p = Pattern(tuple(Vertex(k, w) for k, w in zip("uvwxy", "abcde", strict=True)), (Edge("0", "u", "v", 0, 1500), Edge("1", "w", "x", 0, 1500)))
    for poi in (t, table(spark, [*rows, *rows[:7]])):
        found = match(poi, p)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, p)
        tops = [line for line in plan_of(found).splitlines() if "Join" in line]
        assert all("Cross" in x or x.count("Inner") == 1 and "_cx" not in x for x in tops[:2])  # cells are joined below the products


def test_solutions_by_edges_are_distinct_without_a_shuffle_of_them(spark):
    rows = town(12, 40)
    p = Pattern(tuple(Vertex(k, w) for k, w in zip("xyz", "abc", strict=True)), (Edge("0", "x", "y", 0, 2500), Edge("1", "y", "z", 0, 2500), Edge("2", "z", "x", 100, 4000)))
    for poi in (table(spark, rows), table(spark, [*rows, *rows[:9]])):
        out = solve_by_edges(poi, p)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, p)
        assert not plan_of(out).startswith("Aggregate")


def test_nested_loops_keep_to_bands_of_latitude(spark):
    t = table(spark, town(13))
    p = Pattern((Vertex("x", "a"), Vertex("y", "b")), (Edge("0", "x", "y", 100, 900),))
    found = match(t, p, grid=False)
    assert answers(found, p) == brute(town(13), p) and "_band" in plan_of(found) and "_cx" not in plan_of(found)


def test_only_doubtful_pairs_are_asked_for_their_distance(spark):
    rng = random.Random(15)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(50)] + [(90.0, 7.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (51.5, -0.1), (51.5, -0.1)]
    spots += [(51.5 + rng.uniform(0, 0.02), -0.1 + rng.uniform(0, 0.02)) for _ in range(50)]
    pairs = [(*p, *q) for p in spots for q in spots]
    t = spark.createDataFrame(pairs, "`a.lat` double, `a.lon` double, `b.lat` double, `b.lon` double").cache()
    for extent in (ematch.Extent(90.0), ematch.Extent(90.0, min_abs_lat=0.0)):
        for bounds in ((0, 0), (0, 700), (300, 1500), (1e-3, math.inf), (0, 3e6), (1e7, 1.9e7), (0, 2.1e7), (2.001e7, math.inf)):
            exact, told = ematch.distance_condition("a", "b", *bounds), ematch.distance_condition("a", "b", *bounds, extent=extent)
            assert t.where(exact != told).count() == 0, bounds
    city = t.where("`a.lat` between 51.49 and 51.53 and `b.lat` between 51.49 and 51.53 and abs(`a.lon`) < 1 and abs(`b.lon`) < 1")
    near = ematch.Extent(51.53, min_abs_lat=51.49)
    assert city.where(ematch.distance_condition("a", "b", 300, 700) != ematch.distance_condition("a", "b", 300, 700, extent=near)).count() == 0


def crowd(seed, n=60, words="abcd", at=-118_000):
    """Points so near each other that most pairs are within a kilometre."""
    rng = random.Random(seed)
    return [(i, [rng.choice(words)], at + rng.randrange(0, 14) * 1000, 51_510_000 + rng.randrange(0, 9) * 1000, 0, 0) for i in range(n)]


def joined(words, *edges):
    return Pattern(tuple(Vertex(v, words[i]) for i, v in enumerate("pqrst"[: len(words)])), tuple(Edge(str(i), *e) for i, e in enumerate(edges)))


TAIL = joined("abcd", ("p", "q", 0, 500), ("q", "r", 0, 600), ("r", "s", 0, 500), ("s", "q", 100, 700))


def test_leaves_are_listed_and_multiplied_at_the_end(spark):
    assert planner.listed(TAIL, ("p", "q", "r", "s"), {}) == {"p"}
    assert planner.listed(joined("ab", ("p", "q", 0, 500)), ("p", "q"), {}) == set()
    for seed, at in ((1, -118_000), (2, 179_994_000)):  # also across the antimeridian
        rows = [(i, k, x if x < 180_000_000 else x - 360_000_000, *r) for i, k, x, *r in crowd(seed, 70, at=at)]
        found = match(table(spark, rows), TAIL)
        got = [tuple(r) for r in found.select("p", "q", "r", "s").collect()]
        assert len(got) == len(set(got)) > 50 and set(got) == brute(rows, TAIL)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(p.all" in text and text.index("explode(p.all") < text.index("Join")  # nothing is joined to an answer's rows


CYCLE = joined("abcde"[:4] + "a", ("p", "q", 0, 600), ("q", "r", 0, 500), ("r", "s", 50, 700), ("s", "t", 0, 600), ("t", "p", 0, 900))


def test_cycles_list_what_two_places_have_in_common(spark, monkeypatch):
    from geomotif.operators import match as module

    rows = crowd(3, 60)
    t = table(spark, rows).cache()
    square = joined("abcd", ("p", "q", 0, 600), ("q", "r", 0, 500), ("r", "s", 0, 700), ("s", "p", 100, 900))
    for p, common in ((CYCLE, 2), (square, 2)):
        apart = planner.listed(p, tuple(v.id for v in p.vertices), {})
        assert len(apart) == common and not any(b in p.neighbours(a) for a in apart for b in apart)
        want = brute(rows, p)
        found = match(t, p)
        assert answers(found, p) == want and found.count() == len(want) > 100
        assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(module, "LISTED", 0)  # lists that are too long to send
    found = match(t, CYCLE)
    assert answers(found, CYCLE) == brute(rows, CYCLE)
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_orders_of_listed_patterns_agree(spark):
    rows = [*crowd(4, 60), (60, ["a", "d"], -118_000, 51_510_000, 0, 0)]
    t = table(spark, rows).cache()
    path = joined("abcd", ("p", "q", 50, 400), ("q", "r", 150, 500, "<"), ("r", "s", 0, 900), ("s", "r", 100, 800))
    want = brute(rows, path)
    assert len(want) > 50
    for order in planner.ORDERS:
        found = match(t, path, order=order)
        assert answers(found, path) == want and found.count() == len(want)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(p.all" in text and "explode(s.all" in text
    twice = table(spark, [*rows, rows[0]])  # a keyword with two rows of an id: no lists
    assert "explode(p.all" not in match(twice, path)._jdf.queryExecution().optimizedPlan().toString() and answers(match(twice, path), path) == want


def test_edges_are_joined_by_lists_of_the_places_they_leave(spark, monkeypatch):
    from geomotif.operators import match as module

    rows = crowd(5, 60)
    t = table(spark, rows).cache()
    path = joined("abca", ("p", "q", 50, 400), ("q", "r", 150, 500, "<"), ("r", "s", 0, 900), ("s", "r", 100, 800))
    for p in (TAIL, CYCLE, path):
        want = brute(rows, p)
        for alternated in (True, False):
            out = solve_by_edges(t, p, alternated)
            got = [tuple(r) for r in out.select(*(v.id for v in p.vertices)).collect()]
            assert len(got) == len(set(got)) > 50 and set(got) == want
            # pairs and partial answers are neither held nor shuffled: lists are multiplied above all joins
            text = out._jdf.queryExecution().optimizedPlan().toString()
            assert ".all" in text and text.index("explode(") < text.index("Join")
    monkeypatch.setattr(module.ematch, "SENT", 10)  # too many places to send: edges' matches are held and joined
    assert answers(solve_by_edges(t, TAIL), TAIL) == brute(rows, TAIL)
    none = joined("abcz", ("p", "q", 0, 500), ("q", "r", 0, 600), ("r", "s", 0, 500))
    assert solve_by_edges(t, none).count() == 0


def test_products_of_parts_go_by_blocks(spark, monkeypatch):
    rows = town(14, 40)
    p = Pattern(tuple(Vertex(k, w) for k, w in zip("uvwxy", "abcde", strict=True)), (Edge("0", "u", "v", 0, 1500), Edge("1", "w", "x", 0, 1500)))
    monkeypatch.setattr(ematch, "BLOCK", 4)
    for poi in (table(spark, rows), table(spark, [*rows, *rows[:7]])):
        found = match(poi, p)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) > 100 and set(got) == brute(rows, p)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert all(f"explode(_block{k}" in text for k in range(3)) and text.index("explode(") < text.index("Join")
    assert match(table(spark, rows), Pattern(p.vertices, (Edge("0", "u", "v", 0.25, 0.5), p.edges[1]))).count() == 0
