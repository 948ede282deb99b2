import math

import pytest

from geomotif.plans import planner
from geomotif.plans.pattern import Edge, MultiPattern, MultiVertex, Pattern, PatternError, Vertex, read_patterns, write_patterns
from geomotif.testing.patterns import STRUCTURES, workload

P = Pattern(
    (Vertex("0", "cafe"), Vertex("1", "park"), Vertex("2", "bank"), Vertex("3", "shop")),
    (Edge("e0", "0", "1", 100, 500, ">"), Edge("e1", "1", "2", 0, 300), Edge("e2", "2", "3", 50, math.inf, "<>"), Edge("e3", "3", "1", 0, 900)),
)


def test_relation_replaces_distance_and_sign():
    e = Edge("x", "a", "b", 5, 10, "<>", "contains")
    assert (e.lower, e.upper, e.sign) == (0, math.inf, "-")
    d = Edge("x", "a", "b", 5, 10, "<>", "disjoint")
    assert (d.lower, d.upper, d.sign) == (5, 10, "<>")


def test_bad_edges_are_refused():
    for args in (("a", "b", 0, 1, "?"), ("a", "b", 0, 1, "-", "near"), ("a", "b", 5, 1)):
        with pytest.raises(PatternError):
            Edge("x", *args)
    with pytest.raises(PatternError):
        Pattern((Vertex("a", "k"),), (Edge("x", "a", "b"),))
    with pytest.raises(PatternError):
        Pattern((Vertex("a", "k"), Vertex("a", "l")))


def test_both_json_dialects():
    assert Pattern.from_json(P.to_json()) == P
    assert Pattern.from_json(P.to_map_json()) == P
    text = '{"vertices":[{"id":0,"keyword":"a"},{"id":1,"keyword":"b"}],"edges":[{"id":7,"vi":0,"vj":1,"lij":3,"uij":%s,"sign":"-","relation":null}]}'
    for inf in ("Infinity", "null"):
        assert Pattern.from_json(text % inf).edges[0] == Edge("7", "0", "1", 3)
    assert read_patterns(write_patterns([P, P]).splitlines()) == [P, P]


def test_multi_pattern_has_every_choice():
    m = MultiPattern((MultiVertex("a", ("x", "y")), MultiVertex("b", ("z", "x", "z"))), (Edge("e", "a", "b", 0, 1),))
    assert [tuple(v.keyword for v in p.vertices) for p in m.expand()] == [("x", "z"), ("x", "x"), ("y", "z"), ("y", "x")]


def test_graph_questions():
    assert P.exclusions == 3 and P.connected and P.neighbours("1") == ["0", "2", "3"]
    assert P.find_edges("1", "0")[0].id == "e0" and P.edge("e2").label() == "at least 50m, <>"
    assert Pattern(P.vertices, P.edges[:1]).components() == [("0", "1"), ("2",), ("3",)]


def test_edge_orders():
    n = {"e0": 5, "e1": 9, "e2": 1, "e3": 7}
    assert planner.edge_order(P, n) == ["e2", "e3", "e0", "e1"]
    assert planner.count_order(P, n) == ["e2", "e0", "e3", "e1"]
    alternated = planner.edge_order(P, n, alternated=True)
    assert sorted(alternated) == sorted(n) and alternated[:2] == ["e2", "e3"]
    assert planner.skip_edges(P, ["e0", "e1", "e2", "e3"]) == ["e3"]


def test_vertex_orders_are_connected():
    f = {"cafe": 4, "park": 9, "bank": 2, "shop": 3}
    for order in planner.ORDERS:
        got = planner.vertex_order(P, f, order)
        assert sorted(got) == ["0", "1", "2", "3"] and got[0] == "2"
        for k in range(1, 4):
            assert planner.bound_edges(P, got[k], got[:k])


def test_exclusions_keep_the_greatest_distance():
    p = Pattern(P.vertices[:2], (Edge("a", "0", "1", 10, 50, ">"), Edge("b", "1", "0", 30, 60, "<"), Edge("c", "0", "1", 5, 90, "<>")))
    assert planner.exclusions(p) == {"0": {"park": 30}, "1": {"cafe": 5}}


def test_workload_is_seeded_and_complete():
    w = workload([f"k{i}" for i in range(9)], seed=3)
    assert len(w) == 2 * 6 * len(STRUCTURES) == 144
    assert w == workload([f"k{i}" for i in range(9)], seed=3)
    assert max(len(p.vertices) for p in w) == 6
