"""SQL text of a pattern, in words that Spark SQL and DuckDB both read.

One common table expression a vertex, named after the vertex, so a keyword may occur twice. ``implicit`` lists all
tables and puts every condition in WHERE; ``explicit`` joins in a greedy order with the conditions in ON. Relations are
written for axis-aligned rectangles by their boxes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from ..functions import geo
from . import planner
from .pattern import Edge, Pattern

# Conditions on boxes a and b of rectangles with area, by relation.
_MEET = "{a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax"
_INNER = "{a}.xmin < {b}.xmax AND {b}.xmin < {a}.xmax AND {a}.ymin < {b}.ymax AND {b}.ymin < {a}.ymax"
_COVERS = "{a}.xmin <= {b}.xmin AND {b}.xmax <= {a}.xmax AND {a}.ymin <= {b}.ymin AND {b}.ymax <= {a}.ymax"
_STRICT = "{a}.xmin < {b}.xmin AND {b}.xmax < {a}.xmax AND {a}.ymin < {b}.ymin AND {b}.ymax < {a}.ymax"
_COVERED = _COVERS.replace("{a}", "{0}").replace("{b}", "{a}").replace("{0}", "{b}")
_POINT_A, _POINT_B = "({a}.xmin = {a}.xmax)", "({b}.xmin = {b}.xmax)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def name(v: str) -> str:
    return '"' + v.replace('"', '""') + '"'


def distance(a: str, b: str, radius: float = 6371000.0) -> str:
    la, lb = f"radians({a}.lat)", f"radians({b}.lat)"
    h = f"0.5 - cos({lb} - {la}) / 2 + cos({la}) * cos({lb}) * (1 - cos(radians({b}.lon - {a}.lon))) / 2"
    return f"2 * {radius!r} * asin(sqrt(greatest(0.0, least(1.0, {h}))))"


def relation(a: str, b: str, kind: str) -> str:
    """A condition on two rectangles; points are rectangles without extent."""
    meet = _MEET
    # interiors of rectangles and points meet: a point's interior is itself and must be strictly inside
    inner = f"CASE WHEN {_POINT_A} AND {_POINT_B} THEN ({_COVERS}) WHEN {_POINT_B} THEN ({_STRICT}) WHEN {_POINT_A} THEN ({_STRICT.replace('{a}', '{0}').replace('{b}', '{a}').replace('{0}', '{b}')}) ELSE ({_INNER}) END"
    text = {
        "intersects": f"({meet})", "disjoint": f"NOT ({meet})", "covers": f"({_COVERS})", "coveredby": f"({_COVERED})",
        "contains": f"(({_COVERS}) AND {inner})", "within": f"(({_COVERED}) AND {inner})", "equals": f"(({_COVERS}) AND ({_COVERED}))",
        "touches": f"(({meet}) AND NOT ({inner}))",
        "overlaps": f"({_POINT_A} = {_POINT_B} AND ({inner}) AND NOT ({_COVERS}) AND NOT ({_COVERED}))",
        "crosses": f"({_POINT_A} <> {_POINT_B} AND ({inner}) AND NOT ({_COVERS}) AND NOT ({_COVERED}))",
    }[kind]
    return text.format(a=a, b=b)


def vertex_table(v: str, keyword: str, source: str) -> str:
    return f"{name(v)} AS (SELECT * FROM {source} WHERE array_contains(keywords, {quote(keyword)}))"


def edge_conditions(e: Edge) -> list[str]:
    a, b = name(e.vi), name(e.vj)
    out = []
    if e.lower > 0 and e.upper < math.inf:
        out.append(f"{distance(a, b)} BETWEEN {e.lower!r} AND {e.upper!r}")
    elif e.upper < math.inf:
        out.append(f"{distance(a, b)} <= {e.upper!r}")
    elif e.lower > 0:
        out.append(f"{distance(a, b)} >= {e.lower!r}")
    for v, w, signs in ((a, b, (">", "<>")), (b, a, ("<", "<>"))):
        if e.sign in signs:
            out.append(f"NOT EXISTS (SELECT 1 FROM {w} AS other WHERE {distance(v, 'other')} <= {e.lower!r})")
    if e.relation:
        out.append(relation(a, b, e.relation))
    return out


def pattern_sql(pattern: Pattern, source: str = "pois", strategy: str = "implicit", frequency: Mapping[str, int] | None = None, limit: int = 0, ctes: Sequence[str] = (), spark: bool = False) -> str:
    """The whole query; ids come back as a column for each vertex, in the pattern's order."""
    ids = [v.id for v in pattern.vertices]
    head = "WITH " + ",\n".join([*ctes, *(vertex_table(v.id, v.keyword, source) for v in pattern.vertices)])
    pick = ", ".join(f"{name(v)}.osm_id AS {name(v)}" for v in ids)
    if strategy == "implicit":
        conds = [x for e in pattern.edges for x in edge_conditions(e)]
        body = "FROM " + ", ".join(map(name, ids)) + ("\nWHERE " + "\n  AND ".join(conds) if conds else "")
    elif strategy == "explicit":
        order = planner.vertex_order(pattern, frequency or {})
        body = f"FROM {name(order[0])}"
        for k, v in enumerate(order[1:], 1):
            conds = [x for e in planner.bound_edges(pattern, v, order[:k]) for x in edge_conditions(e)]
            body += f"\nINNER JOIN {name(v)} ON " + "\n  AND ".join(conds) if conds else f"\nCROSS JOIN {name(v)}"
    else:
        raise ValueError("strategy must be implicit or explicit")
    text = f"{head}\nSELECT DISTINCT {pick}\n{body}" + (f"\nLIMIT {limit}" if limit > 0 else "")
    return text.replace('"', "`") if spark else text


def _told(e: Edge, low: float, high: float) -> list[str]:
    """edge_conditions() of an edge without a sign, where only pairs that a few multiplications leave open are asked for their
    distance, as in ematch.distance_condition(). low, high: least and greatest distance from the equator, in degrees."""
    exact = edge_conditions(Edge(e.id, e.vi, e.vj, e.lower, e.upper))
    if not exact:
        return edge_conditions(e)
    a, b = name(e.vi), name(e.vj)
    narrow, wide = (math.cos(math.radians(min(90.0, v))) ** 2 for v in (high, low))
    dx, dy, series = f"least(abs({b}.lon - {a}.lon), 360 - abs({b}.lon - {a}.lon))", f"({b}.lat - {a}.lat)", math.radians(1) ** 2 / 12
    most = f"({dy} * {dy} + {dx} * {dx} * {wide * (1 + 1e-9)!r}D)"
    least = f"({dy} * {dy} * (1 - {dy} * {dy} * {series!r}D) + {dx} * {dx} * (1 - {dx} * {dx} * {series!r}D) * {narrow * (1 - 1e-9)!r}D)"
    square = lambda v, by: math.degrees(math.degrees(4 * math.sin(min(v / (2 * geo.RADIUS), math.pi / 2)) ** 2 * (1 + by * 1e-9) + by * 1e-13))
    inside, outside = [], []
    if e.upper < math.inf:
        inside.append(f"{most} < {square(e.upper, -1)!r}D")
        outside.append(f"{least} > {square(e.upper, 1)!r}D")
    if e.lower > 0:
        inside.append(f"{least} > {square(e.lower, 1)!r}D")
        outside.append(f"{most} < {square(e.lower, -1)!r}D")
    told = f"CASE WHEN {' OR '.join(outside)} THEN false WHEN {' AND '.join(inside)} THEN true ELSE {exact[0]} END"
    return [told, *([relation(a, b, e.relation)] if e.relation else [])]


def _cell(v: str, reach: float, lat: float) -> tuple[str, str, int]:
    """The column and row of a vertex's cell, such that points within reach are in cells next to each other, and the
    number of columns, which go round the earth."""
    gx, gy = geo.cell_size(max(reach, 1.0), lat)
    n = geo.columns_round(gx)
    return f"pmod(CAST(floor(({v}.lon + 180) / {360 / n!r}D) AS BIGINT), {n})", f"CAST(floor({v}.lat / {gy!r}D) AS BIGINT)", n


def _around(v: str, alias: str, reach: float, lat: float) -> str:
    """Lateral views of a vertex's cell and those next to it, each once: columns alias_x and alias_y."""
    cx, cy, n = _cell(v, reach, lat)
    steps = "-1, 0, 1" if n >= 3 else ", ".join(map(str, range(n)))
    return (
        f" LATERAL VIEW explode(transform(array({steps}), d -> pmod({cx} + d, {n}))) {alias}_tx AS {alias}_x"
        f" LATERAL VIEW explode(sequence({cy} - 1, {cy} + 1)) {alias}_ty AS {alias}_y"
    )


def spark_sql(pattern: Pattern, source: str, strategy: str, frequency: Mapping[str, int], max_abs_lat: float, tasks: int = 0, min_abs_lat: float = 0.0, unique: bool = False) -> str:
    """pattern_sql() for Spark, which plans a condition on distance alone as a nested loop: a vertex enters the cells about
    its own for its tightest edge to those before it, and distances are asked where cells are equal, here and in exclusions.
    tasks: to how many the places of a vertex are dealt, since few files may hold them all. unique: whether no two places of a
    keyword have one id, so that answers are distinct without a shuffle of them all."""
    deal = f"/*+ REPARTITION({tasks}) */ " if tasks else ""
    if strategy not in ("implicit", "explicit"):
        raise ValueError("strategy must be implicit or explicit")
    ids = [v.id for v in pattern.vertices]
    order = planner.vertex_order(pattern, frequency) if strategy == "explicit" else ids
    tables, conds = [], {}
    for k, v in enumerate(order):
        edges = planner.bound_edges(pattern, v, order[:k])
        lead = min((e for e in edges if e.upper < math.inf), key=lambda e: (e.upper, e.id), default=None)
        barred = []
        for i, (word, radius) in enumerate(sorted(planner.exclusions(pattern).get(v, {}).items())):
            cx, cy, _ = _cell("own", radius, max_abs_lat)
            others = f"(SELECT p.lat, p.lon, o{i}_x, o{i}_y FROM {source} p{_around('p', f'o{i}', radius, max_abs_lat)} WHERE array_contains(p.keywords, {quote(word)}))"
            barred.append(f"NOT EXISTS (SELECT 1 FROM {others} AS other WHERE o{i}_x = {cx} AND o{i}_y = {cy} AND {distance('own', 'other')} <= {radius!r})")
        where = " AND ".join([f"array_contains(own.keywords, {quote(pattern.keyword(v))})", *barred])
        kept = f"SELECT {deal}own.osm_id, own.lon, own.lat, own.xmin, own.ymin, own.xmax, own.ymax FROM {source} own WHERE {where}"
        if lead:
            kept = f"SELECT near.*, _v_x, _v_y FROM ({kept}) near{_around('near', '_v', lead.upper, max_abs_lat)}"
        tables.append(f"{name(v)} AS ({kept})")
        mine = []
        if lead:
            cx, cy, _ = _cell(name(lead.other(v)), lead.upper, max_abs_lat)
            mine = [f"{cx} = {name(v)}._v_x", f"{cy} = {name(v)}._v_y"]
        for e in edges:
            mine += _told(Edge(e.id, e.vi, e.vj, e.lower, e.upper, "-", e.relation), min_abs_lat, max_abs_lat)
        conds[v] = mine
    body = f"FROM {name(order[0])}"
    if strategy == "implicit":
        every = [x for v in order for x in conds[v]]
        body = "FROM " + ", ".join(map(name, ids)) + ("\nWHERE " + "\n  AND ".join(every) if every else "")
    else:
        for v in order[1:]:
            body += f"\nINNER JOIN {name(v)} ON " + "\n  AND ".join(conds[v]) if conds[v] else f"\nCROSS JOIN {name(v)}"
    pick = ", ".join(f"{name(v)}.osm_id AS {name(v)}" for v in ids)
    return f"WITH {', '.join(tables)}\nSELECT {'' if unique else 'DISTINCT '}{pick}\n{body}".replace('"', "`")
