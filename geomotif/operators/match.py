"""Pattern matching: a pattern becomes anti-joins on its vertices and a chain of ordered joins."""

from __future__ import annotations

import math
import weakref
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, shapes, topology
from ..plans import planner
from ..plans.pattern import MEETING, Edge, MultiPattern, Pattern
from . import ematch
from .ematch import Extent, c
from .report import let_go


def statistics(poi: DataFrame, keywords: list[str], shaped: bool = False) -> tuple[dict[str, int], Extent]:
    """Places of each keyword and their extent, in one pass; a row for each keyword of the pattern comes back. shaped: also
    what kinds of shapes there are."""
    odd = ["rings"] if "rings" in poi.columns else []
    boxes = [k for k in ematch.BOX if k in poi.columns]
    wide = lambda low, high: F.max((F.col(high) - F.col(low)) / 1e6) if boxes else F.lit(None)
    kinds = {k: v for k, v in ematch.shape_columns(poi).items() if k in ("flat", "sides")} if shaped else {}
    poi = poi.withColumns(kinds)
    rows = poi if "keyword" in poi.columns else poi.select(F.explode(F.array_distinct("keywords")).alias("keyword"), "osm_id", "lat", *boxes, *odd, *kinds)
    got = (
        rows.where(F.col("keyword").isin(keywords))
        .groupBy("keyword")
        .agg(
            F.count("*").alias("n"), F.count_distinct("osm_id").alias("ids"), F.max(F.abs("lat")).alias("lat"), F.min(F.abs("lat")).alias("low"),
            wide("xmin", "xmax").alias("w"), wide("ymin", "ymax").alias("h"),
            F.count("rings" if odd else F.lit(None)).alias("odd"),
            F.count_if(~F.col("flat") if kinds else F.lit(True)).alias("rough"),
            F.count_if(F.col("rings").isNotNull() & F.col("sides").isNull() if odd and kinds else F.lit(bool(odd))).alias("other"),
        )
        .collect()
    )
    top = lambda k: max((float(r[k] or 0.0) for r in got), default=0.0)
    low = min((float(r["low"] or 0.0) for r in got), default=0.0)
    words = {k: frozenset(r["keyword"] for r in got if r[k]) for k in ("odd", "rough", "other")}
    return {r["keyword"]: r["n"] for r in got}, Extent(top("lat"), top("w"), top("h"), top("odd") > 0, all(r["ids"] == r["n"] for r in got), low, **words, kinds=bool(kinds))


def edge_condition(e: Edge, metric: str, extent: Extent, whole: str, tiled: bool = False) -> Column | None:
    parts = [ematch.distance_condition(e.vi, e.vj, e.lower, e.upper, metric)]
    if e.relation:
        parts.append(ematch.relation_condition(e.vi, e.vj, e.relation, whole, tiled))
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def of_keywords(poi: DataFrame, words: list[str], shaped: bool, tiled: bool = False) -> DataFrame:
    """A row for each of the keywords of each place, with what joins need: what all vertices of a pattern read."""
    poi = poi.withColumn("sides", ematch.shape_columns(poi)["sides"]) if tiled else poi
    cols = {k: F.col(k) for k in ("osm_id", "lon", "lat")} | (ematch.shape_columns(poi, tiled) if shaped else {})
    picked = [v.alias(k) for k, v in cols.items()]
    if "keyword" in poi.columns:
        return poi.where(F.col("keyword").isin(words)).select("keyword", *picked)
    wanted = F.filter(F.array_distinct("keywords"), lambda k: k.isin(words))
    return poi.where(F.arrays_overlap("keywords", F.array(*map(F.lit, words)))).select(F.explode(wanted).alias("keyword"), *picked)


#: Ids in lists that are sent whole to every task, in all.
LISTED = 4_000_000


def by_lists(pattern: Pattern, order: list[str], apart: set[str], places: Callable[[str], DataFrame], extent: Extent, counts: dict[str, int], metric: str) -> tuple[DataFrame | None, list[DataFrame]]:
    """The assignments of a connected part, given in joining order, whose vertices apart are listed: each bound place carries
    the ids of their places near it, what is common to the lists of two places is told as soon as both are bound, and
    the lists are multiplied at the end. So what a combination costs is a step in a list; nothing that grows with the
    answer is shuffled or asked for a distance. Also what is held meanwhile; no assignments where lists are too long to send."""
    bound = [v for v in order if v not in apart]
    held: list[DataFrame] = []
    ends = lambda s: [v for v in bound if v in pattern.neighbours(s)]
    asked = lambda edges: [ematch.distance_condition(e.vi, e.vj, e.lower, e.upper, metric, extent) for e in edges]
    both = lambda parts: reduce(lambda a, b: a & b, parts)

    def with_lists(v: str) -> DataFrame:
        df = places(v)
        for s in sorted(set(pattern.neighbours(v)) & apart):
            edges = pattern.find_edges(v, s)
            pairs = ematch.sent_join(ematch.dealt(places(v)), v, places(s), s, min(e.upper for e in edges), extent, both(asked(edges)), metric)
            lists = pairs.groupBy(c(v, "osm_id").alias("_id")).agg(F.collect_list(c(s, "osm_id")).alias(f"{v}.{s}"))
            df = df.join(lists, c(v, "osm_id") == F.col("_id")).drop("_id")
        return df

    rows = {v: with_lists(v) for v in bound}
    long = 0
    for v in bound[1:]:
        own = [s for s in pattern.neighbours(v) if s in apart]
        if own:
            rows[v] = rows[v].persist(StorageLevel.MEMORY_AND_DISK)
            held.append(rows[v])
            long += rows[v].agg(F.sum(sum((F.size(c(v, s)) for s in own), F.lit(0)))).first()[0] or 0
        if long > LISTED:
            return None, held
    acc = ematch.dealt(rows[bound[0]])
    for k, v in enumerate(bound):
        if k:
            edges = planner.bound_edges(pattern, v, bound[:k])
            # two places with a common third are at most as far apart as it is from both; the slack is more than distances are off by
            ways = [Edge("", u, v, 0.0, (min(e.upper for e in pattern.find_edges(u, s)) + min(e.upper for e in pattern.find_edges(s, v))) * (1 + 1e-6) + (0.01 if metric == "geodesic" else 0.0)) for s in apart for u in ends(s) if v in ends(s) and u in bound[:k]]
            lead = min(edges or ways, key=lambda e: e.upper)
            acc = ematch.sent_join(acc, lead.other(v), rows[v], v, lead.upper, extent, both(asked([lead, *(e for e in (*edges, *ways) if e is not lead)])), metric)
        for s in sorted(apart):
            if ends(s) and ends(s)[-1] == v:
                lists = [c(u, s) for u in ends(s)]
                acc = acc.withColumn(f"{s}.all", F.array_intersect(*lists) if len(lists) > 1 else lists[0]).where(F.size(c(s, "all")) > 0)
        later = {f"`{u}.{s}`" for s in apart for u in ends(s) if u in bound[: k + 1] and ends(s)[-1] not in bound[: k + 1]}
        kept = [f"`{name}`" for name in acc.columns if name.endswith((".osm_id", ".lon", ".lat", ".all"))]
        acc = acc.select(*kept, *sorted(later))
    out = acc.select(*(f"`{name}`" for name in acc.columns if name.endswith((".osm_id", ".all"))))
    for s in sorted(apart, key=order.index):
        out = ematch.parted(out)
        out = out.select(*(f"`{name}`" for name in out.columns if name != f"{s}.all"), F.explode(c(s, "all")).alias(f"{s}.osm_id"))
    return out, held


def listable(pattern: Pattern, part: tuple[str, ...], counts: dict[str, int], extent: Extent) -> bool:
    """Whether by_lists() can solve a connected part: edges with an upper bound only, no relation, not too many places to send."""
    edges = [e for v in part for e in pattern.edges_of(v)]
    return extent.unique and all(not e.relation and 0 < e.upper < math.inf for e in edges) and sum(counts.get(pattern.keyword(v), 0) for v in part) <= ematch.SENT


def match(poi: DataFrame, pattern: Pattern | MultiPattern, order: str | tuple[str, ...] = "count", metric: str = "geodesic", grid: bool = True, limit: int | None = None, staged: DataFrame | None = None, known: tuple[dict[str, int], Extent] | None = None, held: bool = True, able: dict[str, DataFrame] | None = None) -> DataFrame:
    """All assignments of places to the vertices that satisfy every edge: a column of ids for each vertex.

    The rarest keyword starts. Exclusions concern one vertex each and thin its places before any pair is formed. Each
    further vertex is joined over the grid of its tightest edge to what is bound; its other edges to bound vertices
    are conditions of the same join. One place may fill two vertices; assignments are distinct, which takes a shuffle of
    them all only where a keyword has several rows of one id. order: one of planner.ORDERS, or the vertices themselves. staged: the
    rows of of_keywords() on disk, which then are all that is read. able: of some vertices, the only ids (in _id) that may fill them.
    """
    if isinstance(pattern, MultiPattern):
        each = pattern.expand()
        words = sorted({v.keyword for p in each for v in p.vertices})
        known = known or statistics(poi, words, any(e.relation for e in pattern.edges))
        out = reduce(DataFrame.unionByName, [match(poi, p, order, metric, grid, staged=staged, known=known) for p in each]).distinct()
        return out.limit(limit) if limit else out
    ids = [v.id for v in pattern.vertices]
    words = sorted({v.keyword for v in pattern.vertices})
    shaped_at_all = any(e.relation for e in pattern.edges)
    barred = planner.exclusions(pattern)
    # one scan of the places for statistics, all vertices and exclusions: the pattern's keywords with what joins need, held on
    # executors (memory and disk) as long as the answer is
    uses = len(ids) + sum(map(len, barred.values()))
    tiled = "rings" in (poi if staged is None else staged).columns and any(e.relation == "intersects" for e in pattern.edges)
    source = of_keywords(poi, words, shaped_at_all, tiled) if staged is None else staged
    hold = staged is None and held and (known is None or uses > 2 or shaped_at_all)
    if hold:
        source = ematch.dealt(source).persist(StorageLevel.MEMORY_AND_DISK)  # few files may hold all of a keyword
    counts, extent = known or statistics(source if hold else poi, words, shaped_at_all)
    if any(not counts.get(k) for k in words):
        if hold:
            let_go(source)
        return poi.sparkSession.createDataFrame([], T.StructType([T.StructField(v, poi.schema["osm_id"].dataType) for v in ids]))

    def places(v: str) -> DataFrame:
        shaped = any(e.relation for e in pattern.edges_of(v))
        df = ematch.candidates(source, pattern.keyword(v), v, shaped, tiled and any(e.relation == "intersects" for e in pattern.edges_of(v)))
        for word, radius in sorted(barred.get(v, {}).items()):
            df = ematch.exclude(df, v, ematch.candidates(source, word, "_x"), "_x", radius, extent, metric, grid)
        return df.join(able[v], c(v, "osm_id") == F.col("_id"), "left_semi") if able and v in able else df

    whole = lambda e: extent.whole(pattern.keyword(e.vi), pattern.keyword(e.vj))
    vertices = planner.vertex_order(pattern, counts, order) if isinstance(order, str) else list(order)
    solved: list[DataFrame] = []
    hold_too: list[DataFrame] = []
    for part in pattern.components() if grid else []:
        order_of = [v for v in vertices if v in part]
        if not listable(pattern, part, counts, extent):
            continue
        for apart in (planner.listed(pattern, part, counts), planner.listed(pattern, part, counts, True)):
            found_all, held_now = by_lists(pattern, order_of, apart, places, extent, counts, metric) if apart else (None, [])
            if found_all is not None:
                solved.append(found_all)
                hold_too += held_now
                vertices = [v for v in vertices if v not in part]
                break
            for df in held_now:
                let_go(df)
    parts: list[DataFrame] = []  # of each connected part of the pattern, its vertices bound so far; vertices come part by part
    for k, v in enumerate(vertices):
        edges = planner.bound_edges(pattern, v, vertices[:k])
        if not edges:
            parts.append(places(v))
            continue
        acc = parts.pop()
        near = min((e for e in edges if e.upper < math.inf), key=lambda e: (e.upper, e.id), default=None)
        meet = next((e for e in edges if e.relation in MEETING), None)
        lead = near or meet
        rest = [edge_condition(e, metric, extent, whole(e), tiled) for e in edges if e is not lead]
        if near is not None and near.relation:
            rest.append(ematch.relation_condition(near.vi, near.vj, near.relation, whole(near), tiled))
        rest = [r for r in rest if r is not None]
        extra = reduce(lambda a, b: a & b, rest) if rest else None
        if near is not None:
            acc = ematch.distance_join(acc, near.other(v), places(v), v, near.lower, near.upper, extent, extra, metric, grid, counts[pattern.keyword(v)])
        elif meet is not None:
            cond = ematch.relation_condition(meet.vi, meet.vj, meet.relation, whole(meet), tiled)
            cond = cond if extra is None else cond & extra
            if grid and meet.relation == "touches" and whole(meet) == "flat":
                acc = ematch.touch_join(acc, meet.other(v), places(v), v, cond)
            elif grid:
                acc = ematch.box_join(acc, meet.other(v), places(v), v, extent, cond, "any" in map(whole, edges))
            else:
                acc = acc.join(places(v), cond)
        else:
            bounds = [ematch.reachable(e.vi, e.vj, e.lower, e.upper, extent, metric) for e in edges]
            first = [b for b in bounds if b is not None]
            acc = ematch.nested_loop(acc, places(v), reduce(lambda a, b: a & b, [*first, extra]) if extra is not None else None, counts[pattern.keyword(v)])
        # drop what no later edge needs
        later = {u for w in vertices[k + 1 :] for e in pattern.edges_of(w) for u in e.ends}
        parts.append(acc.select(*(f"`{name}`" for name in acc.columns if name.endswith(".osm_id") or name.rsplit(".", 1)[0] in later)))
    found = [x.select(*(c(v, "osm_id").alias(v) for v in ids if f"{v}.osm_id" in x.columns)) for x in solved + parts]
    found = found if extent.unique else [x.distinct() for x in found]
    # what the parts have in common is nothing; their answers, held in blocks, are small beside their product
    out, blocks = ematch.product(found) if len(found) > 1 else (found[0], [])
    out = out.select(*(f"`{v}`" for v in ids))
    hold_too += blocks
    out = out.limit(limit) if limit else out
    for df in [source] * hold + hold_too:  # a later use of the answer only reads the places again
        weakref.finalize(out, let_go, df)
    return out


def edge_matches(poi: DataFrame, e: Edge, pattern: Pattern, extent: Extent | None = None, metric: str = "geodesic", grid: bool = True, known: tuple[dict[str, int], Extent] | None = None) -> DataFrame:
    """The distinct pairs of places that satisfy one edge."""
    one = Pattern(tuple(v for v in pattern.vertices if v.id in e.ends), (e,))
    return match(poi, one, metric=metric, grid=grid, known=known)


def solve_by_edges(poi: DataFrame, pattern: Pattern, alternated: bool = True, metric: str = "geodesic") -> DataFrame:
    """The same assignments edge by edge: the matches of every edge that can't be a mere check, reduced by the places
    still possible, then joined on shared vertices in a greedy order of their numbers. Each edge's matches are computed
    once and held on executors (memory and disk), so neither their count nor the final join runs them again. Of patterns
    that by_lists() can solve, matches are counted and only the places in them held: see edges_by_lists()."""
    parts = pattern.components()
    if all(planner.listed(pattern, part, {}) for part in parts) and all(not e.relation and 0 < e.upper < math.inf for e in pattern.edges):
        out = edges_by_lists(poi, pattern, parts, alternated, metric)
        if out is not None:
            return out
    found: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}
    able: dict[str, DataFrame] = {}
    known = statistics(poi, sorted({v.keyword for v in pattern.vertices}), any(e.relation for e in pattern.edges))
    shaped = [e for e in pattern.edges if e.sign != "-"] + [e for e in pattern.edges if e.sign == "-"]
    for e in shaped:
        m = edge_matches(poi, e, pattern, metric=metric, known=known)
        for v in e.ends:
            if v in able:
                m = m.join(able[v], v, "left_semi")
        found[e.id] = m.persist(StorageLevel.MEMORY_AND_DISK)
        sizes[e.id] = found[e.id].count()
        able |= {v: found[e.id].select(v).distinct() for v in e.ends}
    ids = [v.id for v in pattern.vertices]
    acc = None
    for k in planner.edge_order(pattern, sizes, alternated):
        m = found[k]
        shared = [x for x in m.columns if acc is not None and x in acc.columns]
        acc = m if acc is None else acc.join(m, shared) if shared else acc.crossJoin(m)
    for v in ids:
        if acc is None or v not in acc.columns:
            own = ematch.candidates(poi, pattern.keyword(v), v).select(c(v, "osm_id").alias(v)).distinct()
            acc = own if acc is None else acc.crossJoin(own)
    return acc.select(*ids)  # distinct, since the matches of each edge are, and every vertex's id is kept


def edges_by_lists(poi: DataFrame, pattern: Pattern, parts: list[tuple[str, ...]], alternated: bool, metric: str) -> DataFrame | None:
    """solve_by_edges() without holding or shuffling pairs: of an edge's matches, made of the places that earlier edges leave, a
    row for each place with the number of its matches is held. The places left are joined by lists, vertices in the greedy
    order of the edges. None where lists can't be had."""
    words = sorted({v.keyword for v in pattern.vertices})
    source = ematch.dealt(of_keywords(poi, words, False)).persist(StorageLevel.MEMORY_AND_DISK)
    counts, extent = known = statistics(source, words)
    if not all(listable(pattern, part, counts, extent) for part in parts):
        let_go(source)
        return None
    held = [source]
    sizes: dict[str, int] = {}
    able: dict[str, DataFrame] = {}
    for e in [e for e in pattern.edges if e.sign != "-"] + [e for e in pattern.edges if e.sign == "-"]:
        one = Pattern(tuple(v for v in pattern.vertices if v.id in e.ends), (e,))
        pairs = match(poi, one, metric=metric, staged=source, known=known, able=able)
        both = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col(v).alias("id")) for v in e.ends))).alias("_end")
        ends = pairs.select(both).groupBy(F.col("_end.v").alias("_v"), F.col("_end.id").alias("_id")).agg(F.count("*").alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(ends)
        sizes[e.id] = ends.where(F.col("_v") == e.vi).agg(F.sum("_n")).first()[0] or 0
        able |= {v: ends.where(F.col("_v") == v).select("_id") for v in e.ends}
    order = dict.fromkeys(v for k in planner.edge_order(pattern, sizes, alternated) for v in pattern.edge(k).ends)
    out = match(poi, pattern, tuple(order), metric, staged=source, known=known, able=able)
    for df in held:  # a later use of the answer only reads the places again
        weakref.finalize(out, let_go, df)
    return out


def verify_late(poi: DataFrame, pattern: Pattern, metric: str = "geodesic") -> DataFrame:
    """The same assignments with exact relations checked at the end only: until then an edge asks that boxes meet where its
    relation asks that shapes do, over the same grid."""
    rough = Pattern(pattern.vertices, tuple(replace(e, relation="intersects" if e.relation in MEETING else None) for e in pattern.edges))
    boxes = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))))
    boxed = poi.drop("rings").withColumn("ring", F.when((F.col("xmin") == F.col("xmax")) & (F.col("ymin") == F.col("ymax")), F.slice(boxes, 1, 1)).otherwise(boxes))
    acc = match(boxed, rough, metric=metric)
    used = sorted({v for e in pattern.edges if e.relation for v in e.ends})
    whole = "rings" in poi.columns
    rings = poi.select("osm_id", "ring", *(["rings"] if whole else [])).dropDuplicates(["osm_id"])
    for v in used:
        acc = acc.join(rings.select(F.col("osm_id").alias(v), *(F.col(x).alias(f"{v}.{x}") for x in rings.columns[1:])), v)
    for e in pattern.edges:
        if e.relation:
            pair = [c(v, x) for v in e.ends for x in (("ring", "rings") if whole else ("ring",))]
            acc = acc.where(shapes.either(*pair, e.relation) if whole else topology.related(*pair, e.relation))
    return acc.select(*(v.id for v in pattern.vertices)).distinct()
