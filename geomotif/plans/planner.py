"""Join orders for patterns. They change the cost of a query, never its result; ties go to the smaller id."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import combinations

from .pattern import Edge, Pattern

ORDERS = ("count", "alternated", "min")


def edge_order(pattern: Pattern, matches: Mapping[str, int], alternated: bool = False) -> list[str]:
    """Edges by connected greedy choice: from the edge with fewest matches on, at the current vertex the unused edge
    with fewest (when alternated: most and fewest in turn), and where there is none any unused one that touches what
    has been visited. Edges of further components follow in the same way."""
    left = {e.id: e for e in pattern.edges}
    out: list[str] = []
    seen: set[str] = set()
    at, most = None, True
    cost = lambda e: (matches.get(e.id, 0), e.id)
    while left:
        here = [e for e in left.values() if at in e.ends]
        if here:
            e = max(here, key=lambda e: (matches.get(e.id, 0), _neg(e.id))) if alternated and most else min(here, key=cost)
            most = not most
            at = e.other(at)
        else:
            touching = [e for e in left.values() if seen & set(e.ends)]
            e = min(touching or left.values(), key=cost)
            at, most = (e.vj, True) if not touching else (next((v for v in e.ends if v not in seen), e.vj), True)
        seen |= set(e.ends)
        out.append(e.id)
        del left[e.id]
    return out


def _neg(text: str) -> tuple:
    return tuple(-ord(c) for c in text)


def count_order(pattern: Pattern, matches: Mapping[str, int]) -> list[str]:
    """Edges by ascending number of matches, connected or not."""
    return [e.id for e in sorted(pattern.edges, key=lambda e: (matches.get(e.id, 0), e.id))]


def vertex_order(pattern: Pattern, frequency: Mapping[str, int], order: str = "count") -> list[str]:
    """Vertices in joining order. ``count``: the rarest first, then always the rarest that touches a bound vertex;
    ``min`` and ``alternated``: a walk to the rarest (alternately the most frequent) unbound neighbour."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    rank = lambda v: (frequency.get(pattern.keyword(v), 0), v)
    out: list[str] = []
    for part in sorted(pattern.components(), key=lambda c: min(map(rank, c))):
        now, most = min(part, key=rank), True
        out.append(now)
        while rest := [v for v in part if v not in out]:
            bound = [v for v in part if v in out]
            near = [v for v in rest if order == "count" and any(b in pattern.neighbours(v) for b in bound) or v in pattern.neighbours(now)]
            if not near:  # a dead end: go on from what is bound
                near = [v for v in rest if any(b in pattern.neighbours(v) for b in bound)]
            now = max(near, key=rank) if order == "alternated" and most else min(near, key=rank)
            most = not most
            out.append(now)
    return out


def bound_edges(pattern: Pattern, v: str, before: list[str]) -> list[Edge]:
    """The edges that become checkable when v joins the vertices before it."""
    return [e for e in pattern.edges_of(v) if e.other(v) in before]


def listed(pattern: Pattern, part: tuple[str, ...], frequency: Mapping[str, int], leaves_only: bool = False) -> set[str]:
    """Vertices of a connected part whose places are listed for what is bound, and multiplied at the end: no two of them are
    neighbours. They have one neighbour, or two that are none of each other; most such vertices, then most leaves, then
    the longest lists are best."""
    near = {v: pattern.neighbours(v) for v in part}
    able = [v for v in part if len(near[v]) == 1 or not leaves_only and len(near[v]) == 2 and near[v][0] not in near[near[v][1]]]
    able = able if len(able) <= 12 else [v for v in able if len(near[v]) == 1]

    def worth(s: tuple[str, ...]) -> tuple:
        long = sum(math.log(max(1, frequency.get(pattern.keyword(v), 0)) * min(e.upper for e in pattern.edges_of(v)) ** 2) for v in s)
        return len(s), sum(len(near[v]) == 1 for v in s), long, s

    if len(part) < 3:
        return set()
    if len(able) > 12:  # of more than two vertices, no two leaves are neighbours
        return set(able)
    sets = (s for k in range(len(able) + 1) for s in combinations(able, k) if not any(b in near[a] for a, b in combinations(s, 2)))
    return set(max(sets, key=worth))


def skip_edges(pattern: Pattern, order: list[str]) -> list[str]:
    """Edges of an edge order whose ends earlier edges have connected already, without an exclusion: these need no
    join of their own and are checked on solutions."""
    group = {v.id: v.id for v in pattern.vertices}
    out = []
    for id in order:
        e = pattern.edge(id)
        a, b = group[e.vi], group[e.vj]
        if a == b and e.sign == "-":
            out.append(id)
        group = {v: a if g == b else g for v, g in group.items()}
    return out


def exclusions(pattern: Pattern) -> dict[str, dict[str, float]]:
    """By vertex: other keyword -> greatest distance within which none of it may be. Exclusion concerns one vertex."""
    out: dict[str, dict[str, float]] = {}
    for e in pattern.edges:
        for v, w, signs in ((e.vi, e.vj, (">", "<>")), (e.vj, e.vi, ("<", "<>"))):
            if e.sign in signs:
                own = out.setdefault(v, {})
                k = pattern.keyword(w)
                own[k] = max(own.get(k, 0.0), e.lower)
    return out
