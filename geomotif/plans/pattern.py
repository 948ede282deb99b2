"""Spatial patterns: keyword vertices and constrained edges, the logical query of the engine."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from itertools import product

SIGNS = (">", "<", "<>", "-")
RELATIONS = ("contains", "within", "intersects", "disjoint", "equals", "touches", "overlaps", "covers", "coveredby", "crosses")
#: Relations that imply that bounding boxes meet; on edges with these, distance and sign mean nothing.
MEETING = tuple(r for r in RELATIONS if r != "disjoint")


class PatternError(ValueError):
    pass


@dataclass(frozen=True, order=True)
class Vertex:
    id: str
    keyword: str

    def to_dict(self) -> dict:
        return {"id": self.id, "keyword": self.keyword}

    @staticmethod
    def from_dict(d: Mapping) -> Vertex:
        return Vertex(str(d["id"]), d["keyword"])


@dataclass(frozen=True)
class MultiVertex:
    id: str
    keywords: tuple[str, ...]


def _bound(v: object, default: float) -> float:
    """A distance bound; a missing one, null and any spelling of infinity are accepted."""
    if v is None:
        return default
    return float(v)


@dataclass(frozen=True)
class Edge:
    """vi and vj lie lower..upper metres apart, inclusive. Sign ``>``: no place with vj's keyword is within
    ``lower`` of vi's place; ``<``: the reverse; ``<>``: both. A relation other than disjoint replaces both."""

    id: str
    vi: str
    vj: str
    lower: float = 0.0
    upper: float = math.inf
    sign: str = "-"
    relation: str | None = None

    def __post_init__(self) -> None:
        if self.sign not in SIGNS:
            raise PatternError(f"edge {self.id}: unknown sign {self.sign!r}")
        if self.relation is not None and self.relation not in RELATIONS:
            raise PatternError(f"edge {self.id}: unknown relation {self.relation!r}")
        if self.relation in MEETING:
            for name, value in (("lower", 0.0), ("upper", math.inf), ("sign", "-")):
                object.__setattr__(self, name, value)
        if not 0 <= self.lower <= self.upper:
            raise PatternError(f"edge {self.id}: {self.lower} to {self.upper} is no interval of distances")

    @property
    def ends(self) -> tuple[str, str]:
        return self.vi, self.vj

    @property
    def exclusions(self) -> int:
        return {"-": 0, "<>": 2}.get(self.sign, 1)

    def other(self, v: str) -> str:
        return self.vj if v == self.vi else self.vi

    def reversed(self) -> Edge:
        """The same constraint read from the other end."""
        turn = {"contains": "within", "within": "contains", "covers": "coveredby", "coveredby": "covers"}
        return replace(self, vi=self.vj, vj=self.vi, sign={">": "<", "<": ">"}.get(self.sign, self.sign), relation=turn.get(self.relation, self.relation))

    def label(self) -> str:
        """The constraint in words."""
        if self.relation in MEETING:
            return self.relation
        if self.lower and self.upper < math.inf:
            text = f"between {self.lower:g} and {self.upper:g}m"
        elif self.lower:
            text = f"at least {self.lower:g}m"
        elif self.upper < math.inf:
            text = f"at most {self.upper:g}m"
        else:
            text = "any distance"
        text += f", {self.sign}" if self.sign != "-" else ""
        return text + (f", {self.relation}" if self.relation else "")

    def to_dict(self) -> dict:
        return {"id": self.id, "vi": self.vi, "vj": self.vj, "lij": self.lower, "uij": self.upper, "sign": self.sign, "relation": self.relation}

    @staticmethod
    def from_dict(d: Mapping) -> Edge:
        relation = d.get("relation")
        return Edge(
            str(d["id"]), str(d["vi"]), str(d["vj"]), _bound(d.get("lij"), 0.0), _bound(d.get("uij"), math.inf),
            d.get("sign") or "-", None if relation in (None, "None", "") else relation,
        )


@dataclass(frozen=True)
class Pattern:
    vertices: tuple[Vertex, ...]
    edges: tuple[Edge, ...] = field(default=())

    def __post_init__(self) -> None:
        ids = [v.id for v in self.vertices]
        if not ids:
            raise PatternError("a pattern needs a vertex")
        if len(set(ids)) < len(ids) or len({e.id for e in self.edges}) < len(self.edges):
            raise PatternError("ids of vertices and edges must be unique")
        for e in self.edges:
            if e.vi not in ids or e.vj not in ids or e.vi == e.vj:
                raise PatternError(f"edge {e.id} does not join two vertices of the pattern")

    def keyword(self, v: str) -> str:
        return next(x.keyword for x in self.vertices if x.id == v)

    def edge(self, id: str) -> Edge | None:
        return next((e for e in self.edges if e.id == id), None)

    def find_edges(self, a: str, b: str) -> list[Edge]:
        """All edges between two vertices, in either direction."""
        return [e for e in self.edges if {a, b} == set(e.ends)]

    def edges_of(self, v: str) -> list[Edge]:
        return [e for e in self.edges if v in e.ends]

    def neighbours(self, v: str) -> list[str]:
        return sorted({e.other(v) for e in self.edges_of(v)})

    def components(self) -> list[tuple[str, ...]]:
        left, out = [v.id for v in self.vertices], []
        while left:
            got, todo = [], [left[0]]
            while todo:
                v = todo.pop()
                if v not in got:
                    got.append(v)
                    todo += self.neighbours(v)
            out.append(tuple(v for v in left if v in got))
            left = [v for v in left if v not in got]
        return out

    @property
    def connected(self) -> bool:
        return len(self.components()) == 1

    @property
    def exclusions(self) -> int:
        return sum(e.exclusions for e in self.edges)

    def to_dict(self) -> dict:
        return {"vertices": [v.to_dict() for v in self.vertices], "edges": [e.to_dict() for e in self.edges]}

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self.to_dict(), indent=indent)

    def to_map_json(self) -> str:
        """The dialect in which vertices and edges are objects keyed by id."""
        edges = {e.id: {k: v for k, v in e.to_dict().items() if k != "id"} for e in self.edges}
        return json.dumps({"vertices": {v.id: v.keyword for v in self.vertices}, "edges": edges})

    @staticmethod
    def from_dict(d: Mapping) -> Pattern:
        vs, es = d["vertices"], d.get("edges", [])
        if isinstance(vs, Mapping):
            vs = [{"id": k, "keyword": v} for k, v in vs.items()]
        if isinstance(es, Mapping):
            es = [{"id": k, **v} for k, v in es.items()]
        return Pattern(tuple(map(Vertex.from_dict, vs)), tuple(map(Edge.from_dict, es)))

    @staticmethod
    def from_json(text: str) -> Pattern:
        return Pattern.from_dict(json.loads(text))

    def __str__(self) -> str:
        lines = [f"{v.id}: {v.keyword}" for v in self.vertices]
        return "\n".join(lines + [f"{e.vi} -> {e.vj}: {e.label()}" for e in self.edges])


@dataclass(frozen=True)
class MultiPattern:
    """A pattern whose vertices allow several keywords each."""

    vertices: tuple[MultiVertex, ...]
    edges: tuple[Edge, ...] = ()

    def expand(self) -> list[Pattern]:
        """One simple pattern for every choice of keywords."""
        return [
            Pattern(tuple(Vertex(v.id, k) for v, k in zip(self.vertices, choice, strict=True)), self.edges)
            for choice in product(*(dict.fromkeys(v.keywords) for v in self.vertices))
        ]


def read_patterns(lines: Iterable[str]) -> list[Pattern]:
    """Patterns of a file with one JSON object a line, in either dialect."""
    return [Pattern.from_json(x) for x in lines if x.strip()]


def write_patterns(patterns: Iterable[Pattern]) -> str:
    return "".join(p.to_json() + "\n" for p in patterns)
