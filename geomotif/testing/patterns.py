"""Seeded random patterns over a fixed set of structures."""

from __future__ import annotations

import random
from collections.abc import Sequence

from ..plans.pattern import Edge, Pattern, Vertex

# The structures of the workload, as pairs of vertices, and its ranges.
STRUCTURES = (
    ((0, 1),),
    ((0, 1),),
    ((0, 1), (1, 2)),
    ((0, 1), (1, 2)),
    ((0, 1), (1, 2), (2, 3)),
    ((0, 1), (1, 2), (1, 3)),
    ((0, 1), (1, 2), (2, 3), (3, 1)),
    ((0, 1), (1, 2), (2, 3), (3, 4)),
    ((0, 1), (1, 2), (2, 3), (3, 4), (4, 0)),
    ((0, 1), (1, 2), (2, 3), (3, 4), (4, 1)),
    ((0, 1), (1, 2), (2, 3), (3, 4), (4, 1), (1, 5)),
    ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (2, 5)),
)
PROBABILITIES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
MAX_LOWER, MIN_WIDTH, MAX_WIDTH = 1000.0, 200.0, 2000.0


def random_pattern(structure: Sequence[tuple[int, int]], keywords: Sequence[str], qualitative: float, rng: random.Random, scale: float = 1.0) -> Pattern:
    """Distinct keywords on the vertices; on each edge random bounds (times scale) and sign, and with the given
    probability a relation."""
    ids = sorted({v for e in structure for v in e})
    words = rng.sample(list(keywords), len(ids))
    edges = []
    for k, (a, b) in enumerate(structure):
        lower = rng.random() * MAX_LOWER * scale
        upper = lower + (MIN_WIDTH + rng.random() * (MAX_WIDTH - MIN_WIDTH)) * scale
        sign = rng.choice(("<", ">", "<>", "-"))
        relation = rng.choice(("contains", "within", "intersects", "disjoint")) if rng.random() < qualitative else None
        edges.append(Edge(str(k), str(a), str(b), lower, upper, sign, relation))
    return Pattern(tuple(Vertex(str(v), w) for v, w in zip(ids, words, strict=True)), tuple(edges))


def workload(keywords: Sequence[str], repetitions: int = 2, seed: int = 0) -> list[Pattern]:
    rng = random.Random(seed)
    return [random_pattern(s, keywords, p, rng) for _ in range(repetitions) for s in STRUCTURES for p in PROBABILITIES]
