"""Preparation of place tables: layers, tags, sampling, hulls and buffers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import shapes, topology

RING = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))


def union_layers(*layers: DataFrame) -> DataFrame:
    """Distinct rows of several layers of the same columns."""
    return reduce(DataFrame.unionByName, layers).distinct()


def tagged(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows with some tag that is not empty."""
    return df.where(F.coalesce(*(F.nullif(F.col(t), F.lit("")) for t in tags)).isNotNull())


def untagged(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(*(F.nullif(F.col(t), F.lit("")) for t in tags)).isNull())


def normalise_tag(c: Column) -> Column:
    """Anything but letters and underscores becomes a space, ends are trimmed, runs of spaces become an underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, "[^a-zA-Z_]", " ")), " +", "_")


def sample_fraction(df: DataFrame, fraction: float, key: str = "osm_id", seed: int = 0) -> DataFrame:
    """About a fraction of the rows, the same ones for the same seed, and growing with the fraction."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < round(fraction * 1_000_000))


def sample_modulo(df: DataFrame, percent: int, key: str = "osm_id") -> DataFrame:
    """As sample_fraction, by arithmetic that any engine can repeat."""
    return df.where((F.col(key) * 7919) % 100 < percent)


def first_fraction(df: DataFrame, fraction: float, key: str = "osm_id") -> DataFrame:
    """The first rows by key: a fraction of them and one more."""
    return df.orderBy(key).limit(int(fraction * df.count()) + 1)


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("osm_id").agg(F.count("*").alias("n")).where("n > 1")


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) of web-Mercator metres."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.lit(np.pi / 2))


def side_length(ring: Column) -> Column:
    """Perimeter over number of vertices, in micro-degrees; 0 for points."""
    n = F.size(ring)
    step = lambda s, i: s + F.sqrt(
        F.pow(F.get(ring, i)["x"] - F.get(ring, (i + 1) % n)["x"], 2) + F.pow(F.get(ring, i)["y"] - F.get(ring, (i + 1) % n)["y"], 2)
    )
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), step) / n).otherwise(0.0)


def point_buffer_size(df: DataFrame) -> DataFrame:
    """One row: the median of the positive mean side lengths."""
    s = df.select(side_length(F.col("ring")).alias("s")).where("s > 0")
    return s.agg(F.median("s").alias("size"))


def area_sum(df: DataFrame) -> DataFrame:
    return df.agg((F.sum(topology.double_area(F.col("ring"))) / 2e12).alias("area"))


# ---- hulls and buffers: loops over the vertices of one geometry, so in Python, by Arrow batches ----


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without points inside its edges."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A hull without the vertices that lie within tolerance of the chord that replaces them; at least three stay."""
    ring = ring.astype(float)
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    keep = {0, far}
    todo = [(0, far), (far, len(ring))]
    while todo:
        a, b = todo.pop()
        mid = np.arange(a + 1, b)
        if not len(mid):
            continue
        p, d = ring[a], ring[b % len(ring)] - ring[a]
        off = np.abs(d[0] * (ring[mid, 1] - p[1]) - d[1] * (ring[mid, 0] - p[0])) / max(np.hypot(*d), 1e-300)
        k = int(off.argmax())
        if off[k] > tolerance or len(keep) < 3:
            keep.add(int(mid[k]))
            todo += [(a, int(mid[k])), (int(mid[k]), b)]
    return ring[sorted(keep)]


def offset(ring: np.ndarray, d: float) -> np.ndarray:
    """Outline at distance d of a point or a counter-clockwise convex ring; corners are arcs of one chord a quarter."""
    ring = ring.astype(float)
    if len(ring) == 1:
        return ring[0] + d * np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])
    out = []
    n = len(ring)
    side = np.roll(ring, -1, axis=0) - ring
    normal = np.stack([side[:, 1], -side[:, 0]], axis=1) / np.hypot(side[:, 0], side[:, 1])[:, None]
    for i in range(n):
        a, b = normal[i - 1], normal[i]
        turn = np.arctan2(a[0] * b[1] - a[1] * b[0], a @ b) % (2 * np.pi)
        steps = max(1, int(np.ceil(turn / (np.pi / 2) - 1e-9)))
        start = np.arctan2(a[1], a[0])
        out += [ring[i] + d * np.array([np.cos(start + turn * k / steps), np.sin(start + turn * k / steps)]) for k in range(steps + 1)]
    return np.array(out)


def buffered(point_size: float, share: float = 0.1, tolerance: float = 0.05e6):
    """A function of rings: the hull of the default buffer, in whole micro-degrees. Points grow by point_size, others by
    a share of their mean side."""

    @pandas_udf(RING)
    def grow(rings: pd.Series) -> pd.Series:
        def one(r):
            if r is None or not len(r):
                return None
            p = np.array([(v["x"], v["y"]) for v in r])
            h = hull(p)
            if len(h) == 1:
                out = offset(h, point_size)
            else:
                if len(h) > 3:
                    h = simplify(h, tolerance)
                mean = np.hypot(*(np.roll(h, -1, axis=0) - h).T).sum() / len(h)
                out = offset(h, share * mean)
            return [{"x": int(x), "y": int(y)} for x, y in hull(np.rint(out).astype(np.int64))]

        return rings.map(one)

    return grow


@pandas_udf(RING)
def convex_hull(rings: pd.Series) -> pd.Series:
    """The hull of each geometry, which also repairs invalid polygons."""
    return rings.map(lambda r: None if r is None or not len(r) else [{"x": int(x), "y": int(y)} for x, y in hull(np.array([(v["x"], v["y"]) for v in r]))])


def covering_regions(df: DataFrame, regions: DataFrame, cells_a_side: int = 8) -> DataFrame:
    """(osm_id, region, area_rank): the regions that cover each place, the smallest box first. A region enters the cells,
    about its mean size over cells_a_side, that its box meets; a place the one of its box's first corner."""
    size = regions.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0] or 1.0
    side = max(1, int(size / cells_a_side))
    at = lambda v: F.floor(v / side).cast("long")
    whole = ["rings"] if "rings" in regions.columns and "rings" in df.columns else []
    r = regions.select(F.col("name").alias("region"), *(F.col(k).alias(f"r_{k}") for k in ("xmin", "ymin", "xmax", "ymax", "ring", *whole)))
    r = r.withColumn("cx", F.explode(F.sequence(at(F.col("r_xmin")), at(F.col("r_xmax"))))).withColumn("cy", F.explode(F.sequence(at(F.col("r_ymin")), at(F.col("r_ymax")))))
    inside = (F.col("xmin") >= F.col("r_xmin")) & (F.col("xmax") <= F.col("r_xmax")) & (F.col("ymin") >= F.col("r_ymin")) & (F.col("ymax") <= F.col("r_ymax"))
    near = df.withColumns({"px": at(F.col("xmin")), "py": at(F.col("ymin"))}).join(r, (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")) & inside)
    exact = shapes.either(F.col("r_ring"), F.col("r_rings"), F.col("ring"), F.col("rings"), "covers") if whole else topology.covers(F.col("r_ring"), F.col("ring"))
    hit = near.where(exact)
    w = Window.partitionBy("osm_id").orderBy((F.col("r_xmax") - F.col("r_xmin")) * (F.col("r_ymax") - F.col("r_ymin")), "region")
    return hit.select("osm_id", "region", F.row_number().over(w).alias("area_rank"))


def municipality(df: DataFrame, regions: DataFrame) -> DataFrame:
    """The second smallest region that covers each place."""
    return covering_regions(df, regions).where("area_rank = 2").select("osm_id", "region")
