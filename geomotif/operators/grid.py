"""Quadtree-like views of places: cells, their boxes and counts, and cells that may hold a match."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

Bounds = tuple[float, float, float, float]


def with_quadkey(poi: DataFrame, bounds: Bounds, level: int) -> DataFrame:
    return poi.withColumn("quadkey", geo.quadkey(F.col("lon"), F.col("lat"), bounds, level))


def cell_stats(poi: DataFrame, bounds: Bounds, level: int) -> DataFrame:
    """Places and the box of their centroids in every cell that has any."""
    return with_quadkey(poi, bounds, level).groupBy("quadkey").agg(
        F.count("*").alias("n"), F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax")
    )


def nodes(poi: DataFrame, bounds: Bounds, depth: int) -> DataFrame:
    """Every non-empty node down to a depth: level, address and number of places."""
    keyed = with_quadkey(poi, bounds, depth).select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "quadkey")
    return keyed.select("level", F.expr("substring(quadkey, 1, level)").alias("quadkey")).groupBy("level", "quadkey").agg(F.count("*").alias("n"))


def leaves(poi: DataFrame, bounds: Bounds, depth: int, max_items: int) -> DataFrame:
    """The nodes where a quadtree that splits above max_items would stop."""
    n = nodes(poi, bounds, depth)
    parents = n.select((F.col("level") + 1).alias("level"), F.col("quadkey").alias("up"), F.col("n").alias("over"))
    own = n.withColumn("up", F.expr("substring(quadkey, 1, greatest(level - 1, 0))")).join(parents, ["level", "up"], "left")
    split_above = (F.col("level") == 0) | (F.col("over") > max_items)
    return own.where(split_above & ((F.col("n") <= max_items) | (F.col("level") == depth))).select("level", "quadkey", "n")


def in_subtree(poi: DataFrame, bounds: Bounds, prefix: str) -> DataFrame:
    """Places in a node."""
    return poi.where(geo.quadkey(F.col("lon"), F.col("lat"), bounds, len(prefix)) == prefix)


def quadkeys_in_bbox(bbox: Bounds, bounds: Bounds, level: int) -> list[str]:
    """Addresses of the cells of a level that meet a box, for pruning by prefix."""
    keys = [""]
    for _ in range(level):
        keys = [k + d for k in keys for d in "0123"]
        keys = [k for k in keys if _meet(geo.quadkey_bbox(k, bounds), bbox)]
    return keys


def _meet(a: Bounds, b: Bounds) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def centre_and_half_diagonal(bbox: Bounds) -> tuple[float, float, float]:
    """(lon, lat) of a box's centre, and the degrees from there to a corner."""
    return (bbox[0] + bbox[2]) / 2, (bbox[1] + bbox[3]) / 2, math.hypot(bbox[2] - bbox[0], bbox[3] - bbox[1]) / 2


def matching_cells(a: DataFrame, b: DataFrame, lower: float, upper: float) -> DataFrame:
    """Pairs of cells (tables of cell_stats) whose boxes allow a pair of places lower to upper metres apart. The level
    bounds the tables at 4 ** level rows, whatever the number of places, so all their pairs are looked at."""
    p = {k: F.col(f"a.{k}") for k in ("xmin", "ymin", "xmax", "ymax")}
    q = {k: F.col(f"b.{k}") for k in ("xmin", "ymin", "xmax", "ymax")}
    cond = (geo.boxes_dmin(p, q) <= (upper if upper < math.inf else 4e7)) & (geo.boxes_dmax(p, q) >= lower)
    return a.alias("a").join(b.alias("b"), cond).select(F.col("a.quadkey").alias("a"), F.col("b.quadkey").alias("b"))
