"""Searches for places: by keyword, box, circle, annulus, relation and id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, shapes, topology


def with_keyword(poi: DataFrame, *keywords: str) -> DataFrame:
    """Places that have one of the keywords."""
    return poi.where(F.arrays_overlap("keywords", F.array(*map(F.lit, keywords))))


def by_ids(poi: DataFrame, ids: Sequence[int], limit: int | None = None) -> DataFrame:
    out = poi.where(F.col("osm_id").isin(list(ids)))
    return out.limit(limit) if limit else out


def all_ids(poi: DataFrame) -> DataFrame:
    return poi.select("osm_id").distinct()


def in_bbox(poi: DataFrame, keywords: Sequence[str], bbox: tuple[float, float, float, float]) -> DataFrame:
    """Places with a keyword and their centroid in the box, inclusive."""
    xmin, ymin, xmax, ymax = bbox
    return with_keyword(poi, *keywords).where(F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax))


def within_envelope(poi: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Places whose own box lies in the envelope (degrees)."""
    lo_x, lo_y, hi_x, hi_y = (round(v * 1_000_000) for v in bbox)
    return poi.where((F.col("xmin") >= lo_x) & (F.col("ymin") >= lo_y) & (F.col("xmax") <= hi_x) & (F.col("ymax") <= hi_y))


def surrounding_bbox(poi: DataFrame, margin: float = 0.001) -> DataFrame:
    m = F.lit(margin)
    return poi.agg((F.min("lon") - m).alias("xmin"), (F.min("lat") - m).alias("ymin"), (F.max("lon") + m).alias("xmax"), (F.max("lat") + m).alias("ymax"))


def distance_from(lat: float, lon: float, metric: str = "geodesic") -> Column:
    return geo.distance(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), metric)


def _near(poi: DataFrame, lat: float, lon: float, r: float, metric: str) -> DataFrame:
    """The box around a circle first: it reaches the scan's statistics."""
    xmin, ymin, xmax, ymax = geo.radius_bbox(lat, lon, r, metric)
    eps = 1e-9
    ranges = [(xmin, xmax)] if metric == "euclidian" else geo.longitudes(xmin, xmax)
    lon = reduce(lambda a, b: a | b, (F.col("lon").between(lo - eps, hi + eps) for lo, hi in ranges))
    return poi.where(F.col("lat").between(ymin - eps, ymax + eps) & lon)


def in_circle(poi: DataFrame, keywords: Sequence[str], lat: float, lon: float, r: float, strict: bool = False, metric: str = "geodesic", limit: int | None = None) -> DataFrame:
    """Places within r of a point; strict leaves out the border."""
    d = distance_from(lat, lon, metric)
    out = _near(with_keyword(poi, *keywords), lat, lon, r, metric).where(d < r if strict else d <= r)
    return out.limit(limit) if limit else out


def exists_in_circle(poi: DataFrame, keywords: Sequence[str], lat: float, lon: float, r: float, metric: str = "geodesic") -> DataFrame:
    """One row: found."""
    return in_circle(poi, keywords, lat, lon, r, metric=metric).limit(1).agg((F.count("*") > 0).alias("found"))


def in_annulus(poi: DataFrame, keyword: str, lat: float, lon: float, lower: float, upper: float, apart_from: Column | None = None, order: bool = False, limit: int | None = None) -> DataFrame:
    """Places farther than lower and at most upper away, with ``distance``; apart_from: a ring they must not meet."""
    out = _near(with_keyword(poi, keyword), lat, lon, upper, "geodesic").withColumn("distance", distance_from(lat, lon))
    out = out.where((F.col("distance") > lower) & (F.col("distance") <= upper))
    if apart_from is not None:
        out = out.where(~_related(poi, apart_from, "intersects"))
    if order:
        out = out.orderBy("distance", "osm_id")
    return out.limit(limit) if limit else out


def nearest(poi: DataFrame, keyword: str, lat: float, lon: float, k: int) -> DataFrame:
    return with_keyword(poi, keyword).withColumn("distance", distance_from(lat, lon)).orderBy("distance", "osm_id").limit(k)


def related_to(poi: DataFrame, keyword: str, ring: Column, relation: str) -> DataFrame:
    """Places with a keyword that stand in a relation to a convex ring."""
    return with_keyword(poi, keyword).where(_related(poi, ring, relation))


def _related(poi: DataFrame, ring: Column, relation: str) -> Column:
    if "rings" not in poi.columns:
        return topology.related(F.col("ring"), ring, relation)
    none = F.lit(None).cast("array<array<struct<x:bigint,y:bigint>>>")
    return shapes.either(F.col("ring"), F.col("rings"), ring, none, relation)
