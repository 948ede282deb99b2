"""Distances, bounding boxes and grid cells as native column expressions, with plain-number twins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371000.0  # metres
METRICS = ("geodesic", "euclidian")


def haversine(lat1, lon1, lat2, lon2, radius: float = RADIUS) -> Column:
    """Great-circle distance in metres of points in degrees."""
    la1, la2 = F.radians(lat1), F.radians(lat2)
    a = 0.5 - F.cos(la2 - la1) / 2 + F.cos(la1) * F.cos(la2) * (1 - F.cos(F.radians(lon2 - lon1))) / 2
    return 2 * radius * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def euclidian(lat1, lon1, lat2, lon2) -> Column:
    """Planar distance in the units of the coordinates."""
    return F.sqrt((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1))


def distance(lat1, lon1, lat2, lon2, metric: str = "geodesic", radius: float = RADIUS) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return euclidian(lat1, lon1, lat2, lon2) if metric == "euclidian" else haversine(lat1, lon1, lat2, lon2, radius)


def metres(lat1: float, lon1: float, lat2: float, lon2: float, radius: float = RADIUS) -> float:
    la1, la2 = math.radians(lat1), math.radians(lat2)
    a = 0.5 - math.cos(la2 - la1) / 2 + math.cos(la1) * math.cos(la2) * (1 - math.cos(math.radians(lon2 - lon1))) / 2
    return 2 * radius * math.asin(math.sqrt(max(0.0, min(1.0, a))))


def vertical_reach(d: float, radius: float = RADIUS) -> float:
    """Degrees of latitude that d metres span."""
    return math.degrees(d / radius)


def horizontal_reach(d: float, lat: float, radius: float = RADIUS) -> float:
    """Degrees of longitude that d metres along a great circle span between points on a parallel."""
    c = math.cos(math.radians(lat))
    s = math.sin(min(d / (2 * radius), math.pi / 2))
    return 180.0 if c <= s else math.degrees(2 * math.asin(s / c))


def vertical_extremes(lat: float, lon: float, d: float) -> tuple[tuple[float, float], tuple[float, float]]:
    r = vertical_reach(d)
    return (lat - r, lon), (lat + r, lon)


def horizontal_extremes(lat: float, lon: float, d: float) -> tuple[tuple[float, float], tuple[float, float]]:
    r = horizontal_reach(d, lat)
    return (lat, lon - r), (lat, lon + r)


def extremes(lat: Column, lon: Column, d: float, radius: float = RADIUS) -> Column:
    """The points d metres south, north, west and east of a place, as a struct of numbers."""
    v = vertical_reach(d, radius)
    cos, sin = F.cos(F.radians(lat)), F.lit(math.sin(min(d / (2 * radius), math.pi / 2)))
    h = F.when(cos <= sin, 180.0).otherwise(F.degrees(2 * F.asin(sin / cos)))
    return F.struct((lat - v).alias("south"), (lat + v).alias("north"), (lon - h).alias("west"), (lon + h).alias("east"))


def radius_bbox(lat: float, lon: float, d: float, metric: str = "geodesic") -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax) of a box that holds every point within d of the centre. Across the antimeridian xmin is less
    than -180 or xmax greater than 180: see longitudes."""
    if metric == "euclidian":
        return lon - d, lat - d, lon + d, lat + d
    dy = vertical_reach(d)
    far = min(90.0, abs(lat) + dy)
    dx = horizontal_reach(d, far)
    return lon - dx, max(-90.0, lat - dy), lon + dx, min(90.0, lat + dy)


def longitudes(xmin: float, xmax: float) -> list[tuple[float, float]]:
    """The ranges of longitudes from -180 to 180 that a range stands for."""
    if xmax - xmin >= 360:
        return [(-180.0, 180.0)]
    if xmin < -180:
        return [(-180.0, xmax), (xmin + 360, 180.0)]
    if xmax > 180:
        return [(xmin, 180.0), (-180.0, xmax - 360)]
    return [(xmin, xmax)]


def same_place(lat1, lon1, lat2, lon2, metric: str = "geodesic") -> Column:
    """Whether two points are one: by their numbers, and on the earth also the two names of the antimeridian and those of
    the poles. Numbers that an equi-join can use."""
    if metric == "euclidian":
        return (lat1 == lat2) & (lon1 == lon2)
    name = lambda lat, lon: F.when(F.abs(lat) >= 90, 0.0).when(lon == -180, 180.0).otherwise(lon)
    return (lat1 == lat2) & (name(lat1, lon1) == name(lat2, lon2))


# ---- boxes; each argument names four columns by prefix ------------------------------------------


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("xmin", "ymin", "xmax", "ymax")}


def point_in_box(x, y, b) -> Column:
    return x.between(b["xmin"], b["xmax"]) & y.between(b["ymin"], b["ymax"])


def boxes_meet(a, b) -> Column:
    """Inclusive: touching boxes meet."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_within(a, b) -> Column:
    """a lies in b."""
    return (a["xmin"] >= b["xmin"]) & (a["xmax"] <= b["xmax"]) & (a["ymin"] >= b["ymin"]) & (a["ymax"] <= b["ymax"])


def boxes_dmin(a, b) -> Column:
    """Least distance of points of two boxes in degrees, 0 if they meet: across a gap in longitude the shortest way
    is at the latitude, of those both boxes reach or else of the facing sides, that is farthest from the equator."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, b["xmin"] - a["xmax"], a["xmin"] - b["xmax"])
    apart = F.greatest(zero, b["ymin"] - a["ymax"], a["ymin"] - b["ymax"])
    lo, hi = F.greatest(a["ymin"], b["ymin"]), F.least(a["ymax"], b["ymax"])
    level = F.when(F.abs(lo) > F.abs(hi), lo).otherwise(hi)
    la = F.when(apart > 0, F.when(b["ymin"] > a["ymax"], a["ymax"]).otherwise(a["ymin"])).otherwise(level)
    lb = F.when(apart > 0, F.when(b["ymin"] > a["ymax"], b["ymin"]).otherwise(b["ymax"])).otherwise(level)
    return haversine(la, zero, lb, dx)


def boxes_dmax(a, b) -> Column:
    """Greatest distance of a corner of one box and a corner of the other."""
    return F.greatest(*(haversine(a[ya], a[xa], b[yb], b[xb]) for xa in ("xmin", "xmax") for ya in ("ymin", "ymax") for xb in ("xmin", "xmax") for yb in ("ymin", "ymax")))


# ---- cells ---------------------------------------------------------------------------------------


def cell_size(reach: float, max_abs_lat: float, metric: str = "geodesic") -> tuple[float, float]:
    """(longitude, latitude) sides of cells such that points within reach lie in the same or adjacent cells."""
    safe = 1 + 1e-6
    if metric == "euclidian":
        return reach * safe, reach * safe
    g = vertical_reach(reach) * safe
    return min(360.0, horizontal_reach(reach, min(89.9, max_abs_lat)) * safe), g


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def around(c: Column) -> Column:
    return F.sequence(c - 1, c + 1)


def columns_round(size: float) -> int:
    """Number of cells of at least a size, in degrees, that go round the earth."""
    return max(1, int(360 / size))


def wrapped_cell(lon: Column, size: float) -> Column:
    """The cell of a longitude among columns_round(size) equal ones that go round the earth."""
    n = columns_round(size)
    return F.pmod(F.floor((lon + 180) / F.lit(360 / n)), F.lit(n)).cast("long")


def wrapped_around(c: Column, size: float) -> Column:
    """The cell and its neighbours, each once."""
    n = columns_round(size)
    if n < 3:
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return F.array(*(F.pmod(c + k, F.lit(n)).cast("long") for k in (-1, 0, 1)))


def quadkey(x: Column, y: Column, bounds: tuple[float, float, float, float], level: int) -> Column:
    """Address of the cell of a point among 4 ** level: a digit a level, 0 to 3 for SW, NW, SE, NE."""
    xmin, ymin, xmax, ymax = bounds
    n = 1 << level

    def part(v: Column, lo: float, hi: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - lo) / ((hi - lo) or 1.0) * n).cast("int")))

    cx, cy = part(x, xmin, xmax), part(y, ymin, ymax)
    digits = [(F.shiftright(cx, level - 1 - k).bitwiseAND(1) * 2 + F.shiftright(cy, level - 1 - k).bitwiseAND(1)).cast("string") for k in range(level)]
    return F.concat(*digits) if digits else F.lit("")


def quadkey_bbox(key: str, bounds: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    xmin, ymin, xmax, ymax = bounds
    for d in key:
        mx, my = (xmin + xmax) / 2, (ymin + ymax) / 2
        xmin, xmax = (mx, xmax) if d in "23" else (xmin, mx)
        ymin, ymax = (my, ymax) if d in "13" else (ymin, my)
    return xmin, ymin, xmax, ymax
