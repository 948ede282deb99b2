"""Joins of places: by distance, by absence of others nearby, and by relation of geometries.

A distance condition alone would plan as a nested loop. Both sides get grid cells as wide as the condition reaches;
one side enters its 3 x 3 neighbourhood, so each pair meets in exactly one cell and the join is an equi-join on
the cell with the exact condition as a residual. Cells of distances go round the earth, across the antimeridian. Which side is broadcast, and the splitting of crowded cells, is left
to adaptive execution, which knows the sizes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, shapes, topology
from ..plans.pattern import MEETING


@dataclass(frozen=True)
class Extent:
    """What a join must know of the places: how far from the equator, how large, whether all are convex, and whether no two
    rows of a keyword have the same id, so that pairs of rows are pairs of ids."""

    max_abs_lat: float
    max_width: float = 0.0
    max_height: float = 0.0
    odd_shapes: bool = False
    unique: bool = False
    min_abs_lat: float = 0.0
    #: keywords of which some place is no convex ring, is neither a point nor its box, is neither convex nor polygons
    odd: frozenset[str] = frozenset()
    rough: frozenset[str] = frozenset()
    other: frozenset[str] = frozenset()
    #: whether rough was asked for
    kinds: bool = False

    def whole(self, p: str, q: str) -> str:
        """Of places of two keywords: all are points or their boxes, none is odd, only the first or second are and have to do
        with boxes, or any may be."""
        if self.kinds and not {p, q} & self.rough:
            return "flat"
        if not self.odd_shapes or self.odd and not {p, q} & self.odd:
            return "none"
        alone = lambda s, t: s in self.odd and s not in self.other and t not in self.rough
        return "first" if alone(p, q) else "second" if alone(q, p) else "any"


def extent_of(poi: DataFrame) -> Extent:
    odd = F.count("rings") if "rings" in poi.columns else F.lit(0)
    *r, odd = poi.agg(F.max(F.abs("lat")), F.max((F.col("xmax") - F.col("xmin")) / 1e6), F.max((F.col("ymax") - F.col("ymin")) / 1e6), odd).first()
    return Extent(*(float(v or 0.0) for v in r), odd_shapes=odd > 0)


BOX = ("xmin", "ymin", "xmax", "ymax")


def shape_columns(poi: DataFrame, tiled: bool = False) -> dict[str, Column]:
    """What joins by relation need of places' shapes. tiled: also the tiles of polygons."""
    cols = {k: F.col(k) for k in (*BOX, "ring", *(["rings"] if "rings" in poi.columns else []))}
    own = {"flat": topology.flat(F.col("ring"), geo.box()) & (F.col("rings").isNull() if "rings" in poi.columns else F.lit(True))}
    own |= {"sides": shapes.sides(F.col("rings"))} if "rings" in poi.columns else {}
    own |= {"tiles": shapes.tiles(F.col("sides") if "sides" in poi.columns else own["sides"], geo.box())} if tiled and "rings" in poi.columns else {}
    return cols | {k: F.col(k) if k in poi.columns else v for k, v in own.items()}


def candidates(poi: DataFrame, keyword: str, alias: str, geometry: bool = False, tiled: bool = False) -> DataFrame:
    """The places of a vertex: only what joins need, each column behind the alias."""
    cols = {k: F.col(k) for k in ("osm_id", "lon", "lat")} | (shape_columns(poi, tiled) if geometry else {})
    source = poi.where(F.col("keyword") == keyword) if "keyword" in poi.columns else poi.where(F.array_contains("keywords", keyword))
    return source.select(*(v.alias(f"{alias}.{k}") for k, v in cols.items()))


def c(alias: str, name: str) -> Column:
    return F.col(f"`{alias}.{name}`")


def pair_distance(a: str, b: str, metric: str = "geodesic") -> Column:
    return geo.distance(c(a, "lat"), c(a, "lon"), c(b, "lat"), c(b, "lon"), metric)


def distance_condition(a: str, b: str, lower: float, upper: float, metric: str = "geodesic", extent: Extent | None = None) -> Column | None:
    """None where every distance qualifies. With an extent, only pairs that a few multiplications leave open are asked for
    their distance: sin^2(d / 2r) is at most (dy / 2)^2 + cos^2 * (dx / 2)^2 with the greatest cosine, and with the least
    one at least that without the fourth powers of the sine's series. The slack is more than distances as computed are off by."""
    d = pair_distance(a, b, metric)
    if upper == math.inf and lower <= 0:
        return None
    exact = (d.between(lower, upper) if lower > 0 else d <= upper) if upper < math.inf else d >= lower
    if extent is None or metric != "geodesic":
        return exact
    apart = F.abs(c(b, "lon") - c(a, "lon"))
    dy, dx = c(b, "lat") - c(a, "lat"), F.least(apart, 360 - apart)
    narrow, wide = (math.cos(math.radians(min(90.0, v))) ** 2 for v in (extent.max_abs_lat, extent.min_abs_lat))
    y, x, series = dy * dy, dx * dx, math.radians(1) ** 2 / 12
    most = y + x * (wide * (1 + 1e-9))
    least = y * (1 - y * series) + x * (1 - x * series) * (narrow * (1 - 1e-9))
    square = lambda v: math.degrees(math.degrees(4 * math.sin(min(v / (2 * geo.RADIUS), math.pi / 2)) ** 2))
    slack = math.degrees(math.degrees(1e-13))
    inside, outside = [], []
    if upper < math.inf:
        inside.append(most < square(upper) * (1 - 1e-9) - slack)
        outside.append(least > square(upper) * (1 + 1e-9) + slack)
    if lower > 0:
        inside.append(least > square(lower) * (1 + 1e-9) + slack)
        outside.append(most < square(lower) * (1 - 1e-9) - slack)
    return F.when(reduce(lambda p, q: p | q, outside), False).when(reduce(lambda p, q: p & q, inside), True).otherwise(exact)


def reachable(a: str, b: str, lower: float, upper: float, extent: Extent, metric: str = "geodesic") -> Column | None:
    """A condition that every pair lower to upper apart meets, in a few multiplications: what pairs are asked before their
    distance is. None where it would ask nothing. The slack is more than distances as computed are off by."""
    dy, dx = F.abs(c(b, "lat") - c(a, "lat")), F.abs(c(b, "lon") - c(a, "lon"))
    out = []
    if upper < math.inf:
        reach = upper * (1 + 1e-6)
        if metric == "geodesic":
            wide = geo.horizontal_reach(reach + 1, min(90.0, extent.max_abs_lat))
            out.append(dy <= geo.vertical_reach(reach + 1))
            out += [(dx <= wide) | (dx >= 360 - wide)] if wide < 180 else []
        else:
            out.append((dy <= reach) & (dx <= reach))
    if lower > 0:
        if metric == "geodesic":
            # sin^2(d / 2r) is at most (dy / 2)^2 + cos^2 * (dx / 2)^2, in radians, with the greatest cosine
            least = math.degrees(2 * math.sqrt(max(0.0, math.sin(min(lower / (2 * geo.RADIUS), math.pi / 2)) ** 2 * (1 - 1e-9) - 1e-14)))
            wide = math.cos(math.radians(min(90.0, extent.min_abs_lat))) ** 2
        else:
            least, wide = lower * (1 - 1e-9), 1.0
        if least > 0:
            out.append(dy * dy + dx * dx * wide >= least * least * (1 - 1e-9))
    return reduce(lambda x, y: x & y, out) if out else None


#: Rows of so many places at most are sent whole to every task of a nested loop: an id and a position each.
SENT = 500_000


def dealt(df: DataFrame) -> DataFrame:
    """The rows in as many even tasks as a shuffle has, whose size is known before what reads them is planned."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def nested_loop(left: DataFrame, right: DataFrame, condition: Column | None, n: int | None = None) -> DataFrame:
    """Every row of left with every one of the n of right, or those for which the condition holds. Left is dealt out,
    since few files may hold it all."""
    left = dealt(left)
    right = F.broadcast(right) if n is not None and n <= SENT else right
    return left.crossJoin(right) if condition is None else left.join(right, condition)


#: Rows of a block of product().
BLOCK = 256


def product(parts: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Every row of each of parts with every one of the others, and what is held meanwhile. Rows are gathered into even blocks, by
    hash, so that a task that runs again makes the same ones. Blocks are joined and multiplied at the end: one is gone
    through again and again, so what is written repeats within the window of a compressor, whichever side is sent."""
    held = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in parts]
    blocks = []
    for k, df in enumerate(held):
        names = [F.col(f"`{name}`") for name in df.columns]
        n = max(1, math.ceil(df.count() / BLOCK))
        blocks.append(df.groupBy(F.pmod(F.xxhash64(*names), F.lit(n)).alias("_n")).agg(F.collect_list(F.struct(*names)).alias(f"_block{k}")).drop("_n"))
    out = reduce(DataFrame.crossJoin, [dealt(blocks[0]), *blocks[1:]])
    for k, df in enumerate(held):
        rest = [f"`{name}`" for name in out.columns if name != f"_block{k}"]
        out = parted(out).select(*rest, F.explode(f"_block{k}").alias("_row"))
        out = out.select(*rest, *(F.col(f"_row.`{name}`").alias(name) for name in df.columns))
    return out, held


def banded_loop(left: DataFrame, a: str, right: DataFrame, b: str, height: float, condition: Column, n: int | None = None) -> DataFrame:
    """nested_loop() of each band of latitude with those next to it, where no pair of the condition is farther apart than a
    band is high: a row of left enters three bands, one of right its own."""
    if height <= 0:
        return nested_loop(left, right, condition, n)
    left = dealt(left).withColumn("_band", F.explode(geo.around(geo.cell(c(a, "lat"), height))))
    # the rows of a band side by side, as loops read them
    right = right.withColumn("_own", geo.cell(c(b, "lat"), height)).repartition(int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_own")
    right = F.broadcast(right) if n is not None and n <= SENT else right
    return left.join(right, (F.col("_band") == F.col("_own")) & condition).drop("_band", "_own")


def _celled(df: DataFrame, alias: str, gx: float, gy: float, spread: bool, round_: bool) -> DataFrame:
    x, y = geo.cell(c(alias, "lon"), gx), geo.cell(c(alias, "lat"), gy)
    if round_:
        x = geo.wrapped_cell(c(alias, "lon"), gx)
    if not spread:
        return df.withColumns({"_cx": x, "_cy": y})
    near = geo.wrapped_around(x, gx) if round_ else geo.around(x)
    return df.withColumn("_cx", F.explode(near)).withColumn("_cy", F.explode(geo.around(y)))


def grid_join(left: DataFrame, a: str, right: DataFrame, b: str, gx: float, gy: float, condition: Column, how: str = "inner", round_: bool = True) -> DataFrame:
    """left and right where their points a and b are at most one cell apart and the condition holds. round_: whether
    the cells go round the earth, so that the last one of a row is next to the first."""
    x = _celled(left, a, gx, gy, False, round_)
    y = _celled(right, b, gx, gy, True, round_).withColumnsRenamed({"_cx": "_dx", "_cy": "_dy"})
    on = (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy")) & condition
    return x.join(y, on, how).drop("_cx", "_cy", "_dx", "_dy")


def distance_join(left: DataFrame, a: str, right: DataFrame, b: str, lower: float, upper: float, extent: Extent, extra: Column | None = None, metric: str = "geodesic", grid: bool = True, n: int | None = None) -> DataFrame:
    """Pairs of points lower to upper apart, inclusive; ``grid=False`` gives the nested loop, in bands of latitude. n: rows of
    right, if known."""
    cond = distance_condition(a, b, lower, upper, metric, None if grid else extent)
    if extra is not None:
        cond = extra if cond is None else cond & extra
    if not grid and upper < math.inf:
        return banded_loop(left, a, right, b, geo.cell_size(upper + 1 if metric == "geodesic" else upper, extent.max_abs_lat, metric)[1], reachable(a, b, lower, upper, extent, metric) & cond, n)
    if upper == math.inf:
        first = reachable(a, b, lower, upper, extent, metric)
        return nested_loop(left, right, cond if first is None else first & cond, n)
    if upper == 0:
        return left.join(right, geo.same_place(c(a, "lat"), c(a, "lon"), c(b, "lat"), c(b, "lon"), metric) & cond)
    return grid_join(left, a, right, b, *geo.cell_size(upper, extent.max_abs_lat, metric), cond, round_=metric == "geodesic")


def parted(df: DataFrame) -> DataFrame:
    """The same rows, by a step that compiled stages don't reach over: such a stage keeps all that comes of one of its rows."""
    return df.coalesce(1 << 20)


def sent_join(left: DataFrame, a: str, right: DataFrame, b: str, upper: float, extent: Extent, condition: Column, metric: str = "geodesic") -> DataFrame:
    """grid_join() of points at most upper apart that sends right whole to every task and leaves left where it is: left, which may
    carry lists, enters the neighbouring cells, within its task."""
    size, round_ = geo.cell_size(upper, extent.max_abs_lat, metric), metric == "geodesic"
    x = _celled(left, a, *size, True, round_)
    y = _celled(right, b, *size, False, round_).withColumnsRenamed({"_cx": "_dx", "_cy": "_dy"})
    on = (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy")) & condition
    return parted(x.join(F.broadcast(y), on)).drop("_cx", "_cy", "_dx", "_dy")


def exclude(left: DataFrame, a: str, others: DataFrame, b: str, radius: float, extent: Extent, metric: str = "geodesic", grid: bool = True) -> DataFrame:
    """The rows of left with none of the others within radius of them. A place that is itself among the others is at
    distance 0 of one, and so goes."""
    near = pair_distance(a, b, metric) <= radius
    if not grid:
        return left.join(others, near, "left_anti")
    if radius == 0:
        return left.join(others, geo.same_place(c(a, "lat"), c(a, "lon"), c(b, "lat"), c(b, "lon"), metric), "left_anti")
    return grid_join(left, a, others, b, *geo.cell_size(radius, extent.max_abs_lat, metric), near, "left_anti", round_=metric == "geodesic")


def relation_condition(a: str, b: str, relation: str, whole: str = "none", tiled: bool = False) -> Column:
    """tiled: whether polygons have their tiles, which tell most of what they meet. whole: which of the two may be other than one convex ring (see Extent); where any may, those that are go through
    Python. Two that are points or rectangles are told by their boxes."""
    p, q = ({k: c(s, k) for k in BOX} for s in (a, b))
    if whole == "flat":
        return topology.boxes_related(p, q, relation)
    exact = topology.related(c(a, "ring"), c(b, "ring"), relation)
    if whole == "any":
        exact = shapes.either(c(a, "ring"), c(a, "rings"), c(b, "ring"), c(b, "rings"), relation)
    flat = F.when(c(a, "flat") & c(b, "flat"), topology.boxes_related(p, q, relation))
    for one, s, own, box in (("first", a, p, q), ("second", b, q, p)):
        if tiled and whole == one and relation == "intersects":
            told = shapes.meets_by_tiles(c(s, "tiles"), own, box)
            flat = flat.when(c(s, "tiles").isNotNull() & told.isNotNull(), told)
    if whole == "first":
        flat = flat.when(c(a, "sides").isNotNull(), shapes.related_to_box(c(a, "sides"), p, q, relation))
    if whole == "second":
        flat = flat.when(c(b, "sides").isNotNull(), shapes.related_to_box(c(b, "sides"), q, p, shapes.TURNED.get(relation, relation)))
    exact = exact if whole == "any" else flat.otherwise(exact)
    return geo.boxes_meet(p, q) & exact if relation in MEETING else exact


def box_join(left: DataFrame, a: str, right: DataFrame, b: str, extent: Extent, condition: Column, last: bool = False) -> DataFrame:
    """left and right where the boxes of a and b meet and the condition holds. Each row enters the cells that its box meets,
    three by three at most, and a pair meets in the cell of the lower left corner of what its boxes share. last: whether
    the condition is asked after the join."""
    p, q = ({k: c(s, k) for k in BOX} for s in (a, b))
    gx, gy = (max(1, math.ceil(v * 1e6 / 2)) for v in (extent.max_width, extent.max_height))
    at = lambda v, g: F.floor(v / F.lit(float(g))).cast("long")
    spread = lambda df, s, x, y: df.withColumn(x, F.explode(F.sequence(at(s["xmin"], gx), at(s["xmax"], gx)))).withColumn(y, F.explode(F.sequence(at(s["ymin"], gy), at(s["ymax"], gy))))
    once = (F.col("_cx") == at(F.greatest(p["xmin"], q["xmin"]), gx)) & (F.col("_cy") == at(F.greatest(p["ymin"], q["ymin"]), gy))
    on = (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy")) & geo.boxes_meet(p, q) & once
    out = spread(left, p, "_cx", "_cy").join(spread(right, q, "_dx", "_dy"), on if last else on & condition)
    return (out.where(condition) if last else out).drop("_cx", "_cy", "_dx", "_dy")


def touch_join(left: DataFrame, a: str, right: DataFrame, b: str, condition: Column) -> DataFrame:
    """left and right, rectangles or points all, where a and b touch and the condition holds. A side of one then lies on the line
    of the opposite side of the other: an equi-join on where these lie. A pair with several such sides meets at the first."""
    p, q = ({k: c(s, k) for k in BOX} for s in (a, b))
    pairs = (("xmin", "xmax"), ("xmax", "xmin"), ("ymin", "ymax"), ("ymax", "ymin"))
    lines = lambda df, at, x: df.withColumn(x, F.explode(F.array(*(F.struct(F.lit(i).alias("side"), v.alias("at")) for i, v in enumerate(at)))))
    x, y = lines(left, [p[k] for k, _ in pairs], "_p"), lines(right, [q[k] for _, k in pairs], "_q")
    first = F.coalesce(*(F.when(p[k] == q[m], i) for i, (k, m) in enumerate(pairs)))
    on = (F.col("_p.side") == F.col("_q.side")) & (F.col("_p.at") == F.col("_q.at")) & (F.col("_p.side") == first) & condition
    return x.join(y, on).drop("_p", "_q")


def relation_join(left: DataFrame, a: str, right: DataFrame, b: str, relation: str, extent: Extent, extra: Column | None = None, grid: bool = True) -> DataFrame:
    """Pairs in a topological relation, over cells of boxes; disjoint pairs are nearly all pairs and have no grid."""
    whole = "any" if extent.odd_shapes else "none"
    cond = relation_condition(a, b, relation, whole)
    cond = cond if extra is None else cond & extra
    if not grid or relation not in MEETING:
        return left.join(right, cond)
    return box_join(left, a, right, b, extent, cond, whole == "any")
