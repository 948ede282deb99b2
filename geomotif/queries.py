"""The engine's registered queries over derived places, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, topology
from .operators import ematch, grid, prep, report, search
from .operators.match import edge_matches, match, solve_by_edges, statistics, verify_late
from .plans import sqlgen
from .plans.pattern import Edge, MultiPattern, MultiVertex, Pattern, Vertex
from .sources import poi as P
from .sources.scratch import folder
from .testing.derived import BOUNDS, layer_sql, LAYERS, layers, places, places_cte

INF = math.inf
LAT, LON = 51.51, -0.118
BBOX = (-0.16, 51.48, -0.09, 51.53)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, cte: bool = True):
    """Registers a function under its name; sql may use the table pois."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {places_cte()}\n{sql}" if cte else sql
        return f

    return add


# ---- scans and keywords --------------------------------------------------------------------------

COLS = "osm_id, name, amenity, shop, tourism, landuse, leisure, building, xmin, ymin, xmax, ymax"
CATEGORY = " || ".join(f"CASE WHEN {t} IS NOT NULL THEN '{t},' ELSE '' END" for t in P.TAGS)


@query(f"SELECT {COLS}, lon, lat FROM pois")
def poi_scan(spark, d):
    return places(spark, d).select(*COLS.split(", "), "lon", "lat")


@query(f"SELECT osm_id, array_to_string(list_sort(keywords), ',') AS keywords, {CATEGORY} AS category, coalesce(name, '') || ' (' || array_to_string(list_sort(keywords), ',') || ')' AS description FROM pois")
def poi_keywords(spark, d):
    return places(spark, d).select("osm_id", F.array_join(F.array_sort("keywords"), ",").alias("keywords"), P.category_of(P.TAGS).alias("category"), P.description().alias("description"))


@query("SELECT unnest(keywords) AS keyword, osm_id, lon, lat FROM pois")
def inverted_index(spark, d):
    return P.by_keyword(places(spark, d)).select("keyword", "osm_id", "lon", "lat")


@query("SELECT osm_id FROM pois WHERE array_contains(keywords, 'BUILDING')")
def keyword_filter(spark, d):
    return search.with_keyword(places(spark, d), "BUILDING").select("osm_id")


@query("SELECT osm_id FROM pois WHERE shop = 'PROMO' OR building = 'PROMO'")
def keyword_any_tag(spark, d):
    return places(spark, d).where(P.keyword_condition(("shop", "building"), "PROMO")).select("osm_id")


@query("SELECT osm_id FROM pois WHERE amenity IS NULL AND shop IS NULL AND tourism IS NULL AND landuse IS NULL AND leisure IS NULL AND building IS NULL")
def no_keyword(spark, d):
    return prep.untagged(places(spark, d), P.TAGS).select("osm_id")


@query("SELECT osm_id FROM pois WHERE osm_id IN (1000005, 2000017, 3000001)")
def lookup_by_id(spark, d):
    return search.by_ids(places(spark, d), [1000005, 2000017, 3000001]).select("osm_id")


@query("SELECT DISTINCT osm_id FROM pois")
def all_ids(spark, d):
    return search.all_ids(places(spark, d))


@query("SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM pois) GROUP BY keyword")
def keyword_frequency(spark, d):
    return report.keyword_frequency(places(spark, d))


@query("SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM pois) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 30")
def top_keywords(spark, d):
    return report.top_keywords(places(spark, d), 30)


UNPIVOT = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, {t} AS keyword FROM pois" for t in P.TAGS) + ") WHERE keyword IS NOT NULL"


@query(f"SELECT DISTINCT keyword FROM (SELECT tag, keyword, count(*) AS n FROM ({UNPIVOT}) GROUP BY tag, keyword) WHERE n > 30")
def frequent_keywords(spark, d):
    return report.frequent_keywords(places(spark, d), P.TAGS, 30)


@query(f"SELECT keyword, sum(n)::BIGINT AS n FROM (SELECT tag, keyword, count(*) AS n FROM ({UNPIVOT}) GROUP BY tag, keyword QUALIFY row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, keyword) <= 5) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 5")
def keyword_types(spark, d):
    return report.keyword_types(places(spark, d), P.TAGS, 5)


# ---- boxes and circles ---------------------------------------------------------------------------


@query(f"SELECT osm_id FROM pois WHERE list_has_any(keywords, ['BUILDING', 'PROMO']) AND lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]}")
def bbox_search(spark, d):
    return search.in_bbox(places(spark, d), ["BUILDING", "PROMO"], BBOX).select("osm_id")


@query("SELECT osm_id FROM pois WHERE xmin >= -160000 AND ymin >= 51480000 AND xmax <= -90000 AND ymax <= 51530000")
def envelope_filter(spark, d):
    return search.within_envelope(places(spark, d), BBOX).select("osm_id")


@query("SELECT round(min(lon) - 0.001, 6) AS xmin, round(min(lat) - 0.001, 6) AS ymin, round(max(lon) + 0.001, 6) AS xmax, round(max(lat) + 0.001, 6) AS ymax FROM pois")
def surrounding_bbox(spark, d):
    return search.surrounding_bbox(places(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


HERE = f"(SELECT {LAT}::DOUBLE AS lat, {LON}::DOUBLE AS lon) here"
AWAY = sqlgen.distance("here", "pois")


@query(f"SELECT osm_id FROM pois, {HERE} WHERE array_contains(keywords, 'BUILDING') AND {AWAY} <= 1500")
def circle_search(spark, d):
    return search.in_circle(places(spark, d), ["BUILDING"], LAT, LON, 1500.0).select("osm_id")


@query(f"SELECT count(*) > 0 AS found FROM pois, {HERE} WHERE array_contains(keywords, 'signup') AND {AWAY} <= 900")
def circle_exists(spark, d):
    return search.exists_in_circle(places(spark, d), ["signup"], LAT, LON, 900.0)


@query(f"SELECT osm_id, round({AWAY}, 3) AS distance FROM pois, {HERE} WHERE array_contains(keywords, 'PROMO') AND {AWAY} > 400 AND {AWAY} <= 2500")
def annulus_search(spark, d):
    return search.in_annulus(places(spark, d), "PROMO", LAT, LON, 400.0, 2500.0).select("osm_id", F.round("distance", 3).alias("distance"))


@query(f"SELECT osm_id, round({AWAY}, 3) AS distance FROM pois, {HERE} WHERE array_contains(keywords, 'depot') ORDER BY {AWAY}, osm_id LIMIT 7")
def nearest_k(spark, d):
    return search.nearest(places(spark, d), "depot", LAT, LON, 7).select("osm_id", F.round("distance", 3).alias("distance"))


@query("SELECT osm_id FROM pois WHERE array_contains(keywords, 'BUILDING') AND xmin <= -100000 AND xmax >= -140000 AND ymin <= 51520000 AND ymax >= 51490000")
def relation_search(spark, d):
    ring = F.array(*(F.struct(F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y")) for x, y in ((-140000, 51490000), (-100000, 51490000), (-100000, 51520000), (-140000, 51520000))))
    return search.related_to(places(spark, d), "BUILDING", ring, "intersects").select("osm_id")


# ---- pairs -----------------------------------------------------------------------------------------


def edge(lower=0.0, upper=INF, sign="-", relation=None, a="BUILDING", b="PROMO") -> Pattern:
    return Pattern((Vertex("a", a), Vertex("b", b)), (Edge("0", "a", "b", lower, upper, sign, relation),))


def pattern_query(name: str, p: Pattern, run: Callable | None = None, strategy: str = "implicit", frequency: dict | None = None) -> None:
    def f(spark, d):
        return run(places(spark, d), p) if run else match(places(spark, d), p)

    f.__name__ = name
    QUERIES[name] = f
    ORACLES[name] = sqlgen.pattern_sql(p, strategy=strategy, frequency=frequency, ctes=[places_cte()])


pattern_query("ematch_inclusive", edge(100.0, 600.0))
pattern_query("ematch_naive", edge(100.0, 600.0), lambda t, p: match(t, p, grid=False))
pattern_query("ematch_lower_only", edge(12000.0, INF, a="depot"))
pattern_query("ematch_excl_right", edge(150.0, 600.0, ">"))
pattern_query("ematch_excl_left", edge(150.0, 600.0, "<"))
pattern_query("ematch_excl_mutual", edge(150.0, 600.0, "<>"))
pattern_query("excl_self_hit", edge(100.0, 900.0, ">", a="Brand#4"))
pattern_query("excl_zero", edge(0.0, 500.0, ">", a="Brand#4"))
for _r, _a, _b in (
    ("intersects", "BUILDING", "depot"), ("contains", "depot", "BUILDING"), ("within", "signup", "depot"), ("equals", "depot", "depot"),
    ("touches", "5-LOW", "depot"), ("overlaps", "BUILDING", "depot"), ("covers", "depot", "PROMO"), ("coveredby", "PROMO", "depot"), ("crosses", "signup", "depot"),
):
    pattern_query(f"topo_{_r}", edge(relation=_r, a=_a, b=_b))
pattern_query("topo_disjoint", edge(0.0, 500.0, relation="disjoint", a="BUILDING", b="depot"))


@query("SELECT a.osm_id AS a, b.osm_id AS b FROM pois a, pois b WHERE array_contains(a.keywords, 'BUILDING') AND array_contains(b.keywords, 'PROMO') AND sqrt((b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * (b.lon - a.lon)) <= 0.004")
def ematch_euclid(spark, d):
    return match(places(spark, d), edge(0.0, 0.004), metric="euclidian")


def near_pairs(spark, d, a="BUILDING", b="depot") -> DataFrame:
    """Pairs whose centroids are within 800 m, with the columns of both behind a. and b."""
    t = places(spark, d)
    return ematch.distance_join(ematch.candidates(t, a, "a", True), "a", ematch.candidates(t, b, "b", True), "b", 0.0, 800.0, ematch.extent_of(t))


NEAR = f"FROM pois a, pois b WHERE array_contains(a.keywords, 'BUILDING') AND array_contains(b.keywords, 'depot') AND {sqlgen.distance('a', 'b')} <= 800"
LABEL = "CASE " + " ".join(f"WHEN {sqlgen.relation('a', 'b', r)} THEN '{r}'" for r in ("contains", "within", "intersects")) + " ELSE 'disjoint' END"


@query(f"SELECT a.osm_id AS a, b.osm_id AS b, {LABEL} AS relation {NEAR}")
def relation_label(spark, d):
    a, b = ematch.c("a", "ring"), ematch.c("b", "ring")
    return near_pairs(spark, d).select(ematch.c("a", "osm_id").alias("a"), ematch.c("b", "osm_id").alias("b"), topology.relation_label(a, b).alias("relation"))


ALL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sqlgen.relation('a', 'b', r)} THEN '{r}' END" for r in topology.MASKS) + "], lambda t: t IS NOT NULL), ',')"


@query(f"SELECT a.osm_id AS a, b.osm_id AS b, {ALL} AS relations {NEAR}")
def relation_all(spark, d):
    a, b = ematch.c("a", "ring"), ematch.c("b", "ring")
    return near_pairs(spark, d).select(ematch.c("a", "osm_id").alias("a"), ematch.c("b", "osm_id").alias("b"), F.array_join(topology.all_relations(a, b), ",").alias("relations"))


DE9IM = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sqlgen.relation('a', 'b', r)} THEN '{r}' END" for r in topology.MASKS if r not in ("crosses", "overlaps")) + "], lambda t: t IS NOT NULL), ',')"


@query(f"SELECT a.osm_id AS a, b.osm_id AS b, {DE9IM} AS relations {NEAR}")
def de9im_match(spark, d):
    m = topology.relate(ematch.c("a", "ring"), ematch.c("b", "ring"))
    names = [F.when(topology.satisfies(F.col("m"), r), F.lit(r)) for r in topology.MASKS if r not in ("crosses", "overlaps")]
    return near_pairs(spark, d).select(ematch.c("a", "osm_id").alias("a"), ematch.c("b", "osm_id").alias("b"), m.alias("m")).select("a", "b", F.array_join(F.array_compact(F.array(*names)), ",").alias("relations"))


# ---- patterns --------------------------------------------------------------------------------------


def pattern(words: dict[str, str], *edges: tuple) -> Pattern:
    return Pattern(tuple(Vertex(k, w) for k, w in words.items()), tuple(Edge(str(i), *e) for i, e in enumerate(edges)))


FLAGSHIP = pattern({"a": "BUILDING", "b": "PROMO", "c": "signup"}, ("a", "b", 100.0, 1500.0, ">"), ("b", "c", 0.0, 1500.0))
PATH3 = pattern({"a": "BUILDING", "b": "PROMO", "c": "signup"}, ("a", "b", 100.0, 600.0, ">"), ("b", "c", 0.0, 800.0))
PATH4 = pattern({"a": "AUTOMOBILE", "b": "ECONOMY", "c": "click", "d": "depot"}, ("a", "b", 50.0, 400.0), ("b", "c", 0.0, 500.0, "<"), ("c", "d", 0.0, 900.0))
STAR = pattern({"a": "HOUSEHOLD", "b": "SMALL", "c": "view", "d": "depot"}, ("b", "a", 0.0, 400.0), ("b", "c", 100.0, 600.0, "<>"), ("b", "d", 0.0, 1200.0))
TRIANGLE = pattern({"a": "MACHINERY", "b": "LARGE", "c": "purchase", "d": "error"}, ("a", "b", 0.0, 500.0), ("b", "c", 0.0, 600.0), ("c", "d", 0.0, 500.0), ("d", "b", 100.0, 700.0))
CYCLE5 = pattern({"a": "BUILDING", "b": "STANDARD", "c": "signup", "d": "Brand#2", "e": "error"}, ("a", "b", 0.0, 500.0), ("b", "c", 0.0, 500.0), ("c", "d", 0.0, 700.0), ("d", "e", 0.0, 600.0), ("e", "a", 0.0, 900.0))
MIXED = pattern({"a": "depot", "b": "BUILDING", "c": "PROMO"}, ("a", "b", 0.0, INF, "-", "contains"), ("b", "c", 100.0, 900.0, ">", "disjoint"))
SAME = pattern({"a": "PROMO", "b": "PROMO", "c": "depot"}, ("a", "b", 50.0, 300.0), ("b", "c", 0.0, 500.0))
MISSING = pattern({"a": "BUILDING", "b": "no such keyword"}, ("a", "b", 0.0, 500.0))
APART = pattern({"a": "depot", "b": "Brand#4", "c": "PROMO", "d": "depot"}, ("a", "b", 0.0, 150.0), ("c", "d", 0.0, 120.0))
PARALLEL = pattern({"a": "BUILDING", "b": "PROMO"}, ("a", "b", 100.0, 900.0), ("b", "a", 200.0, 700.0, "<"))
for _n, _p in {
    "pattern_edge": edge(100.0, 600.0, "<>"), "pattern_path3": PATH3, "pattern_path4": PATH4, "pattern_star": STAR, "pattern_triangle_tail": TRIANGLE,
    "pattern_cycle5": CYCLE5, "pattern_mixed": MIXED, "pattern_same_keyword": SAME, "pattern_missing_keyword": MISSING,
    "pattern_disconnected": APART, "pattern_parallel_edges": PARALLEL,
}.items():
    pattern_query(_n, _p)
pattern_query("pattern_order_alternated", PATH4, lambda t, p: match(t, p, order="alternated"))
pattern_query("pattern_order_min", STAR, lambda t, p: match(t, p, order="min"))
pattern_query("pattern_by_edges", PATH3, lambda t, p: solve_by_edges(t, p))
pattern_query("pattern_by_edges_min", TRIANGLE, lambda t, p: solve_by_edges(t, p, alternated=False))
pattern_query("pattern_verify_late", MIXED, verify_late)
pattern_query("edge_match", PATH3, lambda t, p: edge_matches(t, p.edges[0], p))
ORACLES["edge_match"] = sqlgen.pattern_sql(Pattern(PATH3.vertices[:2], PATH3.edges[:1]), ctes=[places_cte()])

MULTI = MultiPattern((MultiVertex("a", ("BUILDING", "AUTOMOBILE")), MultiVertex("b", ("PROMO", "SMALL"))), (Edge("0", "a", "b", 50.0, 250.0, ">"),))
_parts = [sqlgen.pattern_sql(p, ctes=[places_cte()]) for p in MULTI.expand()]


@query(" UNION ".join(f"(SELECT * FROM ({p}))" for p in _parts), cte=False)
def pattern_multi_keyword(spark, d):
    return match(places(spark, d), MULTI)


def by_text(p: Pattern, strategy: str) -> Callable:
    def run(spark, d):
        t = places(spark, d)
        t.createOrReplaceTempView("geomotif_pois")
        counts, extent = statistics(t, [v.keyword for v in p.vertices])
        return spark.sql(sqlgen.spark_sql(p, "geomotif_pois", strategy, counts, extent.max_abs_lat, int(spark.conf.get("spark.sql.shuffle.partitions")), extent.min_abs_lat, extent.unique))

    return run


for _s in ("implicit", "explicit"):
    QUERIES[f"pattern_sql_{_s}"] = by_text(PATH3, _s)
    ORACLES[f"pattern_sql_{_s}"] = sqlgen.pattern_sql(PATH3, strategy=_s, ctes=[places_cte()])


def _told(v: str) -> str:
    return f"{v}.lon AS lon_{v}, {v}.lat AS lat_{v}, coalesce({v}.name, '') || ' (' || array_to_string(list_sort({v}.keywords), ',') || ')' AS about_{v}"


_FOUND = f"(SELECT * FROM ({sqlgen.pattern_sql(PATH3, ctes=[places_cte()])}))"


@query(f"SELECT f.a, f.b, f.c, {_told('pa')}, {_told('pb')}, {_told('pc')} FROM {_FOUND} f JOIN pois pa ON pa.osm_id = f.a JOIN pois pb ON pb.osm_id = f.b JOIN pois pc ON pc.osm_id = f.c")
def solutions_json(spark, d):
    """Solutions with what is known of their places, read back from the JSON."""
    t = places(spark, d)
    one = "struct<id:bigint,location:struct<lon:double,lat:double>,description:string>"
    s = report.solutions_json(match(t, PATH3), t).select(F.from_json("solution", f"a {one}, b {one}, c {one}").alias("s"))
    told = [F.col(f"s.{v}.{x}").alias(f"{n}_p{v}") for v in "abc" for n, x in (("lon", "location.lon"), ("lat", "location.lat"), ("about", "description"))]
    return s.select(*(F.col(f"s.{v}.id").alias(v) for v in "abc"), *told)


@query(
    f"SELECT '{{\"a\":' || a || ',\"b\":' || b || ',\"c\":' || c || '}}' AS solution FROM (SELECT * FROM ({sqlgen.pattern_sql(PATH3, ctes=[places_cte()])}))", cte=False
)
def solutions_json_ids(spark, d):
    return report.solutions_json(match(places(spark, d), PATH3))


# ---- cells -----------------------------------------------------------------------------------------


def key_sql(level: int) -> str:
    n = 1 << level
    cx = f"greatest(0, least({n - 1}, floor((lon - ({BOUNDS[0]!r})) / {BOUNDS[2] - BOUNDS[0]!r} * {n})::INT))"
    cy = f"greatest(0, least({n - 1}, floor((lat - ({BOUNDS[1]!r})) / {BOUNDS[3] - BOUNDS[1]!r} * {n})::INT))"
    return " || ".join(f"((({cx} >> {level - 1 - k}) & 1) * 2 + (({cy} >> {level - 1 - k}) & 1))::VARCHAR" for k in range(level))


@query(f"SELECT {key_sql(4)} AS quadkey, count(*) AS n, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM pois GROUP BY 1")
def cell_stats(spark, d):
    return grid.cell_stats(places(spark, d), BOUNDS, 4)


@query(f"SELECT level, substr(k, 1, level) AS quadkey, count(*) AS n FROM (SELECT {key_sql(4)} AS k, unnest(range(0, 5))::INT AS level FROM pois) GROUP BY 1, 2")
def quadkey_level(spark, d):
    return grid.nodes(places(spark, d), BOUNDS, 4)


@query(
    f"""SELECT level, quadkey, n FROM (SELECT *, substr(quadkey, 1, greatest(level - 1, 0)) AS up FROM nodes) c
    WHERE (level = 0 OR (SELECT p.n FROM nodes p WHERE p.level = c.level - 1 AND p.quadkey = c.up) > 100) AND (n <= 100 OR level = 4)""".replace(
        "nodes", f"(SELECT level, substr(k, 1, level) AS quadkey, count(*) AS n FROM (SELECT {key_sql(4)} AS k, unnest(range(0, 5))::INT AS level FROM pois) GROUP BY 1, 2)"
    )
)
def quadtree_leaves(spark, d):
    return grid.leaves(places(spark, d), BOUNDS, 4, 100)


@query(f"SELECT osm_id FROM pois WHERE starts_with({key_sql(2)}, '12')")
def subtree(spark, d):
    return grid.in_subtree(places(spark, d), BOUNDS, "12").select("osm_id")


def _corner(f: str) -> str:
    return f"{f}(" + ", ".join(sqlgen.distance(f"{{'lat': a.{ya}, 'lon': a.{xa}}}", f"{{'lat': b.{yb}, 'lon': b.{xb}}}") for xa in ("xmin", "xmax") for ya in ("ymin", "ymax") for xb in ("xmin", "xmax") for yb in ("ymin", "ymax")) + ")"


CELLS = f"cells AS (SELECT {key_sql(2)} AS quadkey, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM pois GROUP BY 1)"
CORNERS = "corners AS (SELECT quadkey, unnest([xmin, xmin, xmax, xmax]) AS lon, unnest([ymin, ymax, ymin, ymax]) AS lat FROM cells)"


def cell_pairs(spark, d) -> DataFrame:
    cells = grid.cell_stats(places(spark, d), BOUNDS, 2)
    return cells.alias("a").join(cells.alias("b"), F.col("a.quadkey") < F.col("b.quadkey"))


def _sides():
    return tuple({k: F.col(f"{t}.{k}") for k in ("xmin", "ymin", "xmax", "ymax")} for t in "ab")


@query(f"SELECT a.quadkey AS a, b.quadkey AS b, round(max({sqlgen.distance('a', 'b')}), 3) AS dmax FROM corners a JOIN corners b ON a.quadkey < b.quadkey GROUP BY 1, 2")
def bbox_dmax(spark, d):
    return cell_pairs(spark, d).select(F.col("a.quadkey").alias("a"), F.col("b.quadkey").alias("b"), F.round(geo.boxes_dmax(*_sides()), 3).alias("dmax"))


ORACLES["bbox_dmax"] = ORACLES["bbox_dmax"].replace("\nSELECT a.quadkey", f",\n{CELLS},\n{CORNERS}\nSELECT a.quadkey", 1)

DMIN = f"""WITH {places_cte()}, {CELLS}, g AS (
  SELECT a.quadkey AS a, b.quadkey AS b, greatest(0.0, b.xmin - a.xmax, a.xmin - b.xmax) AS dx, greatest(0.0, b.ymin - a.ymax, a.ymin - b.ymax) AS dy,
    a.ymin AS a0, a.ymax AS a1, b.ymin AS b0, b.ymax AS b1 FROM cells a JOIN cells b ON a.quadkey < b.quadkey),
h AS (SELECT a, b, dx, CASE WHEN dy > 0 THEN CASE WHEN b0 > a1 THEN a1 ELSE a0 END ELSE least(a1, b1) END AS la,
    CASE WHEN dy > 0 THEN CASE WHEN b0 > a1 THEN b0 ELSE b1 END ELSE least(a1, b1) END AS lb FROM g)
SELECT a, b, round({sqlgen.distance('p', 'q')}, 3) AS dmin FROM (SELECT a, b, {{'lat': la, 'lon': 0.0}} AS p, {{'lat': lb, 'lon': dx}} AS q FROM h)"""


@query(DMIN, cte=False)
def bbox_dmin(spark, d):
    return cell_pairs(spark, d).select(F.col("a.quadkey").alias("a"), F.col("b.quadkey").alias("b"), F.round(geo.boxes_dmin(*_sides()), 3).alias("dmin"))


# ---- preparation -----------------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(p_name || ' & ' || p_brand || '  x', '[^a-zA-Z_]', ' ', 'g')), ' +', '_', 'g') AS tag FROM part", cte=False)
def tag_normalise(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    return t.select("p_partkey", prep.normalise_tag(F.concat("p_name", F.lit(" & "), "p_brand", F.lit("  x"))).alias("tag"))


_TWO = " UNION ".join(f"SELECT osm_id, name, x, y FROM ({layer_sql(x, x[0])})" for x in (*LAYERS, LAYERS[0]))


@query(_TWO, cte=False)
def layer_union(spark, d):
    every = [x.select("osm_id", "name", "x", "y") for x in layers(spark, d)]
    return prep.union_layers(*every, every[0])


@query("SELECT osm_id FROM pois WHERE (osm_id * 7919) % 100 < 40")
def sample_hash(spark, d):
    return prep.sample_modulo(places(spark, d), 40).select("osm_id")


@query("SELECT osm_id, count(*) AS n FROM (SELECT osm_id FROM pois UNION ALL SELECT osm_id FROM pois WHERE array_contains(keywords, 'PROMO')) GROUP BY osm_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    t = places(spark, d)
    return prep.duplicate_ids(t.select("osm_id").unionByName(search.with_keyword(t, "PROMO").select("osm_id")))


@query("SELECT round(median(s), 3) AS size FROM (SELECT (xmax - xmin + ymax - ymin) / 2 AS s FROM pois) WHERE s > 0")
def point_buffer_size(spark, d):
    return prep.point_buffer_size(places(spark, d)).select(F.round("size", 3).alias("size"))


@query("SELECT round(sum((xmax - xmin) * (ymax - ymin)) / 1e12, 9) AS area FROM pois")
def area_sum(spark, d):
    return prep.area_sum(places(spark, d)).select(F.round("area", 9).alias("area"))


@query("SELECT osm_id, xmin - 30 AS xmin, ymin - 30 AS ymin, xmax + 30 AS xmax, ymax + 30 AS ymax FROM pois WHERE xmin = xmax")
def point_buffer(spark, d):
    t = places(spark, d).where("xmin = xmax").withColumn("ring", prep.buffered(30.0)("ring"))
    b = topology.ring_box(F.col("ring"))
    return t.select("osm_id", *(b[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")))


REGIONS = "SELECT osm_id AS region, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1 FROM pois WHERE array_contains(keywords, 'depot')"
COVERED = f"SELECT p.osm_id, r.region, row_number() OVER (PARTITION BY p.osm_id ORDER BY (x1 - x0) * (y1 - y0), r.region)::INT AS area_rank FROM pois p JOIN ({REGIONS}) r ON p.xmin >= x0 AND p.xmax <= x1 AND p.ymin >= y0 AND p.ymax <= y1 WHERE array_contains(p.keywords, 'BUILDING')"


def region_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    t = places(spark, d)
    return search.with_keyword(t, "BUILDING"), search.with_keyword(t, "depot").withColumn("name", F.col("osm_id"))


@query(COVERED)
def covering_regions(spark, d):
    return prep.covering_regions(*region_tables(spark, d))


@query(f"SELECT osm_id, region FROM ({COVERED}) WHERE area_rank = 2")
def municipality(spark, d):
    return prep.municipality(*region_tables(spark, d))


@query("SELECT osm_id, xmin, ymin, xmax, ymax, lon, lat FROM pois")
def wkt_geometry(spark, d):
    """Geometries written as text and read back."""
    t = places(spark, d)
    back = P.from_rows(t.select("osm_id", "name", *P.TAGS, P.ring_wkt(F.col("ring")).alias("geometry")))
    return back.select("osm_id", "xmin", "ymin", "xmax", "ymax", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


ORACLES["wkt_geometry"] = ORACLES["wkt_geometry"].replace("ymax, lon, lat FROM", "ymax, round(lon, 6) AS lon, round(lat, 6) AS lat FROM")


BOXED = "osm_id, name, xmin, ymin, xmax, ymax, lon, lat, array_to_string(list_sort(keywords), ',') AS keywords"
BOX_COLS = ("osm_id", "name", "xmin", "ymin", "xmax", "ymax", "lon", "lat")


def boxed(t: DataFrame) -> DataFrame:
    return t.select(*BOX_COLS, F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


@query("SELECT osm_id, CASE WHEN xmin = xmax THEN 'Point' ELSE 'Polygon' END AS kind, lon, lat, name, array_to_string(list_sort(keywords), ',') AS keywords FROM pois")
def geojson_features(spark, d):
    f = F.from_json(P.geojson_feature(), "type string, geometry struct<type:string>, centroid struct<coordinates:array<double>>, properties struct<keywords:array<string>,name:string,osm_id:bigint>")
    t = places(spark, d).select(f.alias("f"))
    spot = F.col("f.centroid.coordinates")
    return t.select(F.col("f.properties.osm_id").alias("osm_id"), F.col("f.geometry.type").alias("kind"), spot[0].alias("lon"), spot[1].alias("lat"), F.col("f.properties.name").alias("name"), F.array_join("f.properties.keywords", ",").alias("keywords"))


@query(f"SELECT {BOXED} FROM pois WHERE len(keywords) > 0 OR name IS NOT NULL")
def geojson_round_trip(spark, d):
    """Places written as features and read back."""
    at = folder(spark, "geojson")
    P.write_geojson(places(spark, d), at)
    return boxed(P.read_geojson(spark, at))


@query(f"SELECT {BOXED} FROM pois")
def csv_round_trip(spark, d):
    """Places written as CSV and read back."""
    at = folder(spark, "csv")
    P.write_csv(places(spark, d).select("osm_id", "name", *P.TAGS, "ring", "lon", "lat"), at)
    return boxed(P.read_csv(spark, at, schema="osm_id long, name string, amenity string, shop string, tourism string, landuse string, leisure string, building string, lon double, lat double, geometry string, centroid string"))


@query("SELECT osm_id, 'BUILDING' AS keyword FROM pois WHERE array_contains(keywords, 'BUILDING') UNION ALL SELECT osm_id, 'PROMO' FROM pois WHERE array_contains(keywords, 'PROMO')")
def index_on_disk(spark, d):
    """The inverted table written, and the folders of two keywords read."""
    at = folder(spark, "index")
    P.write_index(places(spark, d), at, buckets=8)
    return P.read_index(spark, at, ["BUILDING", "PROMO"], buckets=8).select("osm_id", "keyword")


def index_match(spark, d):
    """A pattern over the index on disk: what its keywords' folders hold is all that is read."""
    at = folder(spark, "index")
    P.write_index(places(spark, d), at, buckets=8)
    return match(P.read_index(spark, at, [v.keyword for v in PATH3.vertices], buckets=8), PATH3)


def pattern_file(spark, d):
    """A pattern written to a file and read back, then matched."""
    at = folder(spark, "pattern")
    spark.createDataFrame([(PATH3.to_json(),)], "value string").coalesce(1).write.text(at)
    return match(places(spark, d), Pattern.from_json(spark.read.text(at, wholetext=True).first()[0].strip()))


for _f in (index_match, pattern_file):
    QUERIES[_f.__name__] = _f
    ORACLES[_f.__name__] = ORACLES["pattern_path3"]


@query(f"SELECT least(count(*), 10) AS n FROM {_FOUND}")
def limited_solutions(spark, d):
    return match(places(spark, d), PATH3, limit=10).agg(F.count("*").alias("n"))


@query("SELECT osm_id FROM pois ORDER BY osm_id LIMIT (SELECT (floor(0.3 * count(*)) + 1)::BIGINT FROM pois)")
def prefix_fraction(spark, d):
    return prep.first_fraction(places(spark, d), 0.3).select("osm_id")


_SIN = math.sin(750 / (2 * geo.RADIUS))


@query(f"SELECT osm_id, round(lat - degrees(750 / {geo.RADIUS!r}), 9) AS south, round(lat + degrees(750 / {geo.RADIUS!r}), 9) AS north, round(lon - degrees(2 * asin({_SIN!r} / cos(radians(lat)))), 9) AS west, round(lon + degrees(2 * asin({_SIN!r} / cos(radians(lat)))), 9) AS east FROM pois")
def extremes(spark, d):
    return places(spark, d).select("osm_id", geo.extremes(F.col("lat"), F.col("lon"), 750.0).alias("e")).select("osm_id", *(F.round(f"e.{c}", 9).alias(c) for c in ("south", "north", "west", "east")))


@query(f"SELECT n.a, n.b FROM ({ORACLES['bbox_dmin']}) n JOIN ({ORACLES['bbox_dmax']}) x ON n.a = x.a AND n.b = x.b WHERE n.dmin <= 2500 AND x.dmax >= 500", cte=False)
def matching_cells(spark, d):
    cells = grid.cell_stats(places(spark, d), BOUNDS, 2)
    return grid.matching_cells(cells, cells, 500.0, 2500.0).where("a < b")


@query("SELECT osm_id, 2 * (xmax - xmin) * (ymax - ymin) AS double_area FROM pois WHERE xmin < xmax")
def hull_repair(spark, d):
    """Rings whose corners are in a crossed order, repaired."""
    t = places(spark, d).where("xmin < xmax").withColumn("ring", F.array(*(F.get("ring", F.lit(i)) for i in (0, 2, 1, 3))))
    return t.select("osm_id", P.let(prep.convex_hull("ring"), topology.double_area).alias("double_area"))


COVER = "CASE " + " ".join(f"WHEN {sqlgen.relation('a', 'b', r)} THEN '{n}'" for r, n in (("covers", "contains"), ("coveredby", "within"), ("intersects", "intersects"))) + " ELSE 'disjoint' END"


@query(f"SELECT a.osm_id AS a, b.osm_id AS b, {COVER} AS relation {NEAR}")
def cover_label(spark, d):
    a, b = ematch.c("a", "ring"), ematch.c("b", "ring")
    return near_pairs(spark, d).select(ematch.c("a", "osm_id").alias("a"), ematch.c("b", "osm_id").alias("b"), topology.cover_label(a, b).alias("relation"))


# ---- across the antimeridian -----------------------------------------------------------------------

_MOVED = "moved AS (SELECT * REPLACE (CASE WHEN lon > -0.118 THEN lon - 179.882 ELSE lon + 180.118 END AS lon) FROM pois)"
ACROSS = edge(100.0, 600.0, "<>")


def moved(spark, d) -> DataFrame:
    """The places about the antimeridian."""
    return places(spark, d).withColumn("lon", F.when(F.col("lon") > -0.118, F.col("lon") - 179.882).otherwise(F.col("lon") + 180.118))


pattern_query("antimeridian_pairs", ACROSS)
QUERIES["antimeridian_pairs"] = lambda spark, d: match(moved(spark, d), ACROSS)
ORACLES["antimeridian_pairs"] = sqlgen.pattern_sql(ACROSS, source="moved", ctes=[places_cte(), _MOVED])


@query(f"SELECT osm_id FROM moved, (SELECT 51.51::DOUBLE AS lat, 179.999::DOUBLE AS lon) here WHERE array_contains(keywords, 'BUILDING') AND {sqlgen.distance('here', 'moved')} <= 2500")
def antimeridian_circle(spark, d):
    return search.in_circle(moved(spark, d), ["BUILDING"], 51.51, 179.999, 2500.0).select("osm_id")


ORACLES["antimeridian_circle"] = ORACLES["antimeridian_circle"].replace("\nSELECT osm_id", f",\n{_MOVED}\nSELECT osm_id", 1)

# ---- shapes that are no rectangles -----------------------------------------------------------------
# Depots by their number: an L (a box without the corner from x1, y1 on, its outer sides included), a frame (a box without that middle), two parts (what
# is left and right of x1..x2). SQL tells a rectangle's relation to them by boxes alone.

_THIRDS = "xmin AS x0, xmax AS x3, ymin AS y0, ymax AS y3, xmin + (xmax - xmin) // 4 AS x1, CASE WHEN osm_id % 3 = 0 THEN xmax + 1 ELSE xmax - (xmax - xmin) // 4 END AS x2, ymin + (ymax - ymin) // 4 AS y1, CASE WHEN osm_id % 3 = 0 THEN ymax + 1 ELSE ymax - (ymax - ymin) // 4 END AS y2"
_ODD = f"odd AS (SELECT osm_id, osm_id % 3 AS kind, {_THIRDS} FROM pois WHERE array_contains(keywords, 'depot'))"
_CUT = "CASE WHEN kind = 2 THEN b.xmin >= x1 AND b.xmax <= x2 ELSE b.xmin >= x1 AND b.xmax <= x2 AND b.ymin >= y1 AND b.ymax <= y2 END"  # within the closed cut
_IN = "b.xmin >= x0 AND b.xmax <= x3 AND b.ymin >= y0 AND b.ymax <= y3"
_MEETS_CUT = "CASE WHEN kind = 2 THEN b.xmin < x2 AND b.xmax > x1 ELSE b.xmin < x2 AND b.xmax > x1 AND b.ymin < y2 AND b.ymax > y1 END"  # the open one
_SHAPE = {
    "covers": f"({_IN}) AND NOT ({_MEETS_CUT})",
    # what of the rectangle is in the box lies within the open cut, or the two don't meet
    "intersects": "b.xmin <= x3 AND b.xmax >= x0 AND b.ymin <= y3 AND b.ymax >= y0 AND NOT CASE kind WHEN 2 THEN greatest(b.xmin, x0) > x1 AND least(b.xmax, x3) < x2 "
    "WHEN 0 THEN greatest(b.xmin, x0) > x1 AND greatest(b.ymin, y0) > y1 ELSE greatest(b.xmin, x0) > x1 AND least(b.xmax, x3) < x2 AND greatest(b.ymin, y0) > y1 AND least(b.ymax, y3) < y2 END",
}


def odd_depots(spark, d) -> DataFrame:
    """The places, with depots that are no rectangles; read from text."""
    t = places(spark, d)
    k = F.col("osm_id") % 3
    x0, y0, x3, y3 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    w, h = F.floor((x3 - x0) / 4).cast("long"), F.floor((y3 - y0) / 4).cast("long")
    x1, y1 = x0 + w, y0 + h
    x2, y2 = x3 - w, y3 - h

    def text(*corners) -> F.Column:
        pair = [F.concat_ws(" ", (x / 1e6).cast("decimal(12,6)"), (y / 1e6).cast("decimal(12,6)")) for x, y in (*corners, corners[0])]
        return F.concat(F.lit("("), F.concat_ws(", ", *pair), F.lit(")"))

    outer = text((x0, y0), (x3, y0), (x3, y3), (x0, y3))
    ell = F.concat(F.lit("POLYGON ("), text((x0, y0), (x3, y0), (x3, y1), (x1, y1), (x1, y3), (x0, y3)), F.lit(")"))
    frame = F.concat(F.lit("POLYGON ("), outer, F.lit(", "), text((x1, y1), (x2, y1), (x2, y2), (x1, y2)), F.lit(")"))
    two = F.concat(F.lit("MULTIPOLYGON (("), text((x0, y0), (x1, y0), (x1, y3), (x0, y3)), F.lit("), ("), text((x2, y0), (x3, y0), (x3, y3), (x2, y3)), F.lit("))"))
    depot = F.array_contains("keywords", "depot")
    at = folder(spark, "shapes")  # parsed once, in even tasks: a file may hold all of them
    P.with_geometry(ematch.dealt(t.where(depot)).withColumn("geometry", F.when(k == 0, ell).when(k == 1, frame).otherwise(two))).drop("geometry").write.parquet(at)
    shaped = spark.read.parquet(at)
    return shaped.unionByName(t.where(~F.coalesce(depot, F.lit(False))), allowMissingColumns=True)


for _r, _p in (("covers", edge(relation="covers", a="depot", b="BUILDING")), ("intersects", edge(relation="intersects", a="depot", b="BUILDING")), ("within", edge(relation="within", a="BUILDING", b="depot")), ("contains_points", edge(relation="covers", a="depot", b="signup"))):
    QUERIES[f"shapes_{_r}"] = lambda spark, d, p=_p: match(odd_depots(spark, d), p)
    _swap = _r == "within"
    ORACLES[f"shapes_{_r}"] = f"WITH {places_cte()},\n{_ODD}\nSELECT {'b.osm_id AS a, o.osm_id AS b' if _swap else 'o.osm_id AS a, b.osm_id AS b'} FROM odd o, pois b WHERE array_contains(b.keywords, '{'signup' if 'points' in _r else 'BUILDING'}') AND {_SHAPE['intersects' if _r == 'intersects' else 'covers']}"


@query("SELECT osm_id, lon, lat FROM pois WHERE array_contains(keywords, 'PROMO') AND lon BETWEEN -0.15 AND -0.1 AND lat BETWEEN 51.48 AND 51.53")
def node_search(spark, d):
    """A box search through the cells that meet the box."""
    box = (-0.15, 51.48, -0.10, 51.53)
    keyed = grid.with_quadkey(search.with_keyword(places(spark, d), "PROMO"), BOUNDS, 4)
    return search.in_bbox(keyed.where(F.col("quadkey").isin(grid.quadkeys_in_bbox(box, BOUNDS, 4))), ["PROMO"], box).select("osm_id", "lon", "lat")


# ---- solver logs, read from order lines ------------------------------------------------------------

LOG = "SELECT l_returnflag || l_linestatus AS module, l_linenumber::BIGINT AS dataset_size, l_quantity AS elapsed_time, l_extendedprice AS memory_usage FROM lineitem"


def solver_log(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(F.concat("l_returnflag", "l_linestatus").alias("module"), F.col("l_linenumber").cast("long").alias("dataset_size"), F.col("l_quantity").alias("elapsed_time"), F.col("l_extendedprice").alias("memory_usage"))


@query(
    f"SELECT module, count(*) AS n, round(avg(elapsed_time), 6) AS mean, round(stddev_samp(elapsed_time), 6) AS std, min(elapsed_time) AS lowest, quantile_cont(elapsed_time, 0.25) AS q1, "
    f"quantile_cont(elapsed_time, 0.5) AS q2, quantile_cont(elapsed_time, 0.75) AS q3, max(elapsed_time) AS highest FROM ({LOG}) GROUP BY module", cte=False
)
def solver_summary(spark, d):
    t = report.describe(solver_log(spark, d))
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"SELECT module, round(quantile_cont(elapsed_time, 0.95), 6) AS p FROM ({LOG}) GROUP BY module", cte=False)
def solver_p95(spark, d):
    return report.percentile(solver_log(spark, d)).withColumn("p", F.round("p", 6))


_PIVOT = ", ".join(f"round(avg(elapsed_time) FILTER (dataset_size = {k}), 6) AS \"{k}\"" for k in range(1, 8))


@query(f"SELECT module, {_PIVOT} FROM ({LOG}) GROUP BY module", cte=False)
def solver_pivot(spark, d):
    t = report.crosstab(solver_log(spark, d), "module", "dataset_size", "elapsed_time", list(range(1, 8)))
    return t.select("module", *(F.round(f"`{k}`", 6).alias(str(k)) for k in range(1, 8)))


@query(f"SELECT module, dataset_size, round(avg(elapsed_time), 6) AS elapsed_time, round(avg(memory_usage), 3) AS memory_usage FROM ({LOG}) GROUP BY module, dataset_size", cte=False)
def solver_mean(spark, d):
    return report.mean_time(solver_log(spark, d), ["module", "dataset_size"]).withColumns({"elapsed_time": F.round("elapsed_time", 6), "memory_usage": F.round("memory_usage", 3)})


@query(f"SELECT keyword, count(*) AS n FROM (SELECT unnest(['{PATH3.vertices[0].keyword}', '{PATH3.vertices[1].keyword}', '{PATH3.vertices[2].keyword}']) AS keyword FROM region) GROUP BY keyword", cte=False)
def pattern_keywords(spark, d):
    log = spark.read.parquet(f"{d}/region.parquet").select(F.lit(PATH3.to_json()).alias("spatial_pattern"))
    return report.pattern_keywords(log).groupBy("keyword").agg(F.count("*").alias("n"))


@query(
    f"SELECT module, count(*) AS n, round(avg(elapsed_time), 6) AS mean, round(stddev_samp(elapsed_time), 6) AS std, min(elapsed_time) AS lowest, quantile_cont(elapsed_time, 0.25) AS q1, "
    f"quantile_cont(elapsed_time, 0.5) AS q2, quantile_cont(elapsed_time, 0.75) AS q3, max(elapsed_time) AS highest FROM ({LOG}) WHERE dataset_size <= 2 GROUP BY module", cte=False
)
def solver_summary_of_some(spark, d):
    t = report.describe(solver_log(spark, d).where("dataset_size <= 2"))
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"SELECT module, count(DISTINCT dataset_size) AS sizes, min(memory_usage) AS least, max(memory_usage) AS most, round(sum(memory_usage), 2) AS total FROM ({LOG}) GROUP BY module", cte=False)
def solver_memory(spark, d):
    return report.memory_of(solver_log(spark, d)).withColumn("total", F.round("total", 2))


TRIED = (ACROSS, PATH3)


@query("\nUNION ALL\n".join(f"SELECT {i}::INT AS sp_index, module, count(*) AS total_solutions FROM ({sqlgen.pattern_sql(p, ctes=[places_cte()])}), (SELECT unnest(['grid', 'edges']) AS module) GROUP BY module" for i, p in enumerate(TRIED)), cte=False)
def experiment_log(spark, d):
    """Patterns by solvers, a line of the log for each run."""
    t = places(spark, d)
    solvers = {"grid": match, "edges": solve_by_edges}
    log = report.run_experiments(spark, folder(spark, "log"), [(t.count(), t)], [(0.0, p) for p in TRIED], solvers)
    return log.select("sp_index", "module", "total_solutions")
