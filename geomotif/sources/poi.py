"""Places: reading, writing, keywords, and the index by keyword.

A table of places has osm_id, name, tag columns, ``keywords`` (the distinct non-null tags), lon and lat of the
centroid, a bounding box in integer micro-degrees, ``ring``, the vertices of its outer ring in the same units, and ``rings``,
which is null where a convex ring is the whole shape, and else holds all rings with the interior on their left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import topology

TAGS = ("amenity", "shop", "tourism", "landuse", "leisure", "building")
RESERVED = frozenset("osm_id id osmid name geometry centroid lon lat x y keywords category ring kind xmin ymin xmax ymax wkt".split())
CSV_SCHEMA = "osm_id long, name string, amenity string, shop string, tourism string, landuse string, leisure string, building string, geometry string, centroid string"
VERTEX = "struct<x:bigint,y:bigint>"
GEOJSON_SCHEMA = (
    "features array<struct<geometry:struct<type:string,coordinates:string>,centroid:struct<type:string,coordinates:array<double>>,"
    "properties:map<string,string>>>"
)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x evaluated once: the optimizer copies a column into every place that names it, but not what a
    lambda binds."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


# ---- keywords ------------------------------------------------------------------------------------


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def keywords_of(tags: Sequence[str]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(blank_to_null(F.col(t)) for t in tags))))


def category_of(tags: Sequence[str]) -> Column:
    """Names of the tag columns that are set, each with a comma after it."""
    return F.concat(*(F.when(blank_to_null(F.col(t)).isNotNull(), F.lit(t + ",")).otherwise("") for t in tags))


def tag_columns(df: DataFrame) -> list[str]:
    """All columns that are not of the fixed part of the schema."""
    return sorted(set(df.columns) - RESERVED)


def description() -> Column:
    return F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.array_join(F.array_sort("keywords"), ","), F.lit(")"))


def keyword_condition(tags: Sequence[str], keyword: str, mode: str = "or") -> Column:
    """Whether some tag (``or``) or every tag (``and``) is the keyword."""
    conds = [F.coalesce(F.col(t) == keyword, F.lit(False)) for t in tags]
    out = conds[0]
    for c in conds[1:]:
        out = out | c if mode == "or" else out & c
    return out


def id_of(df: DataFrame) -> Column:
    """The id of a place under any of its usual names."""
    return F.coalesce(*(F.col(c).cast("long") for c in ("osm_id", "id", "osmid") if c in df.columns))


def from_rows(df: DataFrame, tags: Sequence[str] = TAGS, wkt: str = "geometry") -> DataFrame:
    """A table of places from any table with an id, a geometry as text and tag columns."""
    own = [t for t in tags if t in df.columns]
    df = with_geometry(df.withColumns({"osm_id": id_of(df), **{t: blank_to_null(F.col(t)) for t in own}}), wkt)
    return df.withColumns({"keywords": keywords_of(own), "category": category_of(own)})


# ---- geometry from text --------------------------------------------------------------------------


def micro(c: Column) -> Column:
    """Degrees, rounded to six decimals, in integer micro-degrees."""
    return F.round(c * 1_000_000).cast("bigint")


def text_vertices(text: Column) -> Column:
    """Vertices of "x y, x y, ..." in micro-degrees, without a closing one."""
    number = lambda q, i: micro(F.get(q, F.lit(i)).cast("double"))
    vertex = lambda s: let(F.split(F.trim(s), r"\s+"), lambda q: F.struct(number(q, 0).alias("x"), number(q, 1).alias("y")))
    return let(F.transform(F.split(text, ","), vertex), unclosed)


def wkt_vertices(wkt: Column) -> Column:
    """Vertices of the first ring, or of the point or line string."""
    return text_vertices(F.regexp_extract(wkt, r"\(+([^()]*)\)", 1))


def oriented(part: Column) -> Column:
    """The rings of one polygon, the outer one first: it runs counter-clockwise, its holes clockwise."""
    return F.transform(part, lambda r, i: F.when((F.size(r) > 2) & ((ring_area2(r) < 0) == (i == 0)), F.reverse(r)).otherwise(r))


def wkt_rings(wkt: Column) -> Column:
    """All rings of POINT, LINESTRING, POLYGON or MULTIPOLYGON text."""
    parts = F.split(wkt, r"\)\s*\)\s*,\s*\(\s*\(")
    rings = lambda p: F.transform(F.regexp_extract_all(F.concat(F.lit("("), p, F.lit(")")), F.lit(r"([-+0-9][-+0-9.eE]*\s+[-+0-9.eE]+[^()]*)"), F.lit(1)), text_vertices)
    return F.flatten(F.transform(parts, lambda p: oriented(rings(p))))


def unclosed(v: Column) -> Column:
    """A ring without a last vertex that repeats the first."""
    closed = (F.size(v) > 1) & (F.element_at(v, 1) == F.element_at(v, -1))
    return F.when(closed, F.slice(v, 1, F.size(v) - 1)).otherwise(v)


def ring_area2(v: Column) -> Column:
    n = F.size(v)
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"),
        lambda s, i: s + F.get(v, i)["x"] * F.get(v, (i + 1) % n)["y"] - F.get(v, (i + 1) % n)["x"] * F.get(v, i)["y"],
    )


def shape_centroid(rings: Column) -> tuple[Column, Column]:
    """Centroid of polygons by area, and of points and segments by vertices, in micro-degrees."""
    p = F.get(F.get(rings, F.lit(0)), F.lit(0))

    def moment(v: Column, axis: str) -> Column:
        # relative to the first vertex of all, so that products stay small
        n = F.size(v)

        def add(s, i):
            a, b = F.get(v, i), F.get(v, (i + 1) % n)
            ax, ay, bx, by = a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"]
            return s + ((a[axis] - p[axis]) + (b[axis] - p[axis])).cast("double") * (ax * by - bx * ay).cast("double")

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add)

    area = F.aggregate(rings, F.lit(0).cast("bigint"), lambda s, r: s + F.when(F.size(r) > 2, ring_area2(r)).otherwise(0))
    whole = lambda axis: F.aggregate(rings, F.lit(0.0), lambda s, r: s + moment(r, axis))
    flat = F.flatten(rings)
    mean = lambda axis: F.aggregate(flat, F.lit(0).cast("bigint"), lambda s, q: s + q[axis]) / F.size(flat)
    return tuple(F.when(area != 0, p[c] + whole(c) / (3 * area)).otherwise(mean(c)) for c in ("x", "y"))


def with_geometry(df: DataFrame, wkt: str = "geometry") -> DataFrame:
    """Adds ring, rings, box and centroid (lon, lat); line strings become their centroid."""
    line = F.upper(F.trim(F.col(wkt))).startswith("LINESTRING")
    return df.withColumn("_g", let(wkt_rings(F.col(wkt)), lambda r: shape_of(r, line))).select(*(c for c in df.columns if c not in SHAPE), "_g.*")


SHAPE = ("ring", "rings", "xmin", "ymin", "xmax", "ymax", "lon", "lat")


def shape_of(rings: Column, as_point: Column, lon: Column | None = None, lat: Column | None = None) -> Column:
    """Struct of ring, rings, box and centroid; as_point: whether the centroid takes the shape's place."""
    cx, cy = shape_centroid(rings)

    def place(spot: Column) -> Column:
        point = F.array(F.struct(F.round(spot["x"]).cast("bigint").alias("x"), F.round(spot["y"]).cast("bigint").alias("y")))

        def boxed(all_: Column) -> Column:
            first = F.get(all_, F.lit(0))
            flat = F.flatten(all_)
            xs, ys = F.transform(flat, lambda v: v["x"]), F.transform(flat, lambda v: v["y"])
            plain = (F.size(all_) < 2) & ((F.size(first) < 4) | topology.is_convex(first))
            return F.struct(
                first.alias("ring"), F.when(~plain, all_).alias("rings"),
                F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
                F.coalesce(*([lon] if lon is not None else []), spot["x"] / 1e6).alias("lon"), F.coalesce(*([lat] if lat is not None else []), spot["y"] / 1e6).alias("lat"),
            )

        return let(F.when(as_point, F.array(point)).otherwise(rings), boxed)

    return let(F.struct(cx.cast("double").alias("x"), cy.cast("double").alias("y")), place)


def whole_shape() -> Column:
    """All rings of a place."""
    return F.coalesce("rings", F.array("ring"))


def shape_wkt() -> Column:
    """The text of a place's whole shape: each outer ring begins a part."""
    pair = lambda v: F.concat_ws(" ", (v["x"] / 1e6).cast("decimal(12,6)"), (v["y"] / 1e6).cast("decimal(12,6)"))
    text = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(", "), pair(F.get(r, F.lit(0))), F.lit(")"))
    joined = F.array_join(F.transform("rings", lambda r, i: F.concat(F.when(i == 0, "").when(ring_area2(r) > 0, "), (").otherwise(", "), text(r))), "")
    return F.when(F.col("rings").isNull(), ring_wkt(F.col("ring"))).otherwise(F.concat(F.lit("MULTIPOLYGON (("), joined, F.lit("))")))


def ring_wkt(ring: Column) -> Column:
    pair = lambda v: F.concat_ws(" ", (v["x"] / 1e6).cast("decimal(12,6)"), (v["y"] / 1e6).cast("decimal(12,6)"))
    first = F.get(ring, F.lit(0))
    text = F.array_join(F.transform(ring, pair), ", ")
    return F.when(F.size(ring) == 1, F.concat(F.lit("POINT ("), text, F.lit(")"))).when(
        F.size(ring) == 2, F.concat(F.lit("LINESTRING ("), text, F.lit(")"))
    ).otherwise(F.concat(F.lit("POLYGON (("), text, F.lit(", "), pair(first), F.lit("))")))


# ---- sources and sinks ---------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, tags: Sequence[str] = TAGS, sep: str = ",", schema: str = CSV_SCHEMA) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    own = [t for t in tags if t in df.columns]
    df = df.withColumns({t: blank_to_null(F.col(t)) for t in own})
    df = with_geometry(df)
    if "centroid" in df.columns:
        spot = F.get(wkt_vertices(F.col("centroid")), F.lit(0))
        df = df.withColumns({"lon": F.coalesce(spot["x"] / 1e6, "lon"), "lat": F.coalesce(spot["y"] / 1e6, "lat")})
    return df.withColumns({"keywords": keywords_of(own), "category": category_of(own)})


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Places with their geometry as text; arrays have no place in CSV."""
    plain = df.withColumns({"geometry": shape_wkt() if "rings" in df.columns else ring_wkt(F.col("ring")), "centroid": F.concat(F.lit("POINT ("), F.concat_ws(" ", "lon", "lat"), F.lit(")"))})
    keep = [c for c, t in plain.dtypes if not t.startswith(("array", "struct", "map"))]
    plain.select(*keep).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def geojson_feature(whole: bool = False) -> Column:
    """A place as GeoJSON: geometry, centroid and the properties keywords, name, osm_id. whole: whether there are rings."""
    pair = lambda v: F.array(v["x"] / 1e6, v["y"] / 1e6)
    ring = F.transform("ring", pair)
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.get(ring, F.lit(0)).alias("coordinates")))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(ring, F.slice(ring, 1, 1))).alias("coordinates")))
    geometry = F.when(F.size("ring") == 1, point).otherwise(polygon)
    if whole:
        closed = lambda r: F.to_json(F.transform(F.concat(r, F.slice(r, 1, 1)), pair))
        parts = F.array_join(F.transform("rings", lambda r, i: F.concat(F.when(i == 0, "").when(ring_area2(r) > 0, "],[").otherwise(","), closed(r))), "")
        geometry = F.when(F.col("rings").isNotNull(), F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), parts, F.lit("]]}"))).otherwise(geometry)
    centroid = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    rest = F.to_json(F.struct(F.array_sort("keywords").alias("keywords"), "name", "osm_id"))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"centroid":'), centroid, F.lit(',"properties":'), rest, F.lit("}"))


def write_geojson(df: DataFrame, path: str) -> None:
    """One feature a line, which many executors can write and read."""
    df.select(geojson_feature("rings" in df.columns).alias("value")).write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Features with a keyword or a name, from lines of features or (multi_line) one feature collection."""
    if multi_line:
        rows = spark.read.schema("features array<string>").option("multiLine", True).json(path).select(F.explode("features").alias("value"))
    else:
        rows = spark.read.text(path)
    f = F.from_json(
        "value", "geometry struct<type:string,coordinates:string>, centroid struct<coordinates:array<double>>, properties struct<keywords:array<string>,name:string,osm_id:bigint,id:bigint,amenity:string,shop:string>"
    )
    df = rows.select(f.alias("f")).select("f.*")
    p = F.col("properties")
    words = F.array_distinct(F.array_compact(F.concat(F.coalesce(p["keywords"], F.array().cast("array<string>")), F.array(p["amenity"], p["shop"]))))
    flat = F.regexp_replace(F.col("geometry.coordinates"), r"[\[\]]", "")
    numbers = F.transform(F.split(flat, ","), lambda s: s.cast("double"))
    vertex = lambda q: F.struct(micro(F.get(q, F.lit(0))).alias("x"), micro(F.get(q, F.lit(1))).alias("y"))
    # rings are the innermost lists of pairs; a polygon of several begins after three closing brackets
    parts = F.split(F.regexp_replace(F.col("geometry.coordinates"), r"\s", ""), r"\]\]\],\[\[\[")
    ring = lambda t: let(F.transform(F.from_json(F.concat(F.lit("[["), t, F.lit("]]")), "array<array<double>>"), vertex), unclosed)
    of_part = lambda t: oriented(F.transform(F.regexp_extract_all(t, F.lit(r"([-0-9.eE+]+,[-0-9.eE+]+(?:\],\[[-0-9.eE+,]+)*)"), F.lit(1)), ring))
    rings = F.when(F.col("geometry.type") == "Point", F.array(F.array(vertex(numbers)))).otherwise(F.flatten(F.transform(parts, of_part)))
    shape = let(rings, lambda r: shape_of(r, F.lit(False), F.get("centroid.coordinates", F.lit(0)), F.get("centroid.coordinates", F.lit(1))))
    df = df.select(F.coalesce(p["osm_id"], p["id"]).alias("osm_id"), p["name"].alias("name"), words.alias("keywords"), shape.alias("g")).select("osm_id", "name", "keywords", "g.*")
    return df.where((F.size("keywords") > 0) | F.col("name").isNotNull())


def save_table(poi: DataFrame, name: str, buckets: int = 64) -> None:
    """A catalogue table, bucketed by id so that payloads join answers without a shuffle of the table."""
    poi.write.mode("overwrite").bucketBy(buckets, "osm_id").sortBy("osm_id").saveAsTable(name)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_by: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A table of a database, read by several tasks where a numeric column and its bounds are given. Rows beyond the bounds
    are read too, by the first and the last task."""
    if partition_by:
        lo, hi = bounds or (0, 1 << 40)
        options |= {"partitionColumn": partition_by, "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Places with their geometry as text into a table of a database."""
    plain = df.withColumn("geometry", shape_wkt() if "rings" in df.columns else ring_wkt(F.col("ring")))
    keep = [c for c, t in plain.dtypes if not t.startswith(("array", "struct", "map"))]
    plain.select(*keep).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


# ---- index ---------------------------------------------------------------------------------------


def by_keyword(poi: DataFrame) -> DataFrame:
    """The inverted table: a row for each keyword of each place."""
    return poi.select(F.explode("keywords").alias("keyword"), *poi.columns)


def write_index(poi: DataFrame, path: str, buckets: int = 64) -> None:
    """The inverted table on disk: hashed keyword folders hold files sorted by keyword and position, so a query
    reads the folders of its keywords and, by column statistics, the row groups near its area. A popular keyword is
    spread over several writers."""
    rows = by_keyword(poi).withColumn("bucket", F.pmod(F.xxhash64("keyword"), F.lit(buckets)).cast("int"))
    spread = F.floor(F.col("lon") * 8).cast("long")
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "keyword", "lat", "lon").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, keywords: Sequence[str] | None = None, buckets: int = 64) -> DataFrame:
    df = spark.read.parquet(path)
    if keywords is not None:
        own = spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(k)), F.lit(buckets)).cast("int") for k in keywords)).first() if keywords else ()
        df = df.where(F.col("bucket").isin(sorted(set(own))) & F.col("keyword").isin(list(keywords)))
    return df.drop("bucket")
