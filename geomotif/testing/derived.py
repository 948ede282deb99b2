"""Places computed from the star-schema tables by integer arithmetic that any engine repeats exactly.

With key k: x = X0 + (k * mx) % WIDTH and y = Y0 + (k * my) % HEIGHT in micro-degrees, and a rectangle of half sides hx
and hy around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.poi import TAGS, keywords_of

X0, Y0, WIDTH, HEIGHT = -204790, 51455906, 173397, 107919
BOUNDS = (X0 / 1e6, Y0 / 1e6, (X0 + WIDTH) / 1e6, (Y0 + HEIGHT) / 1e6)

#: table, key, first id, tag columns, multipliers, half sides
LAYERS = (
    ("customer", "c_custkey", 1_000_000, "c_name", {"amenity": "c_mktsegment"}, 7919, 104729, "50 + ({k} % 7) * 40", "50 + ({k} % 5) * 40"),
    ("part", "p_partkey", 2_000_000, "p_name", {"shop": "p_brand", "building": "p_type"}, 6101, 7907, "50 + ({k} % 7) * 40", "50 + ({k} % 5) * 40"),
    ("supplier", "s_suppkey", 3_000_000, "s_name", {"tourism": "'depot'"}, 15485863, 32452843, "4000", "2500"),
    ("orders", "o_orderkey", 4_000_000, "o_orderstatus", {"landuse": "o_orderpriority"}, 1299709, 611953, "1500 + ({k} % 7) * 100", "1000 + ({k} % 5) * 100"),
    ("events", "event_id", 5_000_000, "event_type", {"leisure": "event_type"}, 179424673, 86028121, "0", "0"),
)


def layer_sql(layer: tuple, source: str) -> str:
    """SELECT of one layer, in words that Spark SQL and DuckDB both read."""
    _, key, first, label, tags, mx, my, hx, hy = layer
    k = f"CAST({key} AS BIGINT)"
    cols = [f"{first} + {k} AS osm_id", f"CAST({label} AS VARCHAR(200)) AS name"]
    cols += [f"CAST({tags[t]} AS VARCHAR(50)) AS {t}" if t in tags else f"CAST(NULL AS VARCHAR(50)) AS {t}" for t in TAGS]
    cols += [f"{X0} + ({k} * {mx}) % {WIDTH} AS x", f"{Y0} + ({k} * {my}) % {HEIGHT} AS y"]
    cols += [f"CAST({hx.format(k=k)} AS BIGINT) AS hx", f"CAST({hy.format(k=k)} AS BIGINT) AS hy"]
    return f"SELECT {', '.join(cols)} FROM {source}"


def layers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [spark.sql(layer_sql(x, f"parquet.`{sf_dir}/{x[0]}.parquet`")).withColumns({t: F.col(t).cast("string") for t in ("name", *TAGS)}) for x in LAYERS]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers as one table of places."""
    df = reduce(DataFrame.unionAll, layers(spark, sf_dir))
    x, y, hx, hy = (F.col(c) for c in ("x", "y", "hx", "hy"))
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    point = F.array(corner(x, y))
    ring = F.array(corner(x - hx, y - hy), corner(x + hx, y - hy), corner(x + hx, y + hy), corner(x - hx, y + hy))
    return df.select(
        "osm_id", "name", *TAGS, keywords_of(TAGS).alias("keywords"), (x / 1e6).alias("lon"), (y / 1e6).alias("lat"),
        (x - hx).alias("xmin"), (y - hy).alias("ymin"), (x + hx).alias("xmax"), (y + hy).alias("ymax"),
        F.when((hx == 0) & (hy == 0), point).otherwise(ring).alias("ring"),
    )


def places_cte() -> str:
    """The same table as a DuckDB common table expression named pois."""
    rows = "\nUNION ALL\n".join(layer_sql(x, x[0]) for x in LAYERS)
    tags = ", ".join(TAGS)
    return (
        f"pois AS (SELECT osm_id, name, {tags}, list_filter([{tags}], lambda t: t IS NOT NULL) AS keywords, x / 1e6 AS lon, y / 1e6 AS lat, "
        f"x - hx AS xmin, y - hy AS ymin, x + hx AS xmax, y + hy AS ymax FROM ({rows}))"
    )
