"""The Spark text of patterns: the same answers as the engine's, without a nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from geomotif.operators.match import statistics
from geomotif.plans import sqlgen
from geomotif.plans.pattern import Edge, Pattern, Vertex

from .test_engine import brute, table, town


@pytest.mark.parametrize("strategy", ["implicit", "explicit"])
@pytest.mark.parametrize("shift", [0, 180_117_500])
def test_text_for_spark_uses_cells(spark, strategy, shift):
    rows = [(i, kw, x + shift, y, hx, hy) for i, kw, x, y, hx, hy in town(21, 40)]
    t = table(spark, rows).withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))
    t.createOrReplaceTempView("sqlgen_pois")
    p = Pattern(tuple(Vertex(k, w) for k, w in zip("xyz", "abc", strict=True)), (Edge("0", "x", "y", 200, 2500, ">"), Edge("1", "y", "z", 0, 3000, "<"), Edge("2", "z", "x", 300, 4000)))
    counts, extent = statistics(t, ["a", "b", "c"])
    out = spark.sql(sqlgen.spark_sql(p, "sqlgen_pois", strategy, counts, extent.max_abs_lat))
    got = [tuple(r) for r in out.select("x", "y", "z").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, p) and got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_for_spark_goes_on_with_unbounded_edges_and_parts(spark):
    rows = town(22, 30)
    table(spark, rows).createOrReplaceTempView("sqlgen_pois")
    far = Pattern(tuple(Vertex(k, w) for k, w in zip("xyz", "abc", strict=True)), (Edge("0", "x", "y", 900),))
    for strategy in ("implicit", "explicit"):
        got = spark.sql(sqlgen.spark_sql(far, "sqlgen_pois", strategy, {}, 51.6)).select("x", "y", "z").collect()
        assert {tuple(r) for r in got} == brute(rows, far)


def test_text_for_spark_shuffles_no_answers_where_ids_are_unique(spark):
    rows = town(23, 50)
    t = table(spark, rows)
    t.createOrReplaceTempView("sqlgen_pois")
    p = Pattern(tuple(Vertex(k, w) for k, w in zip("xyz", "abc", strict=True)), (Edge("0", "x", "y", 200, 2500, ">"), Edge("1", "y", "z", 0, 3000)))
    counts, extent = statistics(t, ["a", "b", "c"])
    assert extent.unique
    for strategy in ("implicit", "explicit"):
        out = spark.sql(sqlgen.spark_sql(p, "sqlgen_pois", strategy, counts, extent.max_abs_lat, min_abs_lat=extent.min_abs_lat, unique=True))
        got = [tuple(r) for r in out.select("x", "y", "z").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, p) and got
        assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
