"""Statistics of keywords and of solver logs, and solutions as JSON."""

from __future__ import annotations

import time
import weakref
from collections.abc import Callable, Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.poi import description

LOG_SCHEMA = (
    "repetition int, sp_index int, spatial_pattern string, number_of_vertices int, number_of_edges int, number_of_exclusion_contraints int, "
    "qualitative_prob double, dataset_size long, module string, total_solutions long, elapsed_time double, memory_usage double"
)


def keyword_frequency(poi: DataFrame) -> DataFrame:
    rows = poi if "keyword" in poi.columns else poi.select(F.explode("keywords").alias("keyword"))
    return rows.groupBy("keyword").agg(F.count("*").alias("n"))


def top_keywords(poi: DataFrame, k: int = 30) -> DataFrame:
    return keyword_frequency(poi).orderBy(F.desc("n"), "keyword").limit(k)


def frequent_keywords(poi: DataFrame, tags: Sequence[str], more_than: int = 30) -> DataFrame:
    """Distinct values that occur more than so often within one tag column."""
    long = poi.unpivot([], list(tags), "tag", "keyword").where("keyword is not null")
    return long.groupBy("tag", "keyword").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("keyword").distinct()


def keyword_types(poi: DataFrame, tags: Sequence[str], k: int = 25) -> DataFrame:
    """The most frequent tag values over all columns, after the k most frequent of each."""
    long = poi.unpivot([], list(tags), "tag", "keyword").where("keyword is not null").groupBy("tag", "keyword").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tag").orderBy(F.desc("n"), "keyword")
    few = long.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return few.groupBy("keyword").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def mean_time(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.groupBy(*keys).agg(F.avg("elapsed_time").alias("elapsed_time"), F.avg("memory_usage").alias("memory_usage"))


def describe(log: DataFrame, by: str = "module", value: str = "elapsed_time") -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return log.groupBy(by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lowest"),
        q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(value).alias("highest"),
    )


def percentile(log: DataFrame, p: float = 0.95, by: str = "module", value: str = "elapsed_time") -> DataFrame:
    return log.groupBy(by).agg(F.percentile(value, F.lit(p)).alias("p"))


def crosstab(log: DataFrame, rows: str, columns: str, value: str, names: Sequence | None = None) -> DataFrame:
    """Means of a value, a column for each of the names."""
    return log.groupBy(rows).pivot(columns, list(names) if names else None).agg(F.avg(value))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", False).option("escape", '"').csv(path)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("escape", '"').csv(path)


def run_experiments(spark, path: str, sizes: Iterable[tuple[int, DataFrame]], patterns: Iterable[tuple[float, object]], solvers: dict[str, Callable], repetitions: int = 1) -> DataFrame:
    """The log of every solver on every pattern and table: (size, places), (qualitative probability, pattern), name -> solver. A line is
    appended after each run, so that a stopped experiment keeps what it has; memory is the driver's heap in use, in bytes."""
    patterns = list(patterns)
    for n, poi in sizes:
        for k in range(repetitions):
            for i, (share, pattern) in enumerate(patterns):
                for name, solve in solvers.items():
                    began = time.perf_counter()
                    total = solve(poi, pattern).count()
                    took = time.perf_counter() - began
                    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
                    used = heap.totalMemory() - heap.freeMemory()
                    row = (k, i, pattern.to_json(), len(pattern.vertices), len(pattern.edges), pattern.exclusions, float(share), n, name, total, took, float(used))
                    append_log(spark.createDataFrame([row], LOG_SCHEMA), path)
    return read_log(spark, path)


def memory_of(log: DataFrame) -> DataFrame:
    """By solver: distinct table sizes, and the least, greatest and sum of memory."""
    return log.groupBy("module").agg(
        F.count_distinct("dataset_size").alias("sizes"), F.min("memory_usage").alias("least"), F.max("memory_usage").alias("most"), F.sum("memory_usage").alias("total")
    )


def pattern_keywords(log: DataFrame, column: str = "spatial_pattern") -> DataFrame:
    """Keywords named in pattern texts of the list dialect."""
    p = F.from_json(column, "vertices array<struct<id:string,keyword:string>>")
    return log.select(F.explode(F.transform(p["vertices"], lambda v: v["keyword"])).alias("keyword"))


def solutions_json(solutions: DataFrame, poi: DataFrame | None = None) -> DataFrame:
    """One JSON object for each solution: vertex -> id or, given the places, vertex -> {id, location, description}."""
    ids = solutions.columns
    if poi is None:
        return solutions.select(F.to_json(F.create_map(*(x for v in ids for x in (F.lit(v), F.col(f"`{v}`"))))).alias("solution"))
    # the payload of the places that occur, each once; joined where it is needed, as few rows of many places are
    used = solutions.select(F.explode(F.array_distinct(F.array(*(F.col(f"`{v}`") for v in ids)))).alias("osm_id")).distinct()
    about = poi.join(used, "osm_id", "left_semi").select("osm_id", F.struct(F.col("osm_id").alias("id"), F.struct("lon", "lat").alias("location"), description().alias("description")).alias("about"))
    about = about.persist(StorageLevel.MEMORY_AND_DISK)
    out = solutions
    for k, v in enumerate(ids):
        own = about.select(F.col("osm_id").alias(f"_k{k}"), F.col("about").alias(f"_a{k}"))
        out = out.join(own, F.col(f"`{v}`") == F.col(f"_k{k}"))
    out = out.select(F.to_json(F.create_map(*(x for k, v in enumerate(ids) for x in (F.lit(v), F.col(f"_a{k}"))))).alias("solution"))
    weakref.finalize(out, let_go, about)
    return out


def let_go(df: DataFrame) -> None:
    """Free what an answer held, if the session still runs."""
    try:
        df.unpersist()
    except Exception:  # noqa: BLE001 - the session has ended, and its tables with it
        pass


def write_solutions(solutions: DataFrame, path: str, poi: DataFrame | None = None) -> None:
    """A JSON line for each solution."""
    solutions_json(solutions, poi).withColumnRenamed("solution", "value").write.mode("overwrite").text(path)


def solutions_document(solutions: DataFrame, poi: DataFrame | None = None) -> str:
    """One document of all solutions, put together on the driver: for answers that fit there."""
    return '{"solutions":[' + ",".join(r[0] for r in solutions_json(solutions, poi).toLocalIterator()) + "]}"
