"""Sharding by sampled splitters.

Records are ordered by key: the checksum of the text, the id, and the number of the row in the staged table, so that
equal texts lie together and yet split when they are many, be their ids equal or null as well. A size-weighted sample
of keys gives quantile boundaries of many more ranges than shards; each row enters it on its own account, so its size is
about shards x ranges_per_shard x sample_per_range whatever repeats. Records are partitioned by
range; ranges whose exact bytes exceed the mean are subdivided at exact running sums; and the
pieces, whose number is bounded by the parameters, are placed largest first on the lightest shard.

Law kept: ``bytes``. Defined results: a null or empty text has size ``overhead``; a null id sorts before all others;
repeated rows, and rows with a null id, are records of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, stage, unit_hash


def record_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32): the narrow table that everything else works on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )


def rank(splits: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Number of splitters, given by sorted columns, that are no greater than each key, compared column by column."""
    lo, hi = (np.searchsorted(splits[0], keys[0], side) for side in ("left", "right"))
    if len(splits) == 1:
        return hi
    for value in np.unique(keys[0][lo < hi]):  # a splitter begins like these keys: compare what follows
        at = np.flatnonzero(keys[0] == value)
        a, b = int(lo[at[0]]), int(hi[at[0]])
        lo[at] = a + rank([c[a:b] for c in splits[1:]], [c[at] for c in keys[1:]])
    return lo


def _range_of(splits: list[tuple[int, ...]]):
    """Index of the range of a (checksum, id, row) key among sorted splitters."""
    cols = [np.array(x, np.int64) for x in (zip(*splits, strict=True) if splits else ((), (), ()))]

    @pandas_udf("int")
    def find(c: pd.Series, i: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(rank(cols, [x.to_numpy(np.int64) for x in (c, i, r)]).astype(np.int32))

    return find


def place(pieces: list[tuple], shards: int) -> list[tuple[int, int]]:
    """(shard, first slot) of each (bytes, rows, ...) piece: largest first onto the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    rows, out = [0] * shards, [(0, 0)] * len(pieces)
    for at in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        load, s = heapq.heappop(heap)
        out[at] = (s, rows[s])
        rows[s] += pieces[at][1]
        heapq.heappush(heap, (load + pieces[at][0], s))
    return out


def shard_records(sizes: DataFrame, shards: int = 40, ranges_per_shard: int = 50, sample_per_range: int = 8, id_col: str = "doc_id") -> DataFrame:
    """sizes (id, size, text_crc32) with ``shard`` and ``slot``."""
    spark, own = sizes.sparkSession, sizes.columns
    row, rng, part, nth, base = fresh(sizes, "row", "rng", "part", "nth", "base")
    sizes = stage(sizes.withColumn(row, F.monotonically_increasing_id()), "sizes")
    total = sizes.agg(F.sum("size")).first()[0]
    if not total:
        return sizes.select(*own, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    n_ranges = shards * ranges_per_shard
    quantum = total / n_ranges
    key = (F.col("text_crc32"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.col(row))
    # each record enters the sample with probability size / quantum * sample_per_range
    p = F.col("size") * F.lit(sample_per_range / quantum)
    picked = sizes.where(unit_hash(F.lit("splitter"), row) < p).select(*key, F.greatest(F.lit(1.0), p)).collect()
    picked = sorted((int(c), int(i), int(r), float(w)) for c, i, r, w in picked)
    run = np.cumsum([w for *_, w in picked]) if picked else np.zeros(0)
    cuts = np.searchsorted(run, np.arange(1, n_ranges) * (run[-1] / n_ranges)) if len(run) else []
    splits = sorted({picked[c][:3] for c in cuts})
    keyed = stage(sizes.withColumn(rng, _range_of(splits)(*key)), "ranges")
    # subdivide: pieces end where the running bytes of the range pass a multiple of the quantum
    order = ("text_crc32", id_col, row)
    w = Window.partitionBy(rng).orderBy(*order)
    before = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    cut = stage(keyed.withColumn(part, F.floor(before / F.lit(quantum)).cast("int")), "pieces")
    pieces = [tuple(r) for r in cut.groupBy(rng, part).agg(F.sum("size"), F.count("*")).sort(rng, part).collect()]
    at = place([(b, n) for _, _, b, n in pieces], shards)
    plan = spark.createDataFrame(
        [(r, q, s, f) for (r, q, *_), (s, f) in zip(pieces, at, strict=True)], f"{rng} int, {part} int, shard int, {base} long"
    )
    w = Window.partitionBy(rng, part).orderBy(*order)
    out = cut.drop("shard", "slot").withColumn(nth, F.row_number().over(w) - 1).join(F.broadcast(plan), [rng, part])
    return out.withColumn("slot", F.col(base) + F.col(nth)).select(*(c for c in own if c not in ("shard", "slot")), "shard", "slot")


def crc32_text(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
