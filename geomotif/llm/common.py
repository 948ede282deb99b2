"""Shared parts: staged tables in the shared folder, text kernels, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


# ---- tables -----------------------------------------------------------------------------------


def small_batches(spark: SparkSession, rows: int = 4000, size: int = 1 << 20) -> None:
    """Rows hold whole texts: Arrow batches limited in bytes bound what executors hold outside the heap."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key, str(1 << 30)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a session within one process has a folder of its own;
    on a cluster no folder of one machine would do, and that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="geomotif-")
        shared_dir.own = at
    return at.rstrip("/")


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors cost no rerun. The files go
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geomotif-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    where, fs = _files(spark, path)
    fs.deleteOnExit(where)
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "staged_at", None)
    if path:
        where, fs = _files(df.sparkSession, path)
        fs.delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that the table has already."""
    out = []
    for n in names:
        while n in df.columns or n in out:
            n += "_"
        out.append(n)
    return out


def unit_hash(*cols) -> F.Column:
    """A uniform double in [0, 1) from a 64-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def bit_rows(numbers: DataFrame) -> DataFrame:
    """(b, m): the numbers of the first column, from 0 on, as bits; a row has 4096 bytes for the 32768 numbers from 32768 b on."""
    h = F.col(numbers.columns[0]) + 1  # the aggregates count from 1 on
    at = numbers.select(h.alias("h")).groupBy((F.expr("bitmap_bucket_number(h)") - 1).alias("b"))
    return at.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m"))


def bitmap(numbers: DataFrame, size: int) -> np.ndarray:
    """Packed bits of the numbers 0 .. size - 1 in the first column, put together by native aggregates: what
    reaches the driver is size / 8 bytes at most."""
    out, width = np.zeros(-(-size // 32768) * 4096, np.uint8), 4096
    for r in bit_rows(numbers).toLocalIterator():
        out[r["b"] * width : (r["b"] + 1) * width] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out[: -(-size // 8)]


def bits_at(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


MOST_BITS = 1 << 27  # of a bitmap of ids: 16 MB, which is what is broadcast at most


def spot(col, size: int) -> F.Column:
    """The place of an id in a bitmap of ``size`` bits, a power of two."""
    return F.xxhash64(F.lit("spot"), col).bitwiseAND(size - 1)


def bits_for(ids: DataFrame) -> int:
    """Bits of a bitmap of the ids in the first column, a power of two: sixteen an id up to MOST_BITS. It lets all ids pass,
    and of others about one in sixteen; with so many ids that the greatest size fills up, more."""
    n = ids.agg(F.approx_count_distinct(ids.columns[0])).first()[0]
    return min(MOST_BITS, 1 << max(18, (16 * n - 1).bit_length()))


def ids_bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap, its bits) of the ids in the first column."""
    size = bits_for(ids)
    return bitmap(ids.select(spot(F.col(ids.columns[0]), size)), size), size


def without(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose col is none of the ids (one column), a null included. Wide rows are not shuffled: a bitmap of the
    ids, 16 MB at most, lets all pass that are surely not among them, and only the others are joined. The bitmap is looked
    up by a broadcast join, natively: no text goes through a Python worker for it."""
    gone = ids.select(F.col(ids.columns[0]).alias(col)).where(F.col(col).isNotNull())
    h, b, m = fresh(rows, "h", "b", "m")
    size = bits_for(gone)
    bits = stage(bit_rows(gone.select(spot(F.col(col), size))), "bits").select(F.col("b").alias(b), F.col("m").alias(m))
    marked = rows.withColumn(h, spot(F.col(col), size)).join(F.broadcast(bits), F.shiftright(h, 15) == F.col(b), "left")
    byte = F.conv(F.hex(F.substring(m, F.shiftright(h, 3).bitwiseAND(4095).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_bit = F.getbit(byte, F.col(h).bitwiseAND(7).cast("int")) == 1
    hit = F.col(col).isNotNull() & F.coalesce(set_bit, F.lit(False))
    stay = marked.where(~hit).select(*rows.columns)
    return stay.unionByName(marked.where(hit).select(*rows.columns).join(gone.distinct(), col, "left_anti").select(*rows.columns))


# ---- memory of Python workers -------------------------------------------------------------------

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def release() -> None:
    """Gives the process's freed memory back to the system. Workers stay for the tasks to come, several to an executor, and
    else keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(batches: Iterable) -> Iterator:
    """The batches; freed memory is released after each."""
    for batch in batches:
        yield batch
        del batch
        release()


# ---- bytes of Arrow text columns ---------------------------------------------------------------


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, col: str, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) with at most max_bytes of text, or one row."""
    raw, off = text_bytes(batch.column(batch.schema.get_field_index(col)))
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    del raw, off
    release()


# ---- word and shingle hashes -------------------------------------------------------------------

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 18) + 1
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * _STEP
    x = x ^ (x >> U64(29))
    x = x * _BASE
    return x ^ (x >> U64(32))


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document) of the runs of bytes other than 0x20 and 0x09-0x0D."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:n]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    p, q = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * p[: len(raw)], out=total[1:])
    return mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of the k-word shingles of each document, of its whole
    word sequence where that is shorter, or an empty array where it has no word."""
    raw = ascii_lower(raw)
    s, e, first = words(raw, off)
    w = word_hashes(raw, s, e)
    n = len(w)
    acc = mix(w + U64(k))
    for j in range(1, k):
        nxt = np.zeros(n, np.uint64)
        nxt[: max(0, n - j)] = w[j:]
        acc = mix(acc * _BASE + nxt)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        m = b - a
        if m >= k:
            yield np.unique(acc[a : b - k + 1])
        elif m:
            h = mix(w[a : a + 1] + U64(m))
            for j in range(1, m):
                h = mix(h * _BASE + w[a + j : a + j + 1])
            yield h
        else:
            yield np.zeros(0, np.uint64)


# ---- connected components ----------------------------------------------------------------------


def _forest(batches):
    """(id, component) of all edges of one task."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        top = i
        while root[top] != top:
            top = root[top]
        while root[i] != top:
            root[i], i = top, root[i]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    ids = list(root)
    release()
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], ["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = 300_000) -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id reachable.

    Rounds over the edge table, each written to the shared folder. In a round every task replaces its edges, at most
    about ``task_edges``, by their own forest; then large-star and small-star steps move edges towards smaller ids. Rounds end
    when one task holds all edges, whose forest is the answer, or nothing changes any more. A
    vertex with many edges is reduced by a partial minimum before the shuffle, and the join that
    hands the minimum back is one that adaptive execution can split.
    """
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc"
    )

    def mark(t: DataFrame) -> tuple:
        r = t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = mark(now)
    while before[0] > task_edges:
        parts = -(-before[0] // task_edges)
        local = now.repartition(parts, F.xxhash64("u")).mapInArrow(_forest, "u long, v long").where("u <> v")
        now, last = stage(local, "cc"), now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every edge points from the larger id to the smaller one
        low = large.distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        new = stage(small, "cc")
        after = mark(new)
        drop(now)
        drop(last)
        now = new
        if after == before:
            break
        before = after
    else:
        return now.coalesce(1).mapInArrow(_forest, "id long, component long")
    out = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return out.unionByName(roots)


__all__ = [n for n in dir() if not n.startswith("_")] + ["Window"]
