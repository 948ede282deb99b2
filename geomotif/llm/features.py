"""Hashed byte n-gram features of whole texts, and binary linear classifiers trained on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, chunks

BUCKETS = 4096


def ngram_counts(raw: np.ndarray, off: np.ndarray, orders: tuple[int, ...], buckets: int = BUCKETS) -> np.ndarray:
    """Counts (documents x buckets) of the hashed byte n-grams of each document; A-Z are lower-cased
    and a run of white space counts as it stands."""
    raw = ascii_lower(raw)
    docs = len(off) - 1
    out = np.zeros(docs * buckets, np.float32)
    x = raw.astype(np.uint32)
    n = len(x)
    doc = np.repeat(np.arange(docs, dtype=np.int64) * buckets, np.diff(off))
    end = np.repeat(off[1:], np.diff(off))
    at = np.arange(n)
    h = np.zeros(n, np.uint32)
    for k in range(1, max(orders) + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (x[k - 1 :][:m] + np.uint32(1))
        if k in orders:
            b = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(buckets).bit_length() + 1)
            whole = at[:m] + k <= end[:m]
            out += np.bincount((doc[:m] + b)[whole], minlength=docs * buckets)
    return out.reshape(docs, buckets)


def normalise(counts: np.ndarray) -> np.ndarray:
    """Square roots, scaled to unit length; empty documents stay zero."""
    x = np.sqrt(counts)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def feature_chunks(batch: pa.RecordBatch, col: str, orders: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, past last row, features, bytes, offsets), at most 128 rows and 0.5 MB of text or one row."""
    for i, j, raw, off in chunks(batch, col, 1 << 19):
        for a in range(0, j - i, 128):
            b = min(a + 128, j - i)
            part = raw[off[a] : off[b]]
            o = off[a : b + 1] - off[a]
            yield i + a, i + b, normalise(ngram_counts(part, o, orders)), part, o


def least_keys(rows: DataFrame, most: int) -> dict:
    """rows (y, h): for each label y the ``most``-th smallest distinct h, or the greatest where there are fewer. What
    reaches the driver is one number a label; no label meets in one task beyond ``most`` rows from each."""
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()}
    near = F.lit(False)
    for y, n in sizes.items():  # some twice as many as needed, by the hash itself, before anything is sorted
        share = 2.5 * most / n
        near = near | ((F.col("y") == y) & (F.lit(True) if share >= 1 else F.col("h") <= int(share * (1 << 64)) - (1 << 63)))
    w = Window.partitionBy("y").orderBy("h")
    few = rows.where(near).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return {r["y"]: r["h"] for r in few.groupBy("y").agg(F.max("h").alias("h")).collect()}


def chosen(keys: dict, y: str = "y", h: str = "h") -> Column:
    """Whether a row is among the least of its label."""
    out = F.lit(False)
    for name, key in sorted(keys.items(), key=lambda x: str(x[0])):
        out = out | ((F.col(y) == name) & (F.col(h) <= key))
    return out


def sample_features(df: DataFrame, text_col: str, label: Column, key: Column, per_label: int, orders: tuple[int, ...]) -> tuple[np.ndarray, list]:
    """Features and labels of at most per_label rows of each label, those with the least hashes of key and text; rows
    without a label or a text are left out, and of rows of equal label, key and text one counts, so neither repeated rows nor
    rows without a key pass the bound: per_label x labels x 2 x BUCKETS bytes reach the driver."""
    rows = df.select(F.col(text_col).alias("t"), label.alias("y"), F.xxhash64(F.lit("sample"), key, text_col).alias("h")).where("y is not null and t is not null")
    keys = least_keys(rows.select("y", "h"), per_label)
    if not keys:
        return np.zeros((0, BUCKETS), np.float32), []

    def run(batches):
        seen = set()  # as many as the bound at most
        for batch in batches:
            marks = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = [m not in seen and not seen.add(m) for m in marks]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for i, j, x, _, _ in feature_chunks(batch, "t", orders):
                blob = [r.astype(np.float16).tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(blob, pa.binary()), batch.column(2).slice(i, j - i)], ["y", "x", "h"])

    found = rows.where(chosen(keys)).select("t", "y", "h").mapInArrow(run, f"y {dict(rows.dtypes)['y']}, x binary, h long")
    got = sorted(found.dropDuplicates(["y", "h"]).collect(), key=lambda r: (r["h"], str(r["y"])))
    return np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in got]) if got else np.zeros((0, BUCKETS), np.float32), [r["y"] for r in got]


def fit_binary(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, steps: int = 150, rate: float = 12.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and biases of logistic classifiers for targets of -1 and 1, by
    accelerated full-batch gradient steps from zero, so that equal samples give equal models."""
    n, d = x.shape
    k = target.shape[1]
    w, b = np.zeros((d, k), np.float32), np.zeros(k, np.float32)
    vw, vb = w.copy(), b.copy()
    share = (np.ones(n) if weight is None else weight).astype(np.float32)
    share = (share / share.sum())[:, None]
    for t in range(steps):
        m = t / (t + 3)
        lw, lb = w + m * vw, b + m * vb
        f = x @ lw + lb
        g = -target * share / (1 + np.exp(np.clip(target * f, -50, 50)))
        vw, vb = lw - rate * (x.T @ g + decay * lw) - w, lb - rate * g.sum(axis=0) - b
        w, b = w + vw, b + vb
    return w.astype(np.float32), b.astype(np.float32)
