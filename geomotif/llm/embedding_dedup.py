"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c are within squared distance 2 - 2c. Rotated vectors are cut into ``blocks`` of
dimensions; by the pigeonhole principle a pair within the whole budget is, in one block at least, within that
block's proportional share of it. So each block is range-joined alone: its first ``axes`` coordinates lay a grid
whose cells are twice the block's radius wide, a vector near a lower border also enters the cell below, and
each pair meets in one cell. There the blocks are compared by matrix products; every candidate is then verified
exactly, by cosine in double precision of the vectors as given, and is counted in the first block whose budget
it meets, so each link counts once. A cell gives one count for each vector and a spanning forest of the links
found, never all pairs. That is why whole vectors are carried to the cells (as four bytes a component where they came so).

Equal vectors are joined once, as one with a multiplicity. Cells above ``cell_rows`` are split into chunks and
joined chunk by chunk. Vectors link only within their label and length. Defined results: vectors that are null,
zero or hold null or non-finite components, or have no label, link with nothing and are their own component;
repeated rows of an id are copies of each other; rows with a null id link as all others do, are not kept, and don't name a
component: its name is the smallest id that isn't null, or null where it has none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, stage

SLACK = 1e-9  # on budgets, for rounding


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def cuts(d: int, blocks: int) -> np.ndarray:
    """Block borders of d dimensions."""
    return np.linspace(0, d, min(blocks, d) + 1).round().astype(int)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spots(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Coordinates a to b - 1 of rotated unit vectors, summed row by row, so that they are the same bits in every batch."""
    r = rotation(x.shape[1])[:, a:b].T
    return np.stack([(x * axis).sum(axis=1) for axis in r], axis=1)


def cell_keys(x: np.ndarray, cosine: float, blocks: int, axes: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, rows, cells) of every placing of unit vectors; a cell is its coordinates in one number."""
    d = x.shape[1]
    edge, budget, out = cuts(d, blocks), 2 - 2 * cosine + SLACK, []
    for k in range(len(edge) - 1):
        r = np.sqrt(budget * (edge[k + 1] - edge[k]) / d)
        home = spots(x, edge[k], min(edge[k] + axes, edge[k + 1]))
        width = 2 * r
        hi = np.floor(home / width).astype(np.int64)
        lo = np.floor((home - r * (1 + 1e-9)) / width).astype(np.int64)
        for pick in range(1 << home.shape[1]):  # on which axes the cell below is entered
            use = np.array([pick >> a & 1 for a in range(home.shape[1])], bool)
            rows = np.flatnonzero((lo < hi)[:, use].all(axis=1))
            c = np.where(use, lo[rows], hi[rows])
            out.append((k, rows, np.ravel(c @ (1 << (20 * np.arange(home.shape[1]))))))
    return out


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of root, in which each node points at its root, along the links i - j: the smaller root stays."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def join_cell(weight: np.ndarray, v: np.ndarray, block: int, cell: int, side: np.ndarray, cosine: float, blocks: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of linked vectors, first row of the local component) of each row of one cell. side: 0 for rows
    compared with each other, 1 and 2 for rows compared across only."""
    n, d = v.shape
    links, root = np.zeros(n, np.int64), np.arange(n)
    x = units(v)
    rot = x @ rotation(d)
    edge, budget = cuts(d, blocks), 2 - 2 * cosine + SLACK
    share = budget * np.diff(edge) / d
    home = spots(x, edge[block], min(edge[block] + axes, edge[block + 1]))
    cells = np.floor(home / (2 * np.sqrt(share[block]))).astype(np.int64)
    own = rot[:, edge[block] : edge[block + 1]]
    sq = (own * own).sum(axis=1)
    exact, known = np.zeros((n, edge[block + 1])), np.zeros(n, bool)  # of the rows that have links
    for a in range(0, n, 512):
        left = slice(a, min(a + 512, n))
        for b in range(a, n, 2048):
            right = slice(b, min(b + 2048, n))
            dist = sq[left, None] + sq[None, right] - 2 * own[left] @ own[right].T
            i, j = np.nonzero(dist <= share[block] + 1e-9)  # a little wide; the blocks' distances decide below
            i, j = i + a, j + b
            keep = i < j
            keep &= (side[i] == 0) | (side[i] != side[j])
            i, j = i[keep], j[keep]
            # the pair's meeting cell is the lower of its home cells on each axis
            low = np.minimum(cells[i], cells[j]) @ (1 << (20 * np.arange(home.shape[1])))
            i, j = i[low == cell], j[low == cell]
            for s in range(0, len(i), 100_000):
                p, q = i[s : s + 100_000], j[s : s + 100_000]
                near = (x[p] * x[q]).sum(axis=1) >= cosine
                p, q = p[near], q[near]
                # counted in the first block whose share it keeps; of the shares' sum one at least is kept
                new = np.unique(np.concatenate([p, q]))
                new = new[~known[new]]
                exact[new], known[new] = spots(x[new], 0, edge[block + 1]), True
                e = np.add.reduceat((exact[p] - exact[q]) ** 2, edge[: block + 1], axis=1)
                here = (e[:, block] <= share[block]) & (e[:, :block] > share[:block]).all(axis=1)
                p, q = p[here], q[here]
                links += np.bincount(p, weight[q], n).astype(np.int64) + np.bincount(q, weight[p], n).astype(np.int64)
                merge(root, p, q)
    return links, root


def link_embeddings(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, blocks: int = 8, axes: int = 2, cell_rows: int = 4000) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    value = F.col("vec")
    sound = F.coalesce(
        F.col("label").isNotNull() & (F.size(value) > 0)
        & F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(value, lambda x: x != 0),
        F.lit(False),
    )
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = rows.withColumn("key", F.when(sound, F.transform(value, lambda x: x.cast(kind) + F.lit(0).cast(kind))))
    # equal vectors become one, with a number of its own and the smallest of their ids
    once = rows.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    once = stage(once.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    def place(batches):
        for batch in batches:
            vecs = batch.column(1)
            size = vecs.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = units(np.array(vecs.take(pa.array(at)).flatten(), np.float64).reshape(-1, d))
                for k, hit, cells in cell_keys(x, cosine, blocks, axes):
                    if len(hit):
                        part = batch.take(pa.array(at[hit]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(hit), k, np.int32)), pa.array(cells)], ["label", "key", "rep", "copies", "block", "cell"])

    placed = once.select("label", "key", "rep", "copies").mapInArrow(place, f"label string, key array<{kind}>, rep long, copies long, block int, cell long")
    placed = placed.withColumn("dim", F.size("key"))
    cell = ["label", "dim", "block", "cell"]
    full = placed.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / cell_rows).cast("int"))
    placed = placed.join(full.select(*cell, "chunks"), cell)
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("chunk"), j).alias("c1"), F.greatest(F.col("chunk"), j).alias("c2")))
    placed = placed.withColumn("chunk", chunk).withColumn("pair", F.explode(pairs))
    placed = placed.select(*cell, F.col("pair.c1").alias("c1"), F.col("pair.c2").alias("c2"), F.when(F.expr("pair.c1 = pair.c2"), 0).when(F.expr("chunk = pair.c1"), 1).otherwise(2).alias("side"), "rep", "copies", "key")

    def join(f: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(f["key"].to_numpy()).astype(np.float64)
        ids = f["rep"].to_numpy(np.int64)
        links, first = join_cell(f["copies"].to_numpy(np.int64), v, int(f["block"].iloc[0]), int(f["cell"].iloc[0]), f["side"].to_numpy(), cosine, blocks, axes)
        hit = links > 0
        return pd.DataFrame({"rep": ids[hit], "links": links[hit], "with": ids[first[hit]]})

    found = stage(placed.groupBy(*cell, "c1", "c2").applyInPandas(join, T.StructType([T.StructField(c, T.LongType()) for c in ("rep", "links", "with")])), "links")
    comp = components(found, "rep", "with").withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = once.select("label", "key", "rep", "copies", "low").join(links, "rep", "left").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of_rep = stage(of_rep, "classes")
    names = of_rep.groupBy("component").agg(F.min("low").alias("component_id"))
    of_rep = of_rep.join(names, "component").select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    good = rows.where("key is not null").join(of_rep, ["label", "key"]).select("id", "n_links", "component_id")
    rest = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
