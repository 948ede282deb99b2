"""Exact Jaccard self-join of documents on word shingles, as a join in a metric space.

Jaccard distance is a metric, and links are pairs within e = 1 - t of each other. Two documents that share no
shingle are at distance 1, and so almost all documents are equally far from almost all pivots; pivots say
something only about documents that share shingles with them. So regions are first laid by shingles: sorted in one
fixed order (what a sample shows to be repeated comes last), a linked pair has its first common shingle among the
first n - ceil(t n) + 1 of either, which makes one region of the documents that hold a shingle there. A pair
is sought in the region of its first common shingle alone. There:

1. Sizes differ little within a link: a region falls into size classes, and a document also enters the class below.
2. The first document of a class is its pivot. The distance used here is the symmetric difference of the two sets'
   counts over 256 classes of shingles, which is never more than that of the sets themselves. By the triangle
   inequality two linked documents differ in it by a bounded width: the region falls into rings of that width
   around the pivot, and a document also enters the ring below. Those near the pivot are compared with it exactly.
3. A ring with many documents in different components is divided into Voronoi regions, recursively: each document goes home to
   the nearest of several pivots, and is a guest in the region of every earlier pivot that is no more than twice its
   widest link farther than its own. Of two linked documents with different homes the one with the later home is
   a guest where the other lives: d(y, p) <= d(x, y) + d(x, p) <= d(x, y) + d(x, q) <= 2 d(x, y) + d(y, q). Documents near a pivot
   are compared with it exactly. Regions are divided again until they are small, or until dividing them no longer pays:
   documents that are about equally far from each other have no regions.
4. All pairs of a region that are still in different components and whose sizes, positions and counts allow a link
   are compared exactly, those of large regions by blocks.

Pairs already joined through others are not compared, so a group of near copies costs about one comparison a
document; no pair of documents in different components is left out. Equal shingle sets are joined once.

Defined results: a document without words, or with null text, has no shingles and is alone; one with fewer words
than ``k`` has its whole sequence as its one shingle; repeated rows have the same component, and
rows of one id with different texts each that of their text; a null id has a null component; an empty table gives no rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bits_at, chunks, components, drop, ids_bitmap, lean, mix, release, shingle_sets, spot, stage, unit_hash

PAIRS = "a long, b long"


LATE_BITS = 25


def late_shingles(docs: DataFrame, k: int, share: float = 1 / 4, most: int = 1 << 22) -> np.ndarray:
    """A packed bitmap, over the top bits of hashes, of the shingles that come last in the order: those found more than
    once in a share of the documents or, where these are more than ``most``, as many times as it takes. Only hashes of
    the lower half are counted, others being late anyway. The bitmap has a fixed size, and any bitmap gives the same
    links: what shares a bit with another shingle merely moves back in an order that is the same for all."""

    def run(batches):
        for batch in batches:
            for _, _, raw, off in chunks(batch, "text"):
                s, c = np.unique(np.concatenate([*shingle_sets(raw, off, k)]), return_counts=True)
                low = s < np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(s[low].view(np.int64)), pa.array(c[low])], ["s", "c"])

    few = docs.where(unit_hash(F.lit("late"), "id") < share).select("text")
    seen = stage(few.mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where("c > 1").select(F.shiftrightunsigned("s", 63 - LATE_BITS).alias("h"), F.least("c", F.lit(1000)).alias("c")), "late")
    total, least = 0, 1000
    for r in sorted(seen.groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["c"]):
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    out = bitmap(seen.where(F.col("c") >= least).select("h"), 1 << LATE_BITS)
    drop(seen)
    return out


def first_shingles(docs: DataFrame, k: int, num: int, den: int, late_bits: np.ndarray) -> DataFrame:
    """(id, n, f1, f2, sketch, prefix): size, fingerprint and class counts of each document's set, and its first
    shingles in the order."""
    held = docs.sparkSession.sparkContext.broadcast(late_bits)

    def run(batches):
        late = held.value
        for batch in batches:
            ids = batch.column(0)
            for i, j, raw, off in chunks(batch, "text"):
                n, f1, f2, sketch, first = [], [], [], [], []
                for s in shingle_sets(raw, off, k):
                    n.append(len(s))
                    m = mix(s)
                    f1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(np.bitwise_xor.reduce(m * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)) if len(s) else 0)
                    sketch.append(np.bincount((m >> np.uint64(56)).astype(np.int64), minlength=256).clip(0, 255).astype(np.uint8).tobytes())
                    keep = len(s) + num * len(s) // -den + 1 if len(s) else 0
                    if keep:
                        h = (s >> np.uint64(63 - LATE_BITS)).astype(np.int64)
                        low = h < 1 << LATE_BITS
                        h = np.where(low, h, 0)
                        often = low & bits_at(late, h)
                        s = np.concatenate([s[~often][:keep], s[often][: max(0, keep - int((~often).sum()))]])
                    first.append(s[:keep].view(np.int64))
                lens = np.array([len(x) for x in first])
                flat = np.concatenate(first) if first else np.zeros(0, np.int64)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.binary()), prefix], ["id", "n", "f1", "f2", "sketch", "prefix"])

    return docs.select("id", "text").mapInArrow(run, "id long, n int, f1 long, f2 long, sketch binary, prefix array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set): all shingles, sorted, as bytes, of every document of the ids and of some others: the ids are told by
    a bitmap of 16 MB at most, which executors can hold whatever the number of ids, so no text is shuffled."""
    bits, size = ids_bitmap(ids.select("id"))
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bits_at(held.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for i, j, raw, off in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(raw, off, k)], pa.binary())], ["id", "set"])

    return docs.where("id is not null").select("id", "text", spot(F.col("id"), size).alias("h")).mapInArrow(run, "id long, set binary")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Number of common elements of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def compare(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that are linked, from the whole sets."""

    def run(batches):
        for batch in lean(batches):
            linked = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = shared(x, y)
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, PAIRS)


def count_distance(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, far) of the pairs: the symmetric difference of their class counts."""

    def run(batches):
        for batch in lean(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64))], ["a", "b", "far"])

    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, f"{PAIRS}, far long")


def crowded_pairs(rows: DataFrame, area: list[str], width: float, chunk_rows: int = 2000) -> DataFrame:
    """(a, b) of the pairs of crowded areas whose sizes, positions and counts allow a link. Areas are dealt out by pairs
    of chunks of bounded size, and pairs are looked at by blocks within a task, so that only those that pass
    become rows. rows: area, m (rows of the area), rep, label, n, reach, away, sketch."""
    parts = F.ceil(F.col("m") / chunk_rows).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("p"), F.greatest("part", j).alias("q")))
    rows = rows.select(*area, "rep", "label", "n", "reach", "away", "sketch", "part", F.explode(both).alias("two")).select("*", "two.p", "two.q").drop("two")

    def run(f):
        a, b = [], []
        i, j = f[f.part == f.p.iloc[0]], f[f.part == f.q.iloc[0]]
        same = f.p.iloc[0] == f.q.iloc[0]
        sk = [np.frombuffer(b"".join(t.sketch), np.uint8).reshape(-1, 256) for t in (i, j)]
        few = [s.reshape(-1, 32, 8).sum(axis=2, dtype=np.int16) for s in sk]
        (ri, li, ni, ui, vi), (rj, lj, nj, uj, vj) = ([t[c].to_numpy() for c in ("rep", "label", "n", "reach", "away")] for t in (i, j))
        for x in range(0, len(i), 256):
            r = slice(x, min(x + 256, len(i)))
            ok = (li[r, None] != lj) & (nj <= ui[r, None]) & (ni[r, None] <= uj) & ((vi[r, None] & vj) == 0)
            if same:
                ok &= ri[r, None] < rj
            p, q = np.nonzero(ok)
            for y in range(0, len(p), 20_000):  # by sums of eight classes first, then by all
                s, t = p[y : y + 20_000] + x, q[y : y + 20_000]
                most = (ni[s].astype(np.int64) + nj[t]) * width + 1e-6
                near = np.abs(few[0][s] - few[1][t]).sum(axis=1) <= most
                s, t, most = s[near], t[near], most[near]
                near = np.abs(sk[0][s].astype(np.int16) - sk[1][t]).sum(axis=1) <= most
                a.append(ri[s[near]])
                b.append(rj[t[near]])
        if len(f) > 1000:
            del sk, few, i, j
            release()
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy(*area, "p", "q").applyInPandas(run, PAIRS)


def to_pivots(rows: DataFrame, area: list[str], pivots: int, seed: int, width: float) -> DataFrame:
    """rows (area, rep, label, n, reach, away, sketch) without sketches and with ``home``, the nearest of its area's pivots,
    ``guest``, the earlier ones in whose regions it may have a partner, and ``near``, the pivots with which it may be linked.
    An area has one row of pivots, which an ordinary join hands to its documents."""
    pick = lambda k: F.min_by(F.struct("rep", "label", "n", "reach", "sketch"), F.xxhash64("rep", F.lit(seed * pivots + k)))
    of = rows.groupBy(*area).agg(F.array(*map(pick, range(pivots))).alias("p"))
    own = [*area, "rep", "label", "n", "reach", "away"]

    def run(batches):
        for batch in lean(batches):
            b = batch.num_rows
            if not b:
                continue
            p = batch.column(batch.schema.get_field_index("p")).flatten()
            rep, label, n, reach = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("rep", "label", "n", "reach"))
            prep, plabel, pn, preach = (p.field(c).to_numpy(zero_copy_only=False).reshape(b, pivots) for c in ("rep", "label", "n", "reach"))
            x = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sketch")).to_pylist()), np.uint8).reshape(b, 1, 256).astype(np.int16)
            q = np.frombuffer(b"".join(p.field("sketch").to_pylist()), np.uint8).reshape(b, pivots, 256)
            d = np.stack([np.abs(x[:, 0] - q[:, k]).sum(axis=1, dtype=np.int64) for k in range(pivots)], axis=1)
            again = np.stack([(prep[:, :k] == prep[:, k : k + 1]).any(axis=1) for k in range(pivots)], axis=1)  # picked twice
            far = np.where(again, np.iinfo(np.int64).max // 4, d)
            home = far.argmin(axis=1)
            least = far[np.arange(b), home]
            guest = (np.arange(pivots) < home[:, None]) & (far <= (least + 2 * (n + reach) * width + 1e-6)[:, None])
            near = ~again & (plabel != label[:, None]) & (pn <= reach[:, None]) & (n[:, None] <= preach) & (d <= (n[:, None] + pn) * width + 1e-6)
            made = [pa.array(home, pa.int32()), pa.array([np.flatnonzero(g).tolist() for g in guest], pa.list_(pa.int32())), pa.array([r[m].tolist() for r, m in zip(prep, near, strict=True)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.select(own).columns, *made], [*own, "home", "guest", "near"])

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in own)
    return rows.join(of, area).select(*own, "sketch", "p").mapInArrow(run, f"{fields}, home int, guest array<int>, near array<long>")


def labelled(t: DataFrame, comp: DataFrame, col: str = "rep") -> DataFrame:
    """t with the component of one of its columns as ``label``."""
    c = comp.select(F.col("id").alias(col), F.col("component").alias("label"))
    return t.join(c, col, "left").withColumn("label", F.coalesce("label", col))


def row_key(id_col: str, text_col: str) -> F.Column:
    """A 64-bit hash of id and text, null where the id is."""
    return F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))))


def repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id has several rows."""
    return not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, crowd: int = 64, pivots: int = 8) -> DataFrame:
    """(id, n_shingles, component_id) of every document; links need intersection / union >= num / den."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not repeats(docs, "id"):
        out = components_of(docs, k, num, den, rounds, crowd, pivots, True)
    else:  # rows of one id may have different texts: each text has its own key
        keyed = docs.withColumn("key", row_key("id", "text"))
        found = components_of(keyed.select(F.col("key").alias("id"), "text"), k, num, den, rounds, crowd, pivots, False)
        found = stage(found.withColumnRenamed("id", "key").join(keyed.where("id is not null").select("key", "id").distinct(), "key", "left"), "keyed")
        least = found.where("id is not null").groupBy("component_id").agg(F.min("id").alias("least"))
        out = found.join(least, "component_id", "left").select("id", "n_shingles", F.col("least").alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def components_of(docs: DataFrame, k: int, num: int, den: int, rounds: int, crowd: int, pivots: int, single: bool) -> DataFrame:
    """(id, n_shingles, component_id) of docs (id, text), in which an id has one text, and one row if ``single``."""
    first = stage(first_shingles(docs, k, num, den, late_shingles(docs, k)), "first")
    group = ["n", "f1", "f2"]
    reps = stage(first.where("n > 0 and id is not null").groupBy(*group).agg(F.min("id").alias("rep")), "reps")
    posts = first.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select(
        F.col("id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "s")
    )

    # regions by first shingles; one with a single document ends here
    posts = stage(posts, "posts")
    me = F.struct("rep", "n", "pos")
    heads = posts.groupBy("s").agg(F.min(me).alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    rows = stage(posts.join(heads.select("s"), "s", "left_semi").select("s", "rep", "n", "pos"), "regions")
    drop(posts)

    # size classes; in each, what may have a partner by size and by the position of the shingle
    base = den / num * (1 + 1e-9)
    share, width = num / (num + den), (den - num) / (den + num)
    level = F.floor(F.log("n") / float(np.log(base))).cast("int")
    rows = rows.withColumn("reach", (F.col("n") - F.col("pos")) / share - F.col("n") + 1e-6)  # the largest partner
    rows = rows.select("*", F.explode(F.array(level, level - 1)).alias("level")).withColumn("above", level != F.col("level"))
    area = ["s", "level"]
    seen = rows.groupBy(*area).agg(
        F.count("*").alias("m"), F.min("n").alias("low"), F.max("reach").alias("high"), F.sum("n").alias("sn"), F.sum("reach").alias("sr"), F.min(F.col("above")).alias("none")
    ).where("m > 1 and not none")
    other_n = F.when(F.col("m") == 2, F.col("sn") - F.col("n")).otherwise(F.col("low"))
    other_r = F.when(F.col("m") == 2, F.col("sr") - F.col("reach")).otherwise(F.col("high"))
    rows = rows.join(seen, area).where((other_n <= F.col("reach")) & (F.col("n") <= other_r + 1e-6)).select("s", "level", "above", "rep", "n", "pos", "reach")
    rows = stage(rows, "classes")
    head = rows.groupBy(*area).agg(F.min(F.struct("rep", "n", "pos", "reach")).alias("p"), F.count("*").alias("m")).where("m > 1").drop("m")
    rows = rows.join(head, area)
    away = rows.where("rep <> p.rep").select(F.col("rep").alias("a"), F.col("p.rep").alias("b")).distinct()
    once = lambda t: t if single else t.dropDuplicates(["id"])
    sketches = once(first.select("id", "sketch"))
    away = stage(count_distance(away, sketches), "distances")
    rows = rows.withColumn("b", F.col("p.rep")).join(away.withColumnRenamed("a", "rep"), ["rep", "b"], "left").withColumn("far", F.coalesce("far", F.lit(0)))
    fit = lambda x, y: (F.col(f"{y}n") <= F.col(f"{x}reach")) & (F.col(f"{x}n") <= F.col(f"{y}reach"))
    close = lambda x, y: F.col("far") <= (F.col(f"{x}n") + F.col(f"{y}n")) * width + 1e-6
    star = rows.where((F.col("rep") != F.col("b")) & fit("", "p.") & close("", "p.")).select(F.col("rep").alias("a"), "b").distinct()

    def link(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        sets = stage(whole_sets(docs, ids, k), "sets")
        found = stage(compare(pairs, once(sets), num, den), "links")
        drop(sets)
        return found

    links = link(star)
    comp = stage(components(links), "comp")

    # rings around the pivots: the width is what a link between the greatest sizes of a class may span
    most = F.pow(F.lit(base), F.col("level") + 2) * 2 * width + 1
    ring = F.floor(F.col("far") / most).cast("int")
    here = rows.select(*area, "above", "rep", "n", "reach", ring.alias("home"))
    here = here.select(*area, "above", "rep", "n", "reach", F.explode(F.when(F.col("home") > 0, F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array("home"))).alias("ring"), "home")
    # a bit for each division in which the document is not at home: two that share one are compared elsewhere
    away = F.col("above").cast("long") + F.when(F.col("home") != F.col("ring"), 2).otherwise(0)
    area += ["ring", "cell"]
    here = stage(here.select(*area[:-1], F.lit(0).cast("long").alias("cell"), "rep", "n", "reach", away.cast("long").alias("away")), "rings")

    def still_open(t: DataFrame) -> DataFrame:
        """The rows of areas with several components, with label and m, the area's rows."""
        lab = labelled(t.select(*area, "rep", "n", "reach", "away"), comp)
        several = lab.groupBy(*area, "label").agg(F.count("*").alias("c")).groupBy(*area).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).where("m * m > q")
        return stage(lab.join(several.select(*area, "m"), area), "open")

    def near_pairs(pairs: DataFrame) -> DataFrame:
        """(a, b) of pairs (a, b, both: the sum of their sizes) whose counts allow a link."""
        near = count_distance(pairs.select("a", "b"), sketches).join(pairs, ["a", "b"]).where(F.col("far") <= F.col("both") * width + 1e-6)
        return near.select("a", "b")

    for turn in range(rounds):
        # one more pivot for each ring; only documents of other components are compared with it
        lab = still_open(here)
        pick = F.min_by(F.struct("rep", "label", "n", "reach"), F.xxhash64("rep", F.lit(turn)))
        more = lab.join(lab.groupBy(*area).agg(pick.alias("p")), area).where((F.col("label") != F.col("p.label")) & fit("", "p."))
        pairs = stage(more.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"), (F.col("n") + F.col("p.n")).alias("both")).distinct(), "cross")
        links = links.unionByName(link(near_pairs(pairs)))
        drop(pairs)
        drop(lab)
        comp = stage(components(links), "comp")

    # Voronoi regions of what is large
    small, blocks, depth = [], [], 0
    lab = still_open(here)
    while True:
        small.append(lab.where(F.col("m") <= crowd))
        large = lab.where(F.col("m") > crowd)
        if large.isEmpty():
            break
        seen = stage(to_pivots(large.join(sketches.withColumnRenamed("id", "rep"), "rep").select(*area, "rep", "label", "n", "reach", "away", "sketch"), area, pivots, depth, width), "pivots")
        starred = seen.select("rep", F.explode("near").alias("p")).select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()
        links = links.unionByName(link(starred))
        comp = stage(components(links), "comp")
        every = seen.select(*area, "rep", "n", "reach", "away", "home", F.explode(F.concat(F.array("home"), "guest")).alias("region"))
        sizes = every.groupBy(*area, "region").agg(F.count("*").alias("c"), F.count_if(F.col("region") == F.col("home")).alias("own"))
        sizes = sizes.groupBy(*area).agg(F.sum(F.col("c") * F.col("c")).alias("after"), F.sum("own").alias("m"))
        pays = F.col("after") <= 0.6 * F.col("m") * F.col("m")  # dividing must save two fifths of the pairs
        bit = 1 << (depth + 2) if depth < 61 else 0  # without a bit a pair may be compared twice, which does no harm
        guest = F.when(F.col("region") != F.col("home"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long"))
        parts = every.join(sizes.where(pays).select(*area), area).select(
            *area[:-1], F.xxhash64("cell", "region").alias("cell"), "rep", "n", "reach", F.col("away").bitwiseOR(guest).alias("away")
        )
        blocks.append(large.join(sizes.where(~pays).select(*area), area, "left_semi"))
        depth += 1
        lab = still_open(parts)

    # what is left is compared by pairs of rows in small regions, and by blocks in large ones
    few = still_open(reduce(DataFrame.unionByName, small))
    x, y = few.alias("x"), few.alias("y")
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in area]
    meet += [F.col("x.rep") < F.col("y.rep"), F.col("x.label") != F.col("y.label"), fit("x.", "y."), F.col("x.away").bitwiseAND(F.col("y.away")) == 0]
    pairs = x.join(y, meet).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both"))
    near = near_pairs(stage(pairs.distinct(), "cross"))
    if blocks:
        full = still_open(reduce(DataFrame.unionByName, blocks)).join(sketches.withColumnRenamed("id", "rep"), "rep")
        near = near.unionByName(crowded_pairs(full, area, width)).distinct()
    comp = stage(components(links.unionByName(link(near))), "comp")

    # back to all documents
    of_set = labelled(reps, comp).select(*group, F.col("label").alias("component_id"))
    out = first.select("id", *group).join(of_set, group, "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
