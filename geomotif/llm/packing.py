"""Best-fit packing by the linear grouping scheme.

Documents become token pieces of at most ``capacity``; full pieces fill a sequence alone. Of the rest only
the histogram of lengths (at most ``capacity`` numbers) reaches the driver. There the large lengths are
rounded up within groups of equal cardinality, the cutting-stock programme over those few sizes is solved
by column generation, its whole part is filled with the actual lengths of each group, and what remains is
placed by best fit, longest first. The plan says for each length which rank goes to which sequence and
offset, and its size depends on the capacity only; executors rank the pieces of a length and look it up. Sequences of one
full piece have negative numbers.

Defined results: a null or empty text is the end id alone, one piece; only documents longer than the capacity
are cut, the first piece taking the remainder; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage
from .tokens import encoder

END_ID = 2


# ---- pieces ------------------------------------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, after a shorter first one where needed."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(df: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, added: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; path and added as in encoder."""

    def run(batches):
        enc, _ = encoder(path, added)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = np.array([*enc(texts[i].as_py() or ""), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            own = batch.column(batch.schema.get_field_index(id_col)).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the plan, on the driver, from the histogram alone -----------------------------------------


def groups_of(counts: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Lengths from the longest down, dealt into groups of equal cardinality; a length may be in two."""
    total = sum(counts.values())
    per = max(1, -(-total // n_groups))
    out, room = [[]], per
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = per
            take = min(left, room)
            out[-1].append((length, take))
            left -= take
            room -= take
    return [g for g in out if g]


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[float, np.ndarray]]:
    """Amounts and patterns of a linear programme that covers the demand of each size with fewest bins."""
    k, s = len(sizes), np.array(sizes)
    patterns = np.diag((capacity // s).astype(float))
    inverse = np.diag(1.0 / np.diag(patterns))
    amounts = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fit = s <= c
            v = np.where(fit, best[np.maximum(c - s, 0)] + price, -1.0)
            i = int(v.argmax())
            best[c], last[c] = (v[i], i) if v[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= int(s[last[c]])
        move = inverse @ column
        ok = move > 1e-10
        ratio = np.where(ok, amounts / np.where(ok, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amounts = np.maximum(amounts - step * move, 0)
        amounts[out] = step
        patterns[:, out] = column
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
    return [(float(a), patterns[:, i].astype(int)) for i, a in enumerate(amounts) if a > 1e-9]


def substitute(slots: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """Actual lengths for the slots of a configuration: the longest left that is within each slot, and for
    the last slot the longest left that the room allows."""
    use: dict[int, int] = defaultdict(int)
    room = capacity
    for k, slot in enumerate(slots):
        most = room if k == len(slots) - 1 else slot
        while most and left.get(most, 0) <= use.get(most, 0):
            most -= 1
        if most:
            use[most] += 1
            room -= most
    return use


def plan_packing(counts: dict[int, int], capacity: int = 1024, n_groups: int = 128, small: float = 1 / 3) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences as (how many, [(length, how many of it)]): all of counts, each sequence within capacity."""
    counts = {length: n for length, n in counts.items() if n}
    bins: list[tuple[int, list[tuple[int, int]], int]] = []  # number, content, room
    if full := counts.pop(capacity, 0):
        bins.append((full, [(capacity, 1)], 0))
    large = {length: n for length, n in counts.items() if length > capacity * small}
    left = dict(counts)
    if large:
        groups = groups_of(large, n_groups)
        sizes, merged = [], []
        for g in groups:  # groups with the same largest length are one size
            if sizes and sizes[-1] == g[0][0]:
                merged[-1] += g
            else:
                sizes.append(g[0][0])
                merged.append(list(g))
        demand = np.array([sum(n for _, n in g) for g in merged], float)
        for amount, pattern in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[0]):
            todo = int(amount + 1e-6)
            slots = [sizes[i] for i in np.flatnonzero(pattern) for _ in range(int(pattern[i]))]
            while todo > 0 and (use := substitute(slots, left, capacity)):
                times = min(todo, *(left[length] // k for length, k in use.items()))
                bins.append((times, sorted(use.items(), reverse=True), capacity - sum(x * n for x, n in use.items())))
                for length, k in use.items():
                    left[length] -= k * times
                todo -= times
    return best_fit(bins, left, capacity)


def best_fit(bins: list[tuple[int, list[tuple[int, int]], int]], left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Place what is left, longest first, each where the least room remains."""
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for n, content, room in bins:
        by_room[room].append((n, content))
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        room = length
        while n:
            while room <= capacity and not by_room.get(room):
                room += 1
            if room > capacity:
                each = min(n, capacity // length)
                whole = n // each
                by_room[capacity - each * length].append((whole, [(length, each)]))
                if rest := n - whole * each:
                    by_room[capacity - rest * length].append((1, [(length, rest)]))
                break
            have, content = by_room[room].pop()
            each = min(n, room // length)
            whole = min(have, n // each)
            if have > whole:
                by_room[room].append((have - whole, content))
            by_room[room - each * length].append((whole, [*content, (length, each)]))
            n -= whole * each
    return [(n, content) for room in sorted(by_room) for n, content in by_room[room]]


def lookup(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first sequence, pieces in each, offset of the first of them."""
    rows, ranks, first = defaultdict(list), defaultdict(int), 0
    for n, content in plan:
        offset = 0
        for length, each in content:
            rows[length].append((ranks[length], first, each, offset))
            ranks[length] += n * each
            offset += length * each
        first += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


# ---- placing -----------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id", task_rows: int = 1_000_000) -> DataFrame:
    """pieces (with id, piece and length) with ``sequence_id`` and ``offset``. Full pieces are sequences by themselves and
    are neither ranked nor shuffled; those of another length are ranked in parts of about task_rows, however many share it."""
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row, salt, nth = fresh(pieces, "row", "salt", "nth")
    pieces = stage(pieces.select(*own, F.monotonically_increasing_id().alias(row)), "pieces")
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    sizes.pop(capacity, None)
    parts = F.lit(1)
    for length, n in sizes.items():
        if n > task_rows:
            parts = F.when(F.col("length") == length, -(-n // task_rows)).otherwise(parts)
    rest = pieces.where(F.col("length") < capacity).withColumn(salt, F.pmod(F.xxhash64(row), parts).cast("int"))
    counts, base = dict(sizes), {}
    if any(n > task_rows for n in sizes.values()):
        at_rank: dict[int, int] = defaultdict(int)
        counted = rest.groupBy("length", salt).agg(F.count("*").alias("n")).collect()  # capacity rows and one a million pieces
        for r in sorted(counted, key=lambda r: (r["length"], r[salt])):
            base[r["length"], r[salt]] = at_rank[r["length"]]
            at_rank[r["length"]] += r["n"]
    at = lookup(plan_packing(counts, capacity))
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*own).schema) + ", sequence_id long, offset long"

    def run(frames):
        for f in frames:
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            start = np.array([base.get(k, 0) for k in zip(f["length"].tolist(), f[salt].tolist(), strict=True)], np.int64)
            rank = start + f[nth].to_numpy(np.int64)
            for length, idx in f.groupby("length").indices.items():
                t = at[int(length)]
                k = np.searchsorted(t[:, 0], rank[idx], "right") - 1
                q = rank[idx] - t[k, 0]
                seq[idx] = t[k, 1] + q // t[k, 2]
                off[idx] = t[k, 3] + q % t[k, 2] * int(length)
            f["sequence_id"], f["offset"] = seq, off
            yield f.drop(columns=[salt, nth])

    w = Window.partitionBy("length", salt).orderBy(row)
    ranked = rest.withColumn(nth, F.row_number().over(w) - 1).select(*own, salt, nth)
    # numbers below zero are those of full pieces, so that the two never meet
    full = pieces.where(F.col("length") == capacity).select(*own, (-1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(ranked.mapInPandas(run, made))
