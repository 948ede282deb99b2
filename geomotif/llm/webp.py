"""Lossless WebP: a full decoder, encoders with every transform, and a lockstep decoder for many images.

Pixels are uint8 arrays (height, width, 4) in the order red, green, blue, alpha.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Fixed values of the format: the order in which code-length code lengths are stored, and the
# neighbourhood (columns left, rows up) that the first 120 distance codes stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MAX_SIDE = 1 << 14
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Reads a stream, least significant bit first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.counted = False  # whether the code read last told its number of symbols

    def part(self, at: int, n: int) -> int:
        """n bits from one on, or -1 where the stream is shorter."""
        if at + n > self.end:
            return -1
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        i = self.at >> 3
        v = int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)
        self.at += n
        return v & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


class Sink:
    """Collects bits, least significant first."""

    def __init__(self) -> None:
        self.acc, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.acc |= int(v) << self.n
        self.n += int(n)

    def bytes(self) -> bytes:
        return self.acc.to_bytes((self.n + 7) // 8, "little")


# ---- prefix codes ------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    r = np.zeros(1, np.int64)
    for _ in range(bits):
        r = np.concatenate([2 * r, 2 * r + 1])
    return r


def table_of(lengths: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, int]:
    """Table over the next ``bits`` bits with entries length << 16 | symbol, for a complete code."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        bits = bits or 0
        return np.full(1 << bits, used[0], np.int64), bits
    top = int(lengths.max(initial=0))
    bits = bits or top
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order].astype(np.int64)
    span = np.int64(1) << (bits - n)
    if not len(used) or span.sum() != 1 << bits:
        raise ValueError("not a complete prefix code")
    return np.repeat(n << 16 | order, span)[_reversed(bits)], bits


END = float("inf")  # behind the last of a queue


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code, at most limit, for the counts; one used symbol has length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used if len(used) else [0]] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    c, floor, n = counts[order].tolist(), 1, len(order)
    while True:
        # two queues: the symbols by their counts, and the inner nodes, which come into being in order of theirs
        leaf, node = [x if x > floor else floor for x in c], [END] * n
        leaf += (END, END)
        up = [0] * (2 * n - 1)
        i, j = 0, 0
        for k in range(n - 1):
            if leaf[i] <= node[j]:
                total = leaf[i]
                up[i] = k + n
                i += 1
            else:
                total = node[j]
                up[j + n] = k + n
                j += 1
            if leaf[i] <= node[j]:
                total += leaf[i]
                up[i] = k + n
                i += 1
            else:
                total += node[j]
                up[j + n] = k + n
                j += 1
            node[k] = total
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[:n]) <= limit:
            out[order] = depth[:n]
            return out
        floor = max(2 * floor, sum(c) >> limit)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed for a stream that begins at the least significant bit."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return out
    n = lengths[used]
    order = np.argsort(n, kind="stable")
    used, n = used[order], n[order]
    share = np.left_shift(1, 15 - n)
    out[used] = _reversed(15)[np.cumsum(share) - share]
    return out


_SAME = re.compile(rb"\0{1,138}|[^\0]+")


def _runs(vals: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, extra, its bits) of the code lengths: runs of zeros are short."""
    runs = []
    for part in _SAME.findall(bytes(vals)):
        n = len(part)
        if part[0]:
            runs += [(v, 0, 0) for v in part]
        else:
            runs += [(18, n - 11, 7)] if n > 10 else [(17, n - 3, 3)] if n > 2 else [(0, 0, 0)] * n
    return runs


def write_code(sink: Sink, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        sink.put(1 | int(used[0] > 1) << 2, 3)
        sink.put(used[0], 8 if used[0] > 1 else 1)
        return
    runs = _runs(lengths[: int(used[-1]) + 1].tolist())
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = code_lengths(np.array(counts), 7)
    code, size = codes_of(own).tolist(), own.tolist()
    most = max(k for k in range(19) if size[LENGTH_ORDER[k]]) + 1
    sink.put(0, 1)
    sink.put(max(most, 4) - 4, 4)
    for k in range(max(most, 4)):
        sink.put(size[LENGTH_ORDER[k]], 3)
    sink.put(1 | 7 << 1, 4)  # the number of symbols follows, in sixteen bits
    sink.put(len(runs) - 2 if len(runs) > 1 else 0, 16)
    if np.count_nonzero(own) == 1:
        size = [0] * 19
    acc, n = 0, 0
    for s, extra, k in runs + [(0, 0, 0)] * (len(runs) == 1):
        acc |= (code[s] | extra << size[s]) << n
        n += size[s] + k
    sink.put(acc, n)


def read_code(bits: Bits, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    if bits.read(1):
        bits.counted = True
        two = bits.read(1)
        out[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return out
    own = np.zeros(19, np.int64)
    for k in range(bits.read(4) + 4):
        own[LENGTH_ORDER[k]] = bits.read(3)
    bits.counted = bool(bits.read(1))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.counted else size
    table, n = table_of(own)
    table, mask, data, place = table.tolist(), (1 << n) - 1, bits.data, bits.at
    got, before, v, have = [], 8, 0, 0
    add = got.append
    while left and len(got) < size:
        left -= 1
        if have < 14:  # a code and its extra bits
            v = int.from_bytes(data[place >> 3 : (place >> 3) + 16], "little") >> (place & 7)
            have = 121
        e = table[v & mask]
        used, s = e >> 16, e & 0xFFFF
        if s < 16:
            add(s)
            before = s or before
        elif s == 16:
            got += [before] * (3 + (v >> used & 3))
            used += 2
        elif s == 17:
            got += [0] * (3 + (v >> used & 7))
            used += 3
        else:
            got += [0] * (11 + (v >> used & 127))
            used += 7
        v >>= used
        have -= used
        place += used
    bits.at = place
    if len(got) > size:
        raise ValueError("code lengths run over the alphabet")
    if place > bits.end:
        raise ValueError("the stream ends early")
    out[: len(got)] = got
    return out


# ---- entropy-coded images ----------------------------------------------------------------------


def _extent(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + bits.read(n) + 1


def read_groups(bits: Bits, cache: int, number: int) -> list:
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    return [read_group(bits, sizes) for _ in range(number)]


def read_group(bits: Bits, sizes: tuple[int, ...]) -> list:
    """The codes of a group. One that has the very bits of that before it is not read anew."""
    out, begin, before = [], 0, -1
    for size in sizes:
        at = bits.at
        long = at - begin if out else 0
        if out and (before == size or bits.counted) and bits.part(begin, long) == bits.part(at, long) and not out[-1][size:].any():
            out.append(np.concatenate([out[-1], np.zeros(max(0, size - before), np.int64)])[:size])
            bits.at += long
        else:
            bits.counted = False
            out.append(read_code(bits, size))
        begin, before = at, size
    return out


def read_pixels(bits: Bits, w: int, h: int, cache: int, groups: list, meta: np.ndarray | None, meta_bits: int) -> np.ndarray:
    """The coded pixels as uint32 0xAARRGGBB, one after the other."""
    tables = []
    for g in groups:
        tables.append([(t.tolist(), n) for t, n in map(table_of, g)])
    out, total, at = [0] * (w * h), w * h, 0
    store, shift = [0] * (1 << cache if cache else 0), 32 - cache
    done = 0  # pixels already in the colour cache

    def symbol(t: tuple) -> int:
        e = t[0][bits.peek(t[1])]
        bits.at += e >> 16
        return e & 0xFFFF

    own = tables[0]
    while at < total:
        if meta is not None:
            own = tables[meta[(at // w) >> meta_bits, (at % w) >> meta_bits]]
        s = symbol(own[0])
        if s < 256:
            r, b, a = symbol(own[1]), symbol(own[2]), symbol(own[3])
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _extent(bits, s - 256)
            d = _extent(bits, symbol(own[4]))
            if d > 120:
                d -= 120
            else:
                x, y = NEIGHBOURS[d - 1]
                d = max(1, x + y * w)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            for v in out[done:at]:
                store[(v * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = v
            done = at
            out[at] = store[s - 280]
            at += 1
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def read_image(bits: Bits, w: int, h: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as uint32 (h, w)."""
    return read_pixels(bits, w, h, *read_coding(bits, w, h, main)).reshape(h, w)


def read_coding(bits: Bits, w: int, h: int, main: bool) -> tuple:
    cache = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, number = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        step = 1 << meta_bits
        meta = (read_image(bits, -(-w // step), -(-h // step)) >> 8 & 0xFFFF).astype(np.int64)
        number = int(meta.max()) + 1
    return cache, read_groups(bits, cache, number), meta, meta_bits


# ---- transforms --------------------------------------------------------------------------------


def argb_to_rgba(v: np.ndarray) -> np.ndarray:
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], axis=-1).astype(np.uint8)


def rgba_to_argb(p: np.ndarray) -> np.ndarray:
    p = p.astype(np.uint32)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Prediction from int arrays (..., 4) of the left, top, top-right and top-left pixels."""
    if mode == 11:
        to_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        d = mean - corner
        return np.clip(mean + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    black = np.zeros_like(left)
    black[..., 3] = 255
    return {
        0: lambda: black, 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: _half(_half(left, right), top), 6: lambda: _half(left, corner), 7: lambda: _half(left, top),
        8: lambda: _half(corner, top), 9: lambda: _half(top, right),
        10: lambda: _half(_half(left, corner), _half(top, right)),
    }.get(mode, lambda: black)()


def predictor(p: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Residuals of pixels (forward), or pixels of residuals."""
    h, w, _ = p.shape
    mode = int(modes.flat[0])
    if mode in (1, 2) and (modes == mode).all():
        return _running(p, mode, forward)
    src = p.astype(np.int64)
    pixels = src if forward else np.zeros_like(src)
    out = np.zeros_like(src)
    black = np.array([0, 0, 0, 255])
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = black if x == 0 else pixels[0, x - 1]
            elif x == 0:
                guess = pixels[y - 1, 0]
            else:
                right = pixels[y - 1, x + 1] if x + 1 < w else pixels[y, 0]
                guess = predict(int(modes[y >> bits, x >> bits]), pixels[y, x - 1], pixels[y - 1, x], right, pixels[y - 1, x - 1])
            if forward:
                out[y, x] = (src[y, x] - guess) & 255
            else:
                out[y, x] = pixels[y, x] = (src[y, x] + guess) & 255
    return out.astype(np.uint8)


def _running(p: np.ndarray, mode: int, forward: bool) -> np.ndarray:
    """predictor() where all pixels are guessed from the left (1) or from above (2): differences, or running sums."""
    out = p.copy()
    edge, axis = ((slice(None), slice(0, 1)), 1) if mode == 1 else ((slice(0, 1), slice(None)), 0)
    if forward:
        out[1:] -= p[:-1]
        out[:, 1:] = p[:, 1:] - p[:, :-1] if mode == 1 else out[:, 1:]
        if mode == 2:
            out[0, 1:] = p[0, 1:] - p[0, :-1]
        out[0, 0, 3] = (int(p[0, 0, 3]) - 255) & 255
        return out
    out[0, 0, 3] = (int(out[0, 0, 3]) + 255) & 255
    out[edge] = np.cumsum(out[edge], axis=1 - axis, dtype=np.uint8)
    return np.cumsum(out, axis=axis, dtype=np.uint8)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).astype(np.int8).astype(np.int64)


def cross_colour(p: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """elements: RGBA pixels that hold red-to-blue, green-to-blue, green-to-red."""
    h, w, _ = p.shape
    e = elements[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    rb, gb, gr = (_signed(e[..., k]) for k in range(3))
    out = p.astype(np.int64)
    red, green, blue = (out[..., k].copy() for k in range(3))
    add = (gr * _signed(green)) >> 5
    if forward:
        out[..., 2] = blue - ((gb * _signed(green)) >> 5) - ((rb * _signed(red)) >> 5)
        out[..., 0] = red - add
    else:
        out[..., 0] = (red + add) & 255
        out[..., 2] = blue + ((gb * _signed(green)) >> 5) + ((rb * _signed(out[..., 0])) >> 5)
    return (out & 255).astype(np.uint8)


def subtract_green(p: np.ndarray, forward: bool) -> np.ndarray:
    out = p.copy()
    g = p[..., 1] if forward else (256 - p[..., 1].astype(np.int64)).astype(np.uint8)
    out[..., 0] -= g
    out[..., 2] -= g
    return out


def bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpack_palette(p: np.ndarray, table: np.ndarray, w: int) -> np.ndarray:
    k = bundle(len(table))
    index = p[..., 1]
    if k:
        per, n = 1 << k, 8 >> k
        index = (index[:, :, None] >> (n * np.arange(per))[None, None]) & ((1 << n) - 1)
        index = index.reshape(len(p), -1)[:, :w]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


# ---- whole files -------------------------------------------------------------------------------


def wrap(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def unwrap(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return media[20 : 20 + struct.unpack("<I", media[16:20])[0]]


def read_head(bits: Bits) -> tuple[int, int, int, list]:
    """(width, height, width as coded, transforms in stored order)."""
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    w, h, _ = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, coded = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            n = bits.read(3) + 2
            sub = read_image(bits, -(-coded // (1 << n)), -(-h // (1 << n)))
            transforms.append((kind, n, argb_to_rgba(sub), coded))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = np.cumsum(argb_to_rgba(read_image(bits, size, 1))[0], axis=0, dtype=np.uint8)
            transforms.append((kind, 0, table, coded))
            coded = -(-coded // (1 << bundle(size)))
        else:
            transforms.append((kind, 0, None, coded))
    return w, h, coded, transforms


def undo(pixels: np.ndarray, transforms: list) -> np.ndarray:
    for kind, n, data, w in reversed(transforms):
        if kind == PREDICTOR:
            pixels = predictor(pixels, data[..., 1] & 15, n, forward=False)
        elif kind == CROSS:
            pixels = cross_colour(pixels, data, n, forward=False)
        elif kind == GREEN:
            pixels = subtract_green(pixels, forward=False)
        else:
            pixels = unpack_palette(pixels, data, w)
    return pixels


def decode(media: bytes) -> np.ndarray:
    """The pixels (height, width, 4) of a lossless WebP file."""
    bits = Bits(unwrap(media))
    w, h, coded, transforms = read_head(bits)
    return undo(argb_to_rgba(read_image(bits, coded, h, main=True)), transforms)


# ---- encoding ----------------------------------------------------------------------------------


def _prefix(value: int) -> tuple[int, int, int]:
    """(code, extra bits, their number) of a length or distance value."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    n = top - 1
    second = v >> n & 1
    return 2 * top + second, v & ((1 << n) - 1), n


def _tokens(v: list[int], cache: int, matches: bool) -> list[tuple]:
    """Literals, back-references (length, distance) and cache hits for a sequence of pixels."""
    out, at, seen, store = [], 0, {}, {}

    def keep(x: int) -> None:
        if cache:
            store[(x * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache)] = x

    while at < len(v):
        if matches and (d := at - seen.get(tuple(v[at : at + 3]), at)):
            n = 0
            while at + n < len(v) and n < 4096 and v[at + n] == v[at + n - d]:
                n += 1
            if n >= 3:
                out.append(("copy", n, d))
                for _ in range(n):
                    seen[tuple(v[at : at + 3])] = at
                    keep(v[at])
                    at += 1
                continue
        slot = (v[at] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache) if cache else -1
        out.append(("hit", slot, 0) if cache and store.get(slot) == v[at] else ("pixel", v[at], 0))
        seen[tuple(v[at : at + 3])] = at
        keep(v[at])
        at += 1
    return out


def write_image(sink: Sink, argb: np.ndarray, cache: int = 0, matches: bool = False, main: bool = False, meta_bits: int = 0) -> None:
    """Entropy-code uint32 pixels (h, w); meta_bits: side of the blocks that choose between two code groups."""
    h, w = argb.shape
    sink.put(int(cache > 0), 1)
    if cache:
        sink.put(cache, 4)
    group = None
    if main:
        sink.put(int(meta_bits > 0), 1)
        if meta_bits:
            sink.put(meta_bits - 2, 3)
            step = 1 << meta_bits
            group = (np.add.outer(np.arange(-(-h // step)), np.arange(-(-w // step))) & 1).astype(np.uint32)
            write_image(sink, group << 8 | np.uint32(0xFF000000))
    number = 2 if group is not None and group.max() else 1
    counts = [[np.zeros(280 + (1 << cache if cache else 0), int), *(np.zeros(256, int) for _ in range(3)), np.zeros(40, int)] for _ in range(number)]
    todo, at = [], 0  # (group, code, symbol, extra, its bits)
    for kind, a, d in _tokens(argb.ravel().tolist(), cache, matches):
        g = int(group[(at // w) >> meta_bits, (at % w) >> meta_bits]) if number > 1 else 0
        if kind == "pixel":
            todo += [(g, 0, a >> 8 & 255, 0, 0), (g, 1, a >> 16 & 255, 0, 0), (g, 2, a & 255, 0, 0), (g, 3, a >> 24, 0, 0)]
        elif kind == "hit":
            todo.append((g, 0, 280 + a, 0, 0))
        else:
            code, extra, n = _prefix(a)
            todo.append((g, 0, 256 + code, extra, n))
            near = next((k + 1 for k, (x, y) in enumerate(NEIGHBOURS) if max(1, x + y * w) == d), d + 120)
            todo.append((g, 4, *_prefix(near)))
        at += a if kind == "copy" else 1
    for g, k, s, _, _ in todo:
        counts[g][k][s] += 1
    lengths = [[code_lengths(c, 15) for c in own] for own in counts]
    for own in lengths:
        for n in own:
            write_code(sink, n)
    codes = [[codes_of(n) for n in own] for own in lengths]
    alone = [[np.count_nonzero(n) == 1 for n in own] for own in lengths]
    for g, k, s, extra, n in todo:
        if not alone[g][k]:
            sink.put(codes[g][k][s], int(lengths[g][k][s]))
        sink.put(extra, n)


def _head(sink: Sink, w: int, h: int, alpha: bool) -> None:
    if not 0 < w <= MAX_SIDE or not 0 < h <= MAX_SIDE:
        raise ValueError(f"{w} x {h} is beyond the format")
    sink.put(0x2F, 8)
    sink.put(w - 1, 14)
    sink.put(h - 1, 14)
    sink.put(int(alpha), 1)
    sink.put(0, 3)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache: int = 0, matches: bool = False, modes: np.ndarray | None = None, elements: np.ndarray | None = None, block: int = 3, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of the pixels. modes and elements are the block images of the predictor and
    cross-colour transforms (by default mode 11 and a fixed element)."""
    h, w, _ = pixels.shape
    sink = Sink()
    _head(sink, w, h, bool((pixels[..., 3] < 255).any()))
    for kind in transforms:
        pixels = write_transform(sink, pixels, kind, modes, elements, block)
    sink.put(0, 1)
    write_image(sink, rgba_to_argb(pixels), cache, matches, main=True, meta_bits=meta_bits)
    return wrap(sink.bytes())


def write_transform(sink: Sink, pixels: np.ndarray, kind: int, modes: np.ndarray | None = None, elements: np.ndarray | None = None, block: int = 3) -> np.ndarray:
    """The transformed pixels, the transform being written."""
    h, w, _ = pixels.shape
    sink.put(1, 1)
    sink.put(kind, 2)
    bh, bw = -(-h // (1 << block)), -(-w // (1 << block))
    if kind == PREDICTOR:
        m = np.full((bh, bw), 11) if modes is None else modes
        pixels = predictor(pixels, m, block, forward=True)
        sink.put(block - 2, 3)
        write_image(sink, (m << 8 | 0xFF000000).astype(np.uint32))
    elif kind == CROSS:
        e = np.tile(np.array([3, 250, 17, 255], np.uint8), (bh, bw, 1)) if elements is None else elements
        pixels = cross_colour(pixels, e, block, forward=True)
        sink.put(block - 2, 3)
        write_image(sink, rgba_to_argb(e))
    elif kind == GREEN:
        pixels = subtract_green(pixels, forward=True)
    else:
        table, index = np.unique(rgba_to_argb(pixels), return_inverse=True)
        if len(table) > 256:
            raise ValueError("more than 256 colours")
        sink.put(len(table) - 1, 8)
        rgba = argb_to_rgba(table[None])[0]
        steps = np.diff(np.concatenate([np.zeros((1, 4), np.uint8), rgba]), axis=0)
        write_image(sink, rgba_to_argb(steps[None]))
        k = bundle(len(table))
        per, n = 1 << k, 8 >> k
        index = np.pad(index.reshape(h, -1), ((0, 0), (0, -w % per)))
        packed = (index.reshape(h, -1, per) << (n * np.arange(per) if k else np.zeros(1, int))).sum(axis=-1)
        pixels = np.zeros((*packed.shape, 4), np.uint8)
        pixels[..., 1], pixels[..., 3] = packed, 255
    return pixels


LIMIT = 11  # of the code lengths that the fast paths use


def _bits_of(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at best."""
    c = counts[counts > 0]
    return float((c * np.log2(c.sum() / c)).sum())


def _cost(p: np.ndarray) -> float:
    """Estimated bits of the red, green and blue of pixels (h, w, 4) as literals."""
    c = np.bincount((p[..., :3] + np.array([0, 256, 512])).ravel(), minlength=768).astype(np.float64)
    n = p.shape[0] * p.shape[1]
    return 3 * n * float(np.log2(n)) - float((c * np.log2(np.maximum(c, 1))).sum())


def _multiplier(x: np.ndarray, y: np.ndarray) -> int:
    """The least-squares slope of y on x in units of 1 / 32, for signed bytes."""
    x, y = x.view(np.int8).astype(np.float64), y.view(np.int8)
    x -= x.mean()
    return int(min(127, max(-128, round(32 * float((x * y).sum()) / max(float((x * x).sum()), 1.0)))))


def _choose(p: np.ndarray) -> tuple[int | None, dict]:
    """The transform that promises the fewest bits for opaque pixels, if one saves a tenth, and the arguments it takes."""
    h, w, _ = p.shape
    blocks = (-(-h // 512), -(-w // 512))
    # what is likely to help: equal colours in a pixel, equal neighbours, colours that follow each other
    flat, colours = rgba_to_argb(p), p.reshape(-1, 4)
    options = []
    if 4 * np.count_nonzero(colours[:, 0] == colours[:, 1]) > h * w:
        options.append((GREEN, {}, lambda: subtract_green(p, forward=True)))
    for mode, same in ((1, flat[:, 1:] == flat[:, :-1]), (2, flat[1:] == flat[:-1])):
        if 8 * np.count_nonzero(same) > h * w:
            options.append((PREDICTOR, {"modes": np.full(blocks, mode)}, lambda mode=mode: _running(p, mode, forward=True)))
    gr, gb = (_multiplier(colours[:, 1], colours[:, k]) for k in (0, 2))
    if abs(gr) + abs(gb) > 16:
        elements = np.tile(np.array([0, gb & 255, gr & 255, 255], np.uint8), (*blocks, 1))
        options.append((CROSS, {"elements": elements}, lambda: cross_colour(p, elements, 9, forward=True)))
    classes = np.bincount(((flat * np.uint32(CACHE_FACTOR)) >> np.uint32(20)).ravel(), minlength=4096)
    many = np.count_nonzero(classes) > 256  # classes, so as many colours at least
    if many and not options:
        return None, {}
    best, out = 0.9 * _cost(p), (None, {})
    for kind, more, made in options:
        if (cost := _cost(made())) < best:
            best, out = cost, (kind, more)
    if many:
        return out
    v = np.sort(flat.ravel())
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    if len(edge) <= 256 and 24 * len(edge) + _bits_of(np.diff(edge, append=len(v))) < best:
        return PALETTE, {}
    return out


def _copies(v: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of disjoint back-references: stretches, at least four pixels long, whose every window of
    four was last seen at one distance."""
    n = len(v)
    if n < 5:
        return []
    x = v.astype(np.uint64)
    key = ((x[:-3] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-2]) * np.uint64(0xD6E8FEB86659FD93) ^ x[2:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ x[3:]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():  # as in most short texts, and told faster than where they are
        return []
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    last = np.full(n - 3, -1)
    last[order[1:][same]] = order[:-1][same]
    here = np.flatnonzero(last >= 0)
    if not len(here):
        return []
    ok = np.ones(len(here), bool)
    for k in range(4):  # hashes may lie
        ok &= v[here + k] == v[last[here] + k]
    here = here[ok]
    d = here - last[here]
    cut = np.flatnonzero(np.diff(here, prepend=-9) + (np.diff(d, prepend=-9) != 0) != 1)
    out, end = [], 0
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(here)], strict=True):
        at, stop, far = int(here[a]), int(here[b - 1]) + 4, int(d[a])
        at = max(at, end)
        while stop - at >= 4:
            size = min(stop - at, 4096)
            out.append((at, size, far))
            at += size
        end = max(end, out[-1][0] + out[-1][1]) if out else end
    return out


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of many values."""
    if not len(value):
        return value, value, value
    v = value - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    n = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> n & 1)), v & ((1 << n) - 1), n


def _pack(head: Sink, codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """What head holds, and behind it the codes, each of at most 25 bits."""
    if not len(codes):
        return head.bytes()
    end = np.cumsum(sizes) + head.n
    at = end - sizes
    word = at >> 5
    v = codes.astype(np.uint64) << (at & 31).astype(np.uint64)
    first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    sums = np.add.reduceat(v, first)
    out = np.zeros((int(end[-1]) >> 5) + 2, np.uint64)
    out[word[first]] = sums & np.uint64(0xFFFFFFFF)
    out[word[first] + 1] += sums >> np.uint64(32)
    body = out.astype("<u4").view(np.uint8)[: (int(end[-1]) + 7) // 8].copy()
    start = np.frombuffer(head.bytes(), np.uint8)
    body[: len(start)] |= start
    return body.tobytes()


def write_fast(sink: Sink, argb: np.ndarray) -> bytes:
    """The stream that sink begins, with uint32 pixels (h, w) of one alpha as its main image: literals, back-references and a
    colour cache where a sixteenth of the pixels are found in it, without a loop over pixels."""
    w, v = argb.shape[1], argb.ravel()
    n = len(v)
    copies = _copies(v)
    free = np.ones(n, bool)
    for at, size, _ in copies:
        free[at : at + size] = False
    cache, hit = max(1, min(7, n.bit_length() - 2)), np.zeros(n, bool)
    slot = ((v.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache)).astype(np.int64)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (v[order[1:]] == v[order[:-1]])
    hit &= free
    if 5 * np.count_nonzero(hit) < 8 * np.count_nonzero(np.bincount(slot[hit])):  # some 5 bits saved each, against twice the 4 of a code's length
        cache, hit = 0, np.zeros(n, bool)
    lit = free & ~hit
    start, size, far = (np.array(x, np.int64) for x in (zip(*copies, strict=True) if copies else ((), (), ())))
    len_code, len_more, len_bits = _prefixes(size)
    far_code, far_more, far_bits = _prefixes(np.where(far == 1, 2, np.where(far == w, 1, far + 120)))
    literal = v[lit]
    if cache or copies:
        green = np.full(n, -1)
        green[lit] = literal >> 8 & 255
        green[hit] = 280 + slot[hit]
        green[start] = 256 + len_code
        green = green[green >= 0]  # where a token begins
    else:
        green = (literal >> 8 & 255).astype(np.int64)
    # red and blue have one code, and green too where it has literals alone: bits of letters, whatever their colour
    own = np.bincount(green, minlength=280 + (1 << cache if cache else 0))
    other = np.bincount(literal >> 16 & 255, minlength=256) + np.bincount(literal & 255, minlength=256)
    if not cache and not copies:
        own[:256] += other
        first_code = code_lengths(own, LIMIT)
        other_code = first_code[:256]
    else:
        first_code, other_code = code_lengths(own, LIMIT), code_lengths(other, LIMIT)
    far_lengths = code_lengths(np.bincount(far_code, minlength=40), LIMIT)
    sink.put(int(cache > 0), 1)
    if cache:
        sink.put(cache, 4)
    sink.put(0, 1)  # no code groups
    write_code(sink, first_code)
    twice = Sink()
    write_code(twice, other_code)
    sink.put(twice.acc, twice.n)
    sink.put(twice.acc, twice.n)
    write_code(sink, np.bincount(v[:1] >> 24, minlength=256))  # alpha: 255, or 0 for what a predictor leaves of it
    write_code(sink, far_lengths)
    size_of = [np.zeros_like(x) if np.count_nonzero(x) == 1 else x for x in (first_code, other_code, far_lengths)]
    code_of = [codes_of(x) for x in (first_code, other_code, far_lengths)]
    kind = np.where(green < 256, 3, np.where(green < 280, 4, 1))  # entries of a token
    first = np.cumsum(kind) - kind
    codes, sizes = np.zeros(int(kind.sum()), np.int64), np.zeros(int(kind.sum()), np.int64)
    codes[first], sizes[first] = code_of[0][green], size_of[0][green]
    at = first[kind == 3]
    for k, shift in ((1, 16), (2, 0)):
        x = literal >> shift & 255
        codes[at + k], sizes[at + k] = code_of[1][x], size_of[1][x]
    at = first[kind == 4]
    codes[at + 1], sizes[at + 1] = len_more, len_bits
    codes[at + 2], sizes[at + 2] = code_of[2][far_code], size_of[2][far_code]
    codes[at + 3], sizes[at + 3] = far_more, far_bits
    return _pack(sink, codes, sizes)


def encode_samples(samples: np.ndarray, w: int, h: int) -> bytes:
    """A lossless WebP file of opaque pixels from w * h * 3 samples in red, green, blue order, with the transform that
    promises to be the shortest, back-references and a colour cache."""
    p = np.full((h, w, 4), 255, np.uint8)
    p[..., :3] = samples.reshape(h, w, 3)
    kind, more = _choose(p)
    sink = Sink()
    _head(sink, w, h, alpha=False)
    if kind is not None:
        p = write_transform(sink, p, kind, block=9, **more)
    sink.put(0, 1)
    return wrap(write_fast(sink, rgba_to_argb(p)))


def decode_many(media: list[bytes]) -> list[np.ndarray]:
    """decode() of each. Images with one code group, a constant alpha and codes no longer than LIMIT advance together, one
    token at a time; all others are decoded one by one."""
    out: list = [None] * len(media)
    lanes = []
    for i, m in enumerate(media):
        stream = unwrap(m)
        bits = Bits(stream)
        w, h, coded, transforms = read_head(bits)
        start = bits.at
        cache, groups, meta, _ = read_coding(bits, coded, h, main=True)
        codes = groups[0]
        if meta is not None or max(int(c.max()) for c in (*codes[:3], codes[4])) > LIMIT or np.count_nonzero(codes[3]) != 1:
            bits.at = start
            out[i] = undo(argb_to_rgba(read_image(bits, coded, h, main=True)), transforms)
        else:
            lanes.append(Lane(coded * h, i, stream, bits.at, codes, cache, coded, h, transforms))
    lanes.sort(key=lambda x: (-x.pixels, x.i))
    a = 0
    while a < len(lanes):
        b, area = a, 0
        while b < len(lanes) and b - a < 1024 and (area == 0 or area + lanes[b].pixels <= 3 << 20):
            area += lanes[b].pixels
            b += 1
        for lane, v in zip(lanes[a:b], _lockstep(lanes[a:b]), strict=True):
            out[lane.i] = undo(argb_to_rgba(v.reshape(lane.h, lane.w)), lane.transforms)
        a = b
    return out


class Lane(NamedTuple):
    """One image on its way: its pixels as coded, its place in the list, stream, bit reached, codes and the rest of its head."""

    pixels: int
    i: int
    stream: bytes
    at: int
    codes: list
    cache: int
    w: int
    h: int
    transforms: list


FEW = 24  # lanes; below, a loop over single tokens is faster than steps over arrays
AHEAD = 8  # steps between looks at which lanes have ended


def _lockstep(lanes: list[Lane]) -> list[np.ndarray]:
    """The coded pixels of the lanes, uint32."""
    size, index, tables = 1 << LIMIT, {}, []

    def table(c: np.ndarray) -> int:
        key = c.tobytes()
        if key not in index:
            index[key] = len(tables) * size
            t, n = table_of(c, LIMIT if np.count_nonzero(c) > 1 else 0)
            tables.append((np.full(size, t[0]) if not n else t).astype(np.int32))
        return index[key]

    number = len(lanes)
    base = np.array([[table(x.codes[k]) for k in (0, 1, 2, 4)] for x in lanes], np.int64)
    flat = np.concatenate(tables)
    starts = np.cumsum([0] + [len(x.stream) + 128 for x in lanes])
    raw = np.zeros(int(starts[-1]), np.uint8)
    for s, x in zip(starts.tolist(), lanes, strict=False):
        raw[s : s + len(x.stream)] = np.frombuffer(x.stream, np.uint8)
    wide = raw.astype(np.uint32)
    window = (wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16).astype(np.int64)
    del wide
    held = raw.tobytes()
    at = starts[:-1] * 8 + np.array([x.at for x in lanes])
    ends = (starts[:-1] + np.array([len(x.stream) for x in lanes])) * 8
    room = np.cumsum([0] + [x.pixels + 2 * AHEAD for x in lanes])
    first, pixels = room[:-1], np.zeros(int(room[-1]), np.int64)
    stop = first + np.array([x.pixels for x in lanes])
    slots = np.cumsum([0] + [1 << x.cache for x in lanes])
    store, own_slots = np.zeros(int(slots[-1]), np.int64), slots[:-1]
    shift = np.array([32 - x.cache for x in lanes])
    alpha = np.array([int(np.flatnonzero(x.codes[3])[0]) << 24 for x in lanes])
    final_at = np.zeros(number, np.int64)
    who, pos = np.arange(number), first.copy()

    def symbol(b: np.ndarray, a: np.ndarray) -> np.ndarray:
        e = flat[b + ((window[a >> 3] >> (a & 7)) & (size - 1))]
        a += e >> 16
        return e & 0xFFFF

    def copy(j: int) -> None:
        """Lane j meets a back-reference whose length symbol has been read."""
        lane, here, p = int(who[j]), int(at[j]), int(pos[j])
        x = lanes[lane]
        bits = int.from_bytes(held[here >> 3 : (here >> 3) + 8], "little") >> (here & 7)
        code = int(green[j]) - 256
        n, used = _extent_of(bits, code)
        e = int(flat[int(base[j, 3]) + (bits >> used & (size - 1))])
        used += e >> 16
        d, more = _extent_of(bits >> used, e & 0xFFFF)
        d = _distance(d, x.w)
        if d > p - int(first[lane]) or p + n > int(stop[lane]):
            raise ValueError("a back-reference leaves the image")
        if d >= n:
            pixels[p : p + n] = pixels[p - d : p - d + n]
        else:
            pixels[p : p + n] = np.resize(pixels[p - d : p], n)
        if x.cache:
            v = pixels[p : p + n]
            store[int(own_slots[lane]) + ((v * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - x.cache))] = v
        at[j], pos[j] = here + used + more, p + n

    lane_slots, lane_shift, lane_alpha, lane_stop = own_slots, shift, alpha, stop
    while len(who) > FEW:
        trail = []
        for _ in range(AHEAD):
            green = symbol(base[:, 0], at)
            lit = np.flatnonzero(green < 256)
            a = at[lit]
            red = symbol(base[lit, 1], a)
            blue = symbol(base[lit, 2], a)
            at[lit] = a
            v = lane_alpha[lit] | red << 16 | green[lit] << 8 | blue
            pixels[pos[lit]] = v
            store[lane_slots[lit] + ((v * CACHE_FACTOR & 0xFFFFFFFF) >> lane_shift[lit])] = v
            if len(lit) < len(who):
                hits = np.flatnonzero(green >= 280)
                pixels[pos[hits]] = store[lane_slots[hits] + green[hits] - 280]
                pos[hits] += 1
                if len(lit) + len(hits) < len(who):
                    for j in np.flatnonzero((green >= 256) & (green < 280)).tolist():
                        if pos[j] < lane_stop[j]:
                            copy(j)
            pos[lit] += 1
            trail.append((pos.copy(), at.copy()))
        over = pos >= lane_stop
        if over.any():
            past = np.stack([p[over] for p, _ in trail]) >= lane_stop[over]  # lanes go on reading behind their end
            final_at[who[over]] = np.stack([a[over] for _, a in trail])[past.argmax(axis=0), np.arange(past.shape[1])]
            on = ~over
            who, at, pos, base = who[on], at[on], pos[on], base[on]
            lane_slots, lane_shift, lane_alpha, lane_stop = lane_slots[on], lane_shift[on], lane_alpha[on], lane_stop[on]
    for j in range(len(who)):
        lane = int(who[j])
        a, b, c = int(first[lane]), int(pos[j]), int(stop[lane])
        cached = store[int(own_slots[lane]) : int(own_slots[lane]) + (1 << lanes[lane].cache)].tolist()
        done, final_at[lane] = _alone(lanes[lane], held, int(at[j]), pixels[a:b].tolist(), cached)
        pixels[a:c] = done
    if (final_at > ends).any():
        raise ValueError("the stream ends early")
    return [pixels[a:c].astype(np.uint32) for a, c in zip(first.tolist(), stop.tolist(), strict=True)]


def _extent_of(bits: int, code: int) -> tuple[int, int]:
    """(length or distance value, extra bits used) of a prefix code before the given bits."""
    if code < 4:
        return code + 1, 0
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + (bits & ((1 << n) - 1)) + 1, n


def _distance(d: int, w: int) -> int:
    if d > 120:
        return d - 120
    x, y = NEIGHBOURS[d - 1]
    return max(1, x + y * w)


def _alone(lane: Lane, held: bytes, at: int, px: list[int], store: list[int]) -> tuple[list[int], int]:
    """The rest of one lane, from bit ``at`` of held on: (all its pixels, the bit after them)."""
    (tg, ng), (tr, nr), (tb, nb), (td, nd) = ((t.tolist(), (1 << n) - 1) for t, n in (table_of(lane.codes[k]) for k in (0, 1, 2, 4)))
    alpha, total, w, down = int(np.flatnonzero(lane.codes[3])[0]) << 24, lane.pixels, lane.w, 32 - lane.cache
    done = len(px)
    while len(px) < total:
        bits = int.from_bytes(held[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        e = tg[bits & ng]
        n = e >> 16
        s = e & 0xFFFF
        if s < 256:
            r = tr[bits >> n & nr]
            n += r >> 16
            b = tb[bits >> n & nb]
            n += b >> 16
            px.append(alpha | (r & 0xFFFF) << 16 | s << 8 | b & 0xFFFF)
        elif s >= 280:
            for v in px[done:]:
                store[(v * CACHE_FACTOR & 0xFFFFFFFF) >> down] = v
            done = len(px)
            px.append(store[s - 280])
        else:
            size, used = _extent_of(bits >> n, s - 256)
            n += used
            e = td[bits >> n & nd]
            n += e >> 16
            d, used = _extent_of(bits >> n, e & 0xFFFF)
            n += used
            d = _distance(d, w)
            if d > len(px) or len(px) + size > total:
                raise ValueError("a back-reference leaves the image")
            if d >= size:
                px += px[len(px) - d : len(px) - d + size]
            else:
                part = px[-d:]
                px += (part * (size // d + 1))[:size]
        at += n
        if at > 8 * len(held):
            raise ValueError("the stream ends early")
    return px, at
