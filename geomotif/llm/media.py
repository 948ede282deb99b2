"""Media columns: texts stored as lossless WebP images, and images read back as pixel arrays.

Defined results: a null text counts as empty, which is stored as one row of spaces; a null or damaged image
decodes to a null pixel array, and to null digests of what it holds, with the error named; where the number of bytes is null
or beyond the image, all its samples are the payload; equal texts give equal files; an empty table gives no
rows; other columns pass through, and those of the new names are replaced. Images grow in width beyond the format's height, so very long texts fit.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import text_bytes

UNIT = 192


def side(n: int) -> tuple[int, int]:
    """(width, height) of an image that holds n payload bytes: 64 pixels a row, or a multiple of 64 beyond
    the greatest height, where the last row may then be longer than the payload."""
    rows = n // UNIT
    k = -(-rows // webp.MAX_SIDE)
    if 64 * k > webp.MAX_SIDE:
        raise ValueError(f"a payload of {n} bytes is beyond one image")
    return 64 * k, -(-rows // k)


def padded(n: int) -> int:
    """Payload bytes of a text of n bytes: the next positive multiple of UNIT."""
    return max(UNIT, -(-n // UNIT) * UNIT)


def to_media(raw: np.ndarray) -> bytes:
    w, h = side(padded(len(raw)))
    return webp.encode_samples(np.concatenate([raw, np.full(3 * w * h - len(raw), 32, np.uint8)]), w, h)


def store(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with its text replaced by ``n_bytes`` and the WebP file of its padded UTF-8 bytes."""
    keep = [c for c in df.columns if c not in (text_col, "n_bytes", media_col)]

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            rest = batch.select(keep)
            for i in range(0, batch.num_rows, 256):
                j, files = min(i + 256, batch.num_rows), []
                for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True):
                    files.append(to_media(raw[a:b]))
                yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).columns, pa.array(np.diff(off[i : j + 1])), pa.array(files, pa.binary())], [*keep, "n_bytes", media_col])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)
    return df.select(*keep, text_col).mapInArrow(run, f"{fields}n_bytes long, `{media_col}` binary")


def _read(files: list[bytes | None]) -> list[tuple[np.ndarray | None, str | None]]:
    there = [i for i, f in enumerate(files) if f is not None]
    out: list = [(None, "null") for _ in files]
    try:
        for i, p in zip(there, webp.decode_many([files[i] for i in there]), strict=True):
            out[i] = (p, None)
    except (ValueError, IndexError, KeyError):  # one is damaged: find which
        for i in there:
            try:
                out[i] = (webp.decode(files[i]), None)
            except (ValueError, IndexError, KeyError) as e:
                out[i] = (None, str(e) or type(e).__name__)
    return out


def gathered(batches, col: str, most: int = 12 << 20):
    """Batches put together until their files take most bytes: the more images are decoded at once, the fewer steps an
    image takes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(col)).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def groups(files: pa.Array, most: int = 16 << 20, rows: int = 16384):
    """Row ranges whose files together are small enough to be decoded at once."""
    i, held = 0, 0
    for j in range(len(files)):
        size = len(files[j].as_buffer() or b"") if files[j].is_valid else 0
        if j > i and (held + size > most or j - i >= rows):
            yield i, j
            i, held = j, 0
        held += size
    if len(files) > i:
        yield i, len(files)


def decode(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with ``width``, ``height``, ``pixels`` (RGBA bytes in row order) and ``media_error``."""
    df = df.drop("width", "height", "pixels", "media_error")
    keep = list(df.columns)

    def run(batches):
        for batch in batches:
            files = batch.column(batch.schema.get_field_index(media_col))
            for i, j in groups(files):
                got = _read(files.slice(i, j - i).to_pylist())
                made = [
                    pa.array([None if p is None else p.shape[1] for p, _ in got], pa.int32()),
                    pa.array([None if p is None else p.shape[0] for p, _ in got], pa.int32()),
                    pa.array([None if p is None else p.tobytes() for p, _ in got], pa.binary()),
                    pa.array([e for _, e in got], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *made], [*keep, "width", "height", "pixels", "media_error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    return df.mapInArrow(run, f"{fields}width int, height int, pixels binary, media_error string")


def feature(p: np.ndarray) -> str:
    """Size, mean of each colour and a 64-bit difference hash over the columns of an image."""
    rgb = p[..., :3]
    mean = rgb.reshape(-1, 3).mean(axis=0)
    cols = rgb.sum(axis=(0, 2), dtype=np.int64)
    bits = cols > np.roll(cols, -1)
    return f"{p.shape[1]}x{p.shape[0]} {mean[0]:.3f} {mean[1]:.3f} {mean[2]:.3f} {np.packbits(bits[:64]).tobytes().hex()}"


def digest(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df (with ``n_bytes``) with its media column decoded and replaced by digests of what was read back."""
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_error string"
    names = [m.split()[0] for m in made.split(", ")]
    keep = [c for c in df.columns if c != media_col and c not in names]

    def told(f: bytes | None, n: int | None, p: np.ndarray | None, error: str | None) -> tuple:
        stored = (None, None) if f is None else (len(f), hashlib.sha256(f).hexdigest())
        if error:
            return (None, None, None, *stored, None, error)
        b = p[..., :3].tobytes()
        b = b if n is None else b[: padded(n)]
        return (len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-16:]), *stored, feature(p), None)

    def run(batches):
        for batch in gathered(batches, media_col):
            files = batch.column(batch.schema.get_field_index(media_col))
            rest = batch.select(keep)
            for i, j in groups(files):
                own, sizes = files.slice(i, j - i).to_pylist(), batch.column("n_bytes").slice(i, j - i).to_pylist()
                rows = [told(f, n, *seen) for f, n, seen in zip(own, sizes, _read(own), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).columns, *cols], [*keep, *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)
    return df.select(*keep, media_col).mapInArrow(run, fields + made)
