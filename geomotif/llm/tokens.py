"""Public tokenizer on executors, and token counts attributed to fields or sections.

A document is encoded once, whole. The byte length of each token gives its span of characters; spans
are joined with section intervals by binary search over the section starts. A token that crosses a
boundary goes to one section by rule: ``start`` (of its first character), ``end`` (of its last) or
``most`` (where most of its bytes lie, the earlier on ties).

Defined results: null or empty text has no tokens and one empty section; characters outside all
given sections are counted as outside; sections may come in any order, and where they overlap a character is of the one that
is listed first; a section that is null, that has a null border or that ends before it starts holds no token; borders
beyond the text stand for its ends; repeated rows are counted each; other columns pass
through, and those of the new names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RULES = ("start", "end", "most")


@lru_cache(maxsize=4)
def encoder(path: str | None = None, added: bool = True):
    """(encode function, byte length of each id). path: a .tiktoken rank file, which names no added tokens; by default that
    of the 50k byte-level vocabulary. Ids equal those of its tokenizers file with add_special_tokens=False. added: whether
    the file's added tokens have their own ids where a text holds them, as there; else they are ordinary text."""
    import public_tokenizers
    import tiktoken

    lines = open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own: dict[str, int] = {}
    if added and not path:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            own = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own)
    size = np.zeros(max([*ranks.values(), *own.values()]) + 2, np.int64)
    for b, i in [*ranks.items(), *((t.encode(), i) for t, i in own.items())]:
        size[i] = len(b)
    return partial(enc.encode, allowed_special="all", disallowed_special=()) if own else enc.encode_ordinary, size


def encode(text: str | None, path: str | None = None) -> np.ndarray:
    return np.array(encoder(path)[0](text), np.uint32) if text else np.zeros(0, np.uint32)


def line_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin; each line keeps its line feed."""
    b = np.frombuffer(text, np.uint8)
    s = np.flatnonzero(b == 10) + 1
    return np.concatenate([[0], s[s < len(b)]])


def attribute(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary); starts: sorted byte offsets, the first 0."""
    if not len(ids):
        return np.zeros(len(starts), np.int64), 0
    end = np.cumsum(sizes[ids])
    begin = end - sizes[ids]
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    crossing = int((first != last).sum())
    at = first
    if rule == "end":
        at = last
    elif rule == "most" and crossing:
        at = first.copy()
        edge = np.append(starts, end[-1])
        for i in np.flatnonzero(first != last):
            k = np.arange(first[i], last[i] + 1)
            at[i] = k[np.argmax(np.minimum(edge[k + 1], end[i]) - np.maximum(edge[k], begin[i]))]
    return np.bincount(at, minlength=len(starts)), crossing


def char_to_byte(text: bytes) -> np.ndarray:
    """Byte offset of each character, and the end."""
    b = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


def runs_of(spans: list[dict | None], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, owners) of the stretches of a text that belong to one section, or to none (-1). at: the byte offset
    of each character and the end."""
    top = len(at) - 1
    own = []
    for k, s in enumerate(spans):
        if s is not None and s["start"] is not None and s["end"] is not None:
            a, b = (int(at[min(max(s[c], 0), top)]) for c in ("start", "end"))
            if a < b:
                own.append((k, a, b))
    points = np.unique([0, *(x for _, a, b in own for x in (a, b))])
    owner = np.full(len(points), -1)
    for k, a, b in reversed(own):
        owner[np.searchsorted(points, a) : np.searchsorted(points, b)] = k
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    return points[first], owner[first]


def count_tokens(df: DataFrame, text_col: str = "text", sections_col: str | None = None, rule: str = "start", path: str | None = None, added: bool = True) -> DataFrame:
    """df without its text, with ``n_tokens``, ``section_tokens`` (one count for each section),
    ``n_crossing`` and ``n_outside``. sections_col: array<struct<start:int,end:int>> of character
    intervals; by default the lines of the text. added: as in encoder."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    made = [("n_tokens", T.LongType()), ("section_tokens", T.ArrayType(T.LongType())), ("n_crossing", T.LongType()), ("n_outside", T.LongType())]
    keep = [c for c in df.columns if c not in (text_col, sections_col, *(n for n, _ in made))]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in made])

    def run(batches):
        enc, sizes = encoder(path, added)
        for batch in batches:
            cols = {c: [] for c, _ in made}
            texts = batch.column(batch.schema.get_field_index(text_col))
            given = batch.column(batch.schema.get_field_index(sections_col)) if sections_col else None
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                ids = np.array(enc(text), np.int64)
                raw = text.encode()
                if given is None:
                    counts, crossing = attribute(ids, sizes, line_starts(raw), rule)
                    outside = 0
                else:
                    spans = given[i].as_py() or []
                    starts, owner = runs_of(spans, char_to_byte(raw))
                    by_run, crossing = attribute(ids, sizes, starts, rule)
                    by_owner = np.bincount(owner + 1, by_run, len(spans) + 1).astype(np.int64)
                    outside, counts = int(by_owner[0]), by_owner[1:]
                cols["n_tokens"].append(len(ids))
                cols["section_tokens"].append(counts.tolist())
                cols["n_crossing"].append(crossing)
                cols["n_outside"].append(outside)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(v, pa.list_(pa.int64()) if c == "section_tokens" else pa.int64()) for c, v in cols.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *cols])

    return df.select(*keep, text_col, *([sections_col] if sections_col else [])).mapInArrow(run, schema)
