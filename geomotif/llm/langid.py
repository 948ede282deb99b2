"""Language identification by error-correcting output codes.

Each language has a codeword of -1 and 1; for each bit a binary classifier over hashed byte n-grams of the
whole text says which half of the languages it is. A text's language is that of the codeword with the least
weighted logistic loss, the weights being each bit's accuracy on a part of the sample it did not see; where
the runner-up is nearly as near, the text is flagged as ambiguous.

The classifiers are fitted on a sample of at most ``per_label`` rows of each language, whatever ids are null or
repeated. Defined results: a
null text, or one without a letter, is ``und`` with score 0; ties go to the first language by name; one known
language gives a code without bits, always chosen; with none, everything is ``und``; an empty table gives no
rows; repeated rows are judged alike; other columns pass through, and those of the new names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import feature_chunks, fit_binary, sample_features

ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """One row for each of n languages: all splits in two for up to 5, else random dense codes of distinct columns."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 5:
        cols = [(1, *c) for c in product((1, -1), repeat=max(n - 1, 0)) if -1 in c]
        return np.array(cols, np.float32).reshape(-1, n).T
    rng = np.random.Generator(np.random.PCG64(n))
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):  # the code whose nearest rows are farthest apart
        m = np.where(rng.random((n, bits)) < 0.5, -1, 1).astype(np.float32)
        m[:, np.abs(m.sum(axis=0)) == n] *= -np.sign(rng.random(n)[:, None] - 0.5).astype(np.float32)
        d = ((bits - m @ m.T) / 2 + bits * np.eye(n)).min()
        if d > far:
            best, far = m, d
    return best


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share of the likelihood, loss margin to the runner-up)."""
        n = len(x)
        if len(self.langs) < 2:
            return np.zeros(n, int), np.full(n, float(len(self.langs))), np.full(n, np.inf)
        f = (x @ self.weights + self.bias).astype(np.float64)
        bit = lambda m: np.logaddexp(0, -f * m) @ self.trust
        loss = np.stack([bit(m) for m in self.code], axis=1)
        best = loss.argmin(axis=1)
        least = np.sort(loss, axis=1)
        p = np.exp(-(loss - least[:, :1]))
        return best, 1 / p.sum(axis=1), least[:, 1] - least[:, 0]


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", key: str = "doc_id", per_label: int = 700) -> LanguageModel:
    x, y = sample_features(train, text_col, F.col(label_col).cast("string"), F.col(key), per_label, ORDERS)
    langs = sorted(set(y))
    code = codewords(len(langs))
    if len(langs) < 2:
        return LanguageModel(langs, code, np.zeros((x.shape[1], 0)), np.zeros(0), np.zeros(0))
    target = code[[langs.index(v) for v in y]]
    seen = np.arange(len(y)) % 4 != 3  # the rest weighs the bits
    w, b = fit_binary(x[seen], target[seen])
    right = ((x[~seen] @ w + b) * target[~seen] > 0).mean(axis=0) if (~seen).any() else np.ones(code.shape[1])
    trust = np.clip(2 * right - 1, 0.05, 1)
    w, b = fit_binary(x, target)
    return LanguageModel(langs, code, w, b, trust / trust.sum() * code.shape[1])


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each document holds a letter of any script."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    run = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = run[off[1:]] > run[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(map(str.isalpha, raw[off[i] : off[i + 1]].tobytes().decode(errors="replace")))
    return out


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", margin: float = 0.5, keep_text: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """df, without its text unless keep_text, with the language, its score (0 to 1) and whether it is ambiguous."""
    keep = [c for c in df.columns if (keep_text or c != text_col) and c not in names]
    held = df.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers: its size is fixed by the labels

    def run(batches):
        m = held.value
        named = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            rest = batch.select(keep)
            for i, j, x, raw, off in feature_chunks(batch, text_col, ORDERS):
                best, share, gap = m.decode(x)
                known = has_letter(raw, off) & bool(m.langs)
                lang = named[np.where(known, best, len(m.langs))]
                made = [pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(known & (gap < margin))]
                yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).columns, *made], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, *([] if keep_text else [text_col])).mapInArrow(run, f"{fields}{', ' * bool(keep)}`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
