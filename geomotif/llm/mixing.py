"""Mixing to target weights with soft membership.

A table of labelled documents trains a classifier that gives every document a posterior over domains. Rates
r >= 0 (expected copies of each document) are then fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, match the targets: least squares with a slight pull towards rate 1, by projected
gradient steps, each preconditioned by the document's tokens and by the mean square of the posteriors of the documents
that the bounds leave free. A step needs only one vector with a number a domain, so the history of these is the
whole state: executors replay it over a narrow staged table and return sums, and rates are never moved about.

The classifier sees at most ``per_label`` labelled documents of each domain. Where bounded rates can't reach the
targets at a budget, the budget falls until they do; what is missed in the end is in the column ``gap``, the greatest
difference of a domain's share of the expected tokens from its target, with a warning beyond the tolerance.

Defined results: null text has no tokens and the posterior of an empty document; a document's repeated labels count
once, by their greatest values; without labels there is one domain, ``all``; a target of a domain that no label names
can't be met, is left out with a warning, and the others are scaled up; a domain without a target has target 0; without
any target rates are 1; documents without tokens keep rate 1; ties do not arise; repeated rows, and rows with a null
id, are rated by their texts alike; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage, unit_hash, words
from .features import chosen, feature_chunks, fit_binary, least_keys, sample_features

ORDERS = (2, 4)


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    prior: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if len(self.domains) == 1:
            return np.ones((len(x), 1))
        f = (x @ self.weights + self.bias).astype(np.float64)
        p = self.prior / (1 + np.exp(-np.clip(f, -40, 40)))
        return p / p.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: F.Column, id_col: str = "doc_id", text_col: str = "text", per_label: int = 800) -> DomainModel:
    """labels: one row or more for each labelled document, with what the expression ``domain`` needs."""
    named = labels.select(F.col(id_col), domain.alias("domain")).where(f"domain is not null and {id_col} is not null").distinct()
    sizes = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if len(names) < 2:
        return DomainModel(names or ["all"], np.zeros((0, 0)), np.zeros(0), np.ones(1))
    named = named.withColumn("h", F.xxhash64(F.lit("label"), id_col))
    keys = least_keys(named.select(F.col("domain").alias("y"), "h"), per_label)
    few = named.where(chosen(keys, "domain")).select(id_col, "domain")  # per_label x domains rows at most: small enough to broadcast
    known = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(few), id_col)
    x, y = sample_features(known, "text", F.col("domain"), F.col(id_col), per_label, ORDERS)
    names = sorted(set(y))
    if len(names) < 2:
        return DomainModel(names or ["all"], np.zeros((0, 0)), np.zeros(0), np.ones(1))
    at = np.array([names.index(v) for v in y])
    target = np.where(at[:, None] == np.arange(len(names)), 1.0, -1.0).astype(np.float32)
    n = np.bincount(at, minlength=len(names))
    w, b = fit_binary(x, target, weight=(1 / n)[at])
    total = sum(sizes[name] for name in names)
    return DomainModel(names, w, b, np.array([sizes[name] / total for name in names]))


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, posterior): tokens are words; posterior is an array in the order of model.domains."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x domains numbers

    def run(batches):
        for batch in batches:
            for i, j, x, raw, off in feature_chunks(batch, text_col, ORDERS):
                _, _, first = words(ascii_lower(raw), off)
                p = held.value.posterior(x)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), flat], [id_col, "tokens", "posterior"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, tokens long, posterior array<double>")


def replay(p: np.ndarray, t: np.ndarray, history: list[np.ndarray], pull: float, max_rate: float | None) -> np.ndarray:
    """Rates of documents after the steps whose vectors are given."""
    r, top = np.ones(len(p)), np.inf if max_rate is None else max_rate
    for g in history:
        r = np.clip(r - (p @ g + pull * (r - 1)) / (1 + pull), 0, top)
    return np.where(t > 0, r, 1.0)


@dataclass
class Fit:
    """Steps of a fit, the budget in tokens that they aim at, and what is missed: differences of shares by domain."""

    history: list[np.ndarray] = field(default_factory=list)
    budget: float = 0.0
    missed: np.ndarray | None = None
    met: bool = True

    @property
    def gap(self) -> float:
        return 0.0 if self.missed is None else float(np.abs(self.missed).max(initial=0.0))


def fit_steps(sums, have: np.ndarray, square: np.ndarray, want: np.ndarray, budget: float, tolerance: float, max_steps: int) -> Fit:
    """Projected gradient steps to the goal want * budget. sums(history) gives (tokens of each domain, mean square of the
    posteriors of the documents whose rates are free) after the steps; have and square are those before any."""
    d, goal, total = len(want), want * budget, have.sum()
    history, now, scale, best, out = [], have, 1.0, np.inf, Fit(budget=budget)
    while True:
        off = float(np.abs(now - goal).max() / budget)
        scale = min(1.0, scale * 1.5) if off < best else scale / 2
        if off < best:  # steps that lead away are not part of the result
            best = off
            out = Fit(list(history), budget, now / max(now.sum(), 1e-300) - want, off < tolerance)
        if out.met or len(history) >= max_steps or scale < 1 / 64:
            return out
        free = square / total + 1e-9 * np.eye(d)
        history.append(scale * (np.linalg.pinv(free, rcond=1e-6) @ ((now - goal) / total)))
        now, square = sums(history)


def fit_rates(table: DataFrame, domains: list[str], targets: Mapping[str, float], budget: float | None = None, max_rate: float | None = None, pull: float = 1e-5, tolerance: float = 1e-3, max_steps: int = 40) -> Fit:
    """The fit over the staged table (tokens, posterior). targets are weights of domains, scaled to the budget in tokens: by
    default all tokens or, where rates are bounded, the most that seems possible, and less in growing steps until the
    targets are met."""
    d = len(domains)
    top = np.inf if max_rate is None else max_rate

    def add(of, size: int) -> np.ndarray:
        """The sum over all documents of the numbers that of(posteriors, tokens) makes of some."""

        def run(frames):
            s = np.zeros(size)
            for f in frames:
                if len(f):
                    s += of(np.stack(f["posterior"].to_numpy()), f["tokens"].to_numpy(np.float64))
            yield pd.DataFrame({"d": np.arange(size), "s": s})

        got = table.select("tokens", "posterior").mapInPandas(run, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(size)
        for r in got:
            out[r["d"]] = r["s"]
        return out

    def after(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = list(history)

        def of(p: np.ndarray, t: np.ndarray) -> np.ndarray:
            r = replay(p, t, steps, pull, max_rate)
            free = t * ((r > 0) & (r < top))
            return np.concatenate([(r * t) @ p, ((p * free[:, None]).T @ p).ravel()])

        got = add(of, d + d * d)
        return got[:d], got[d:].reshape(d, d)

    square = add(lambda p, t: ((p * t[:, None]).T @ p).ravel(), d * d).reshape(d, d)
    have = square.sum(axis=0)  # posteriors add up to 1
    total = have.sum()
    want = np.array([max(0.0, targets.get(x, 0.0)) for x in domains])
    if strange := sorted(x for x in targets if x not in domains and targets[x] > 0):
        warnings.warn(f"no document is labelled {', '.join(strange)}: these targets are left out", stacklevel=2)
    if not total or not want.sum():
        return Fit()
    want = want / want.sum()
    given = budget is not None
    if budget is None:
        use = want > 0
        budget = total if max_rate is None else min(total * max_rate, float((max_rate * have[use] / want[use]).min()))
    best = fit_steps(after, have, square, want, budget, tolerance, max_steps)
    less = 0.97
    while not best.met and not given and max_rate is not None and budget > total / 1000:
        budget, less = budget * less, max(0.7, less - 0.06)
        fit = fit_steps(after, have, square, want, budget, tolerance, max_steps)
        best = fit if fit.met or fit.gap < best.gap else best
    if not best.met:
        warnings.warn(f"the targets are missed by {best.gap:.4f} of the tokens", stacklevel=2)
    return best


def apply_rates(table: DataFrame, fit: Fit, pull: float = 1e-5, max_rate: float | None = None, id_col: str = "doc_id") -> DataFrame:
    """table with ``rate``, ``copies``, the rate rounded up or down by a hash of the id, and ``gap``."""
    history = fit.history

    def run(frames):
        for f in frames:
            if len(f):
                p, t = np.stack(f["posterior"].to_numpy()), f["tokens"].to_numpy(np.float64)
                yield f.assign(rate=replay(p, t, history, pull, max_rate))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    rated = table.mapInPandas(run, f"{fields}, rate double")
    return rated.withColumn("copies", F.floor(F.col("rate") + unit_hash(F.lit("copies"), id_col)).cast("int")).withColumn("gap", F.lit(round(fit.gap, 9)))


#: Domains of the labels table.
LABEL_DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END"


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], max_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain: str = LABEL_DOMAIN) -> tuple[DataFrame, list[str]]:
    """((id, tokens, posterior, rate, copies, gap), domains) for a labels table with quality and toxic, of which ``domain``
    makes the domains."""
    once = labels.groupBy(id_col).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    model = fit_domains(docs, once, F.expr(domain), id_col, text_col)
    narrow = stage(posteriors(docs, model, id_col, text_col), "mix")
    fit = fit_rates(narrow, model.domains, targets, max_rate=max_rate)
    return apply_rates(narrow, fit, max_rate=max_rate, id_col=id_col), model.domains
