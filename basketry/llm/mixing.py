"""Mixing sources to target weights by soft membership.

A classifier that is learned from the label table gives each document a posterior over domains. Nonnegative rates of the
documents, how often each is to be used, are fitted by projected gradient steps with momentum so that the expected tokens of each
domain meet their targets while rates stay near one. In the metric of a document's own tokens a step hangs on the
posterior and on the domains' residuals alone. So no rate is stored between steps: a pass works each rate out of the residuals so
far, a few numbers, and adds up the next ones.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm import _STRUCTURE, WORDS, features
from .shared import settle, small_batches, with_fields

#: Labelled rows that the classifier is fitted on, at most: those first by a hash of the id.
SAMPLE_ROWS = 6000
PASSES, STEP_ROWS, RATE, DECAY = 15, 64, 0.1, 1e-4
#: Tokens that each domain (quality, toxic) is to get, in shares of all tokens there are; over one in all, so good text repeats.
TARGETS = {"q1t0": 0.95, "q1t1": 0.10, "q0t0": 0.06, "q0t1": 0.01}
#: Pull of the rates towards one, steps at most, and the largest miss of a target, in shares of all tokens, at which steps end.
PULL, STEPS, NEAR = 0.002, 40, 0.001

_SIZE = WORDS + _STRUCTURE


@dataclass
class Domains:
    """A softmax classifier over the features of ``fm``; names in sorted order."""

    names: list[str]
    bias: np.ndarray
    weights: np.ndarray

    def posteriors(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(self.names)))
        index, value = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        raw = self.bias + np.add.reduceat(self.weights[index] * value[:, None], starts, axis=0)
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """``q<quality>t<toxic>``; null if either is not 0 or 1."""
    both = F.col(quality).isin(0, 1) & F.col(toxic).isin(0, 1)
    return F.when(both, F.concat(F.lit("q"), F.col(quality).cast("string"), F.lit("t"), F.col(toxic).cast("string")))


def learn_domains(docs: DataFrame, labels: DataFrame, names: list[str], text: str = "text", doc_id: str = "doc_id", seed: int = 5) -> Domains:
    """A classifier of the label table's domains, fitted on SAMPLE_ROWS labelled documents at most.

    Of an id with several labels the largest counts; labels outside ``names`` and null ids teach nothing. Without any
    row all domains are as likely.
    """
    names = sorted(names)
    known = labels.select(F.col(doc_id).alias("_id"), domain_of().alias("_domain")).where(F.col("_id").isNotNull() & F.col("_domain").isin(names))
    known = known.groupBy("_id").agg(F.max("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    used = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    small_batches(docs.sparkSession)

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t) for t in batch["_text"]]
            yield pd.DataFrame({"id": batch["_id"], "domain": batch["_domain"], "i": [i.tolist() for i, _ in rows], "x": [x.astype("float32").tolist() for _, x in rows]})

    found = used.mapInPandas(built, "id long, domain string, i array<int>, x array<float>").toLocalIterator()
    kept = sorted(((r["id"], r["domain"], np.array(r["i"], dtype=np.int32), np.array(r["x"])) for r in found), key=lambda r: (r[0], r[1], len(r[2]), float(r[3].sum())))
    return _fit([(i, x) for _, _, i, x in kept], [names.index(d) for _, d, _, _ in kept], names, seed)


def _fit(rows: list, targets: list[int], names: list[str], seed: int) -> Domains:
    draw = np.random.default_rng(seed)
    y = np.eye(len(names))[targets] if targets else np.zeros((0, len(names)))
    share = (y.sum(axis=0) + 1) / (len(y) + len(names))
    model = Domains(names, np.log(share), np.zeros((_SIZE, len(names))))
    squares = np.full((_SIZE, len(names)), 1e-3)
    for _ in range(PASSES):
        order = draw.permutation(len(y))
        for start in range(0, len(y), STEP_ROWS):
            batch = order[start : start + STEP_ROWS]
            own = [rows[i] for i in batch]
            error = (model.posteriors(own) - y[batch]) / len(batch)
            index, value = np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own])
            each = np.repeat(error, [len(i) for i, _ in own], axis=0) * value[:, None]
            used, back = np.unique(index, return_inverse=True)
            slope = np.stack([np.bincount(back, each[:, d]) for d in range(len(names))], axis=1) + DECAY * model.weights[used]
            squares[used] += slope * slope
            model.weights[used] -= RATE * slope / np.sqrt(squares[used])
            model.bias -= RATE * error.sum(axis=0)
    return model


def with_posteriors(docs: DataFrame, model: Domains, text: str = "text") -> DataFrame:
    """docs with tokens (words, long) and posterior (array<double>, in the order of the names); a null text has no tokens."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("tokens long, posterior array<double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out, tokens = [], [len((t or "").split()) for t in texts]
        for i in range(0, len(texts), 200):
            out += held.value.posteriors([features(t) for t in texts[i : i + 200]]).tolist()
        return pd.DataFrame({"tokens": tokens, "posterior": out})

    return with_fields(docs, of(F.col(text)), ["tokens", "posterior"])


@dataclass
class Rates:
    """What a rate is worked out of: the targets, the step and the residuals of all steps (in shares of all tokens).

    ``missed``: by how much each domain is above its target at the rates given, in the same shares.
    """

    names: list[str]
    targets: np.ndarray
    step: float
    pull: float
    residuals: list[np.ndarray] = field(default_factory=list)
    missed: np.ndarray | None = None

    def of(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates of rows of posteriors, from one by the projected steps in turn, and where momentum takes them next."""
        rate = ahead = np.ones(len(posterior))
        for k, residual in enumerate(self.residuals):
            new = np.maximum(0.0, ahead - self.step * (posterior @ (residual / self.targets) + self.pull * (ahead - 1.0)))
            rate, ahead = new, new + k / (k + 3) * (new - rate)
        return rate, ahead


def fit_rates(members: DataFrame, targets: dict[str, float], pull: float = PULL, steps: int = STEPS, near: float = NEAR) -> Rates:
    """members: tokens, posterior over the sorted names of ``targets`` -> rates that bring each domain to its share.

    A target is a share of all the tokens there are; shares are positive and need not add up to one. A step is one pass
    over members with one row of sums; the result does not hang on partitions but for the last digits. Where a target is still
    missed by more than ``near`` after all steps, a warning says by how much; ``missed`` of the result has it in any case.
    Null tokens count as none; without any token all rates are one.
    """
    names = sorted(targets)
    if not names or min(targets.values()) <= 0:
        raise ValueError("each target must be a positive share")
    wanted = np.array([targets[n] for n in names])
    sums = lambda frame: np.array([x or 0.0 for x in frame.first()], dtype=float)
    shares = sums(members.agg(F.sum("tokens"), *(F.sum(F.get("posterior", F.lit(d)) * F.col("tokens")) for d in range(len(names)))))
    total = shares[0]
    if not total:
        return Rates(names, wanted, 1.0, pull)
    # a bound of the curvature of half the sum of squared residuals, each over its target
    found = Rates(names, wanted, 1.0 / (pull + float((shares[1:] / total / wanted).max())), pull)
    size = len(names)
    now = np.concatenate([shares[1:], shares[1:]])
    while True:
        found.missed, residual = np.round(now / total - np.concatenate([wanted, wanted]), 12).reshape(2, size)
        if np.abs(found.missed).max() <= near or len(found.residuals) == steps:
            break
        found.residuals.append(residual)
        current = Rates(names, wanted, found.step, pull, list(found.residuals))

        def add(batches: Iterator[pd.DataFrame], current: Rates = current) -> Iterator[pd.DataFrame]:
            out = np.zeros(2 * size)
            for batch in batches:
                posterior = np.stack(batch["posterior"].to_numpy()) if len(batch) else np.zeros((0, size))
                out += np.concatenate([posterior.T @ (r * batch["tokens"].to_numpy()) for r in current.of(posterior)])
            yield pd.DataFrame([out], columns=[f"d{d}" for d in range(2 * size)])

        each = members.select("tokens", "posterior").mapInPandas(add, ", ".join(f"d{d} double" for d in range(2 * size)))
        now = sums(each.agg(*(F.sum(f"d{d}") for d in range(2 * size))))
    if np.abs(found.missed).max() > near:
        warnings.warn(f"targets missed after {steps} steps: " + ", ".join(f"{n} by {m:+.4f}" for n, m in zip(names, found.missed)), stacklevel=2)
    return found


def with_rates(members: DataFrame, rates: Rates, doc_id: str = "doc_id", text: str | None = "text") -> DataFrame:
    """members with rate and copies: rate rounded up or down by a hash of the row, so that copies meet it on average.

    The hash is of the id, and of the text if one is named (rows without an id differ by it). A null posterior is an error, as no
    row of ``with_posteriors`` has one; columns rate and copies are replaced.
    """

    @F.pandas_udf("double")
    def of(posterior: pd.Series) -> pd.Series:
        return pd.Series(rates.of(np.stack(posterior.to_numpy()))[0] if len(posterior) else np.zeros(0))

    return members.withColumn("rate", of("posterior")).withColumn("copies", _copies([doc_id, text] if text else [doc_id]))


def _copies(keyed: list[str]) -> Column:
    chance = F.pmod(F.xxhash64(F.lit(17), *keyed), F.lit(1 << 30)) / (1 << 30)
    whole = F.floor("rate")
    return (whole + (chance < F.col("rate") - whole).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with tokens, posterior, rate and copies; every row is given, those of no copies too.

    Null and empty texts have no tokens and the posterior of an empty text; repeated rows have the same copies each. Ids are whole
    numbers; rows without one teach nothing. Of clashing names, these four replace the old ones.
    """
    targets = targets or TARGETS
    model = learn_domains(docs, labels, list(targets), text, doc_id)
    rates = fit_rates(settle(with_posteriors(docs.select(text), model, text).select("tokens", "posterior")), targets)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("tokens long, posterior array<double>, rate double")
    def of(texts: pd.Series) -> pd.DataFrame:  # one worker a task, not one for the posterior and one for the rate
        each = [held.value.posteriors([features(t) for t in texts[i : i + 200]]) for i in range(0, len(texts), 200)]
        posterior = np.concatenate(each) if each else np.zeros((0, len(rates.names)))
        return pd.DataFrame({"tokens": [len((t or "").split()) for t in texts], "posterior": posterior.tolist(), "rate": rates.of(posterior)[0]})

    return with_fields(docs, of(F.col(text)), ["tokens", "posterior", "rate"]).withColumn("copies", _copies([doc_id, text]))
