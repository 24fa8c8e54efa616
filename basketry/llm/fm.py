"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs are never formed: for each of the few
factors f, they add up to ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2, so a document is scored in time linear in
its distinct words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log1p
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Hashed word features; the structure and metadata features come after them.
WORDS = 1 << 15
#: Labelled rows that the machine is fitted on, at most: those first by a hash of the id.
SAMPLE_ROWS = 6000
#: Factors of each feature, passes over the sample, rows of a step, learning rate and weight decay.
FACTORS, PASSES, STEP_ROWS, RATE, DECAY = 4, 12, 64, 0.05, 1e-4

_STRUCTURE = 13
_BUILD = np.arange(WORDS, WORDS + _STRUCTURE)


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of one document: words to length 1, then statistics of its build, each about 0 to 1.

    Words that share a hash are listed one by one.

    n_chars is the document's own metadata; where it is null, the text's length stands in. A null text is an empty one.
    """
    text = text or ""
    words = text.split()
    counts = Counter(text.lower().split())
    n, size = max(len(words), 1), max(len(text), 1)
    lines = text.split("\n")
    top = max(counts.values(), default=0)
    run = sum(map(eq, words, words[1:]))
    build = (
        min(log1p(len(words)) / 10, 1.5),
        sum(map(len, words)) / n / 20,
        len(counts) / n,
        top / n,
        run / n,
        sum(map(text.count, "#*$%&|<>")) / n,
        text.count("!") / n,
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, "0123456789")) / size,
        1 - len(set(lines)) / len(lines),
        min(log1p(size / len(lines)) / 10, 1.5),
        1.0 if len(words) < 50 else 0.0,
        min(log1p(max(n_chars if n_chars is not None and n_chars == n_chars else len(text), 0)) / 12, 1.5),
    )
    m = len(counts)
    index = np.empty(m + _STRUCTURE, dtype=np.int32)
    index[:m] = [crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in counts]
    index[m:] = _BUILD
    value = np.empty(m + _STRUCTURE)
    value[:m] = 1.0 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=m))
    value[:m] /= np.sqrt((value[:m] * value[:m]).sum()) or 1.0
    value[m:] = np.minimum(build, 2.0)
    return index, value


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The score before the sigmoid of each row, by the sum-of-squares identity."""
        if not rows:
            return np.zeros(0)
        index = np.concatenate([i for i, _ in rows])
        value = np.concatenate([x for _, x in rows])
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 11) -> Machine:
    """A machine fitted by AdaGrad on the logistic loss; without both labels, one of constant score."""
    draw = np.random.default_rng(seed)
    size = WORDS + _STRUCTURE
    y = np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), draw.normal(0, 0.05, (size, FACTORS)))
    if not 0 < y.sum() < len(y):
        machine.factors[:] = 0
        return machine
    sq_w, sq_v, sq_b = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    for _ in range(PASSES):
        order = draw.permutation(len(y))
        for start in range(0, len(y), STEP_ROWS):
            batch = order[start : start + STEP_ROWS]
            own = [rows[i] for i in batch]
            error = machine.scores(own) - y[batch]
            index = np.concatenate([i for i, _ in own])
            value = np.concatenate([x for _, x in own])
            sizes = [len(i) for i, _ in own]
            starts = np.cumsum([0, *sizes[:-1]])
            vx = machine.factors[index] * value[:, None]
            sums = np.repeat(np.add.reduceat(vx, starts, axis=0), sizes, axis=0)
            pull = np.repeat(error / len(batch), sizes)
            used, back = np.unique(index, return_inverse=True)
            gw = np.bincount(back, pull * value) + DECAY * machine.weights[used]
            each = (pull * value)[:, None] * (sums - vx)
            gv = np.stack([np.bincount(back, each[:, f]) for f in range(FACTORS)], axis=1) + DECAY * machine.factors[used]
            gb = error.mean()
            sq_w[used] += gw * gw
            sq_v[used] += gv * gv
            sq_b += gb * gb
            machine.weights[used] -= RATE * gw / np.sqrt(sq_w[used])
            machine.factors[used] -= RATE * gv / np.sqrt(sq_v[used])
            machine.bias -= RATE * gb / np.sqrt(sq_b)
    return machine


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars") -> Machine:
    """A machine for ``labels[label]`` (0 or 1), fitted on a sample of at most SAMPLE_ROWS labelled documents.

    The sample comes first by a hash of the id; labels come one to an id (their largest, should they disagree). Null labels, ids and
    other values teach nothing.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    used = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(n_chars).alias("_n")).join(F.broadcast(known), "_id")
    small_batches(docs.sparkSession)

    def built(batches):
        for batch in batches:
            rows = [features(t, n) for t, n in zip(batch["_text"], batch["_n"])]
            yield pd.DataFrame({"id": batch["_id"], "label": batch["_label"], "i": [i.tolist() for i, _ in rows], "x": [x.astype("float32").tolist() for _, x in rows]})

    sample = used.mapInPandas(built, "id long, label int, i array<int>, x array<float>").toLocalIterator()
    kept = sorted(((r["id"], r["label"], np.array(r["i"], dtype=np.int32), np.array(r["x"])) for r in sample), key=lambda r: (r[0], r[1], len(r[2]), float(r[3].sum())))
    return fit([(i, x) for _, _, i, x in kept], [y for _, y, _, _ in kept])


def score(docs: DataFrame, machine: Machine, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with score (0 to 1, the chance of label 1), from the text and n_chars alone; empty and null texts have one too.

    Other columns and repeated rows stay as they are; a column score is replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    @F.pandas_udf("double")
    def of(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = [held.value.scores([features(t, n) for t, n in zip(texts[i : i + 200], sizes[i : i + 200])]) for i in range(0, len(texts), 200)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", of(F.col(text), F.col(n_chars).cast("double")))
