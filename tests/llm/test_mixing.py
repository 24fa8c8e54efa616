import numpy as np
import pytest
from basketry.llm import mixing
from pyspark.sql import functions as F


def brute_rates(posterior, tokens, wanted, pull, steps, near):
    """Projected gradient with every rate kept."""
    total, rate, ahead = tokens.sum(), np.ones(len(tokens)), np.ones(len(tokens))
    step = 1 / (pull + (posterior.T @ tokens / total / wanted).max())
    for k in range(steps):
        if np.abs(posterior.T @ (rate * tokens) / total - wanted).max() <= near:
            break
        residual = posterior.T @ (ahead * tokens) / total - wanted
        new = np.maximum(0, ahead - step * (posterior @ (residual / wanted) + pull * (ahead - 1)))
        rate, ahead = new, new + k / (k + 3) * (new - rate)
    return rate


def test_rates_match_brute_force_and_meet_targets(spark):
    draw = np.random.default_rng(2)
    posterior = draw.dirichlet([0.4, 0.2, 0.1], 400)
    tokens = draw.integers(0, 900, 400).astype(float)
    targets = {"a": 0.3, "b": 0.5, "c": 0.2}
    rows = [(i, int(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(tokens, posterior))]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>").repartition(5)
    rates = mixing.fit_rates(members, targets)
    got = {r.doc_id: r for r in mixing.with_rates(members, rates, text=None).collect()}
    want = brute_rates(posterior, tokens, np.array([0.3, 0.5, 0.2]), mixing.PULL, mixing.STEPS, mixing.NEAR)
    assert np.allclose([got[i].rate for i in range(400)], want, atol=1e-6)
    shares = posterior.T @ (want * tokens) / tokens.sum()
    assert np.abs(shares - [0.3, 0.5, 0.2]).max() < 0.02
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got.values())
    assert sum(r.copies for r in got.values()) == pytest.approx(want.sum(), rel=0.1)


def test_documents_meet_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = mixing.learn_domains(docs, labels.where("doc_id % 2 = 0"), list(mixing.TARGETS))
    members = mixing.with_posteriors(docs, model).drop("text").persist()
    names = sorted(mixing.TARGETS)
    top = F.array_position("posterior", F.array_max("posterior"))
    seen = members.join(labels.where("doc_id % 2 = 1"), "doc_id").select(mixing.domain_of().alias("d"), F.get(F.array(*map(F.lit, names)), (top - 1).cast("int")).alias("p")).collect()
    assert sum(r.d == r.p for r in seen) > 0.85 * len(seen)
    rated = mixing.with_rates(members, mixing.fit_rates(members, mixing.TARGETS), text=None)
    sums = rated.agg(F.sum("tokens"), *(F.sum(F.get("posterior", F.lit(i)) * F.col("tokens") * F.col("rate")) for i in range(4))).first()
    assert all(abs(sums[1 + i] / sums[0] - mixing.TARGETS[n]) < 0.01 for i, n in enumerate(names))
    members.unpersist()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2), (None, "a b", 2), (3, "", 2), (3, "", 2)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 1, 1), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 4 and all(r.rate >= 0 and r.copies >= 0 for r in got)
    assert mixing.mix(docs.limit(0), labels.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.fit_rates(docs, {"a": 0})


def test_missed_targets_are_said(spark):
    members = spark.createDataFrame([(i, 10, [1.0, 0.0]) for i in range(20)], "doc_id long, tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="targets missed after 5 steps: a by .*, b by -0.5"):
        rates = mixing.fit_rates(members, {"a": 0.5, "b": 0.5}, steps=5)
    assert rates.missed[1] == -0.5
    assert mixing.fit_rates(members, {"a": 1.0, "b": 0.0005}).missed.tolist() == pytest.approx([0, -0.0005])


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z")], "doc_id long, text string, _of string, row string, made string")
    got = mixing.mix(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).first()
    assert (got._of, got.row, got.made, got.tokens) == ("x", "y", "z", 2)
