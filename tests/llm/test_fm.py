import numpy as np
import pytest
from basketry.llm import fm
from basketry.llm.shared import in_fold


def test_linear_form_equals_all_pairs():
    draw = np.random.default_rng(1)
    machine = fm.Machine(0.3, draw.normal(size=fm.WORDS + fm._STRUCTURE), draw.normal(size=(fm.WORDS + fm._STRUCTURE, fm.FACTORS)))
    rows = [fm.features(t, n) for t, n in (("a b c a, x$ 1", 13), (None, None), ("", float("nan")), ("The end.\nThe end.\n" * 50, 5))]
    for (index, value), got in zip(rows, machine.raw(rows)):
        want = machine.bias + sum(machine.weights[i] * x for i, x in zip(index, value))
        for a in range(len(index)):
            for b in range(a):
                want += machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b]
        assert got == pytest.approx(want)


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = in_fold("doc_id", 5, 0)
    machine = fm.learn(docs.where(~held), labels.where(~held))
    rows = fm.score(docs, machine).join(labels, "doc_id").where(held).select("quality", "score").collect()
    right = [(r.score >= 0.3) == (r.quality == 1) for r in rows]
    assert len(rows) > 500 and sum(right) > 0.98 * len(right)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 9.0), (2, "", 0, 9.0), (2, "", 0, 9.0), (None, "x " * 300_000, 5, 9.0)], "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (7, 5)], "doc_id long, quality int")
    machine = fm.learn(docs, labels)
    got = fm.score(docs, machine)
    assert got.columns == docs.columns
    assert all(0 < r.score < 1 for r in got.collect()) and got.count() == 4
    assert fm.score(docs.limit(0), fm.learn(docs.limit(0), labels.limit(0))).count() == 0
