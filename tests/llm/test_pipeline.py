"""Each stage of the pipeline against a brute-force version on its own input."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from basketry.llm import mixing  # noqa: E402
from basketry.llm.langid import Judge, learn_dictionaries  # noqa: E402

from .test_mixing import brute_rates  # noqa: E402
from .test_pii import brute as brute_pii  # noqa: E402
from .test_simhash import brute_components, brute_fingerprint, brute_shingles  # noqa: E402

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{ROOT}/documents.parquet")
    frames = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], ROOT).write.parquet(f"{folder}/{n}")
        frames.append(spark.read.parquet(f"{folder}/{n}"))
    return frames


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "mixing to target weights"]
    assert all(sorted(f.columns) == sorted(COLUMNS) for f in stages[:-1]) and set(COLUMNS) < set(stages[-1].columns)


def test_language_drops_what_is_rejected_and_little_else(spark, stages):
    judge = Judge(learn_dictionaries(stages[0]))
    rows = stages[0].collect()
    assert ids(stages[1].collect()) == ids(r for r in rows if not judge.predict(r.text)[2])
    assert stages[1].count() >= 0.97 * len(rows)


def test_one_document_of_each_component_stays(stages):
    rows = stages[1].collect()
    groups = brute_components([(r.doc_id, brute_fingerprint(r.text, 5)) for r in rows], [brute_shingles(r.text, 5) for r in rows])
    assert ids(stages[2].collect()) == sorted(set(groups))


def test_documents_with_benchmark_items_go(spark, stages):
    squeezed = lambda t: " ".join(t.lower().split())
    items = [squeezed(r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    assert ids(stages[3].collect()) == ids(r for r in stages[2].collect() if not any(i in squeezed(r.text) for i in items))


def test_personal_data_is_gone_and_the_rest_is_whole(stages):
    before, after = ({r.doc_id: r for r in f.collect()} for f in stages[3:5])
    assert before.keys() == after.keys()
    for key, r in after.items():
        assert brute_pii(r.text) == [] and r.n_chars == len(r.text)
        if "<" not in r.text.replace("<", "", before[key].text.count("<")):
            assert r.text == before[key].text


def test_mixture_follows_its_rates(spark, stages):
    docs = stages[4]
    model = mixing.learn_domains(docs, spark.read.parquet(f"{ROOT}/labels.parquet"), list(mixing.TARGETS))
    rows = mixing.with_posteriors(docs, model).collect()
    wanted = np.array([mixing.TARGETS[n] for n in sorted(mixing.TARGETS)])
    rates = brute_rates(np.array([r.posterior for r in rows]), np.array([float(r.tokens) for r in rows]), wanted, mixing.PULL, mixing.STEPS, mixing.NEAR)
    want = {r.doc_id: x for r, x in zip(rows, rates)}
    got = {r.doc_id: r for r in stages[5].collect()}
    assert all(abs(r.rate - want[d]) < 1e-6 and r.copies in (int(r.rate), int(r.rate) + 1) and r.copies > 0 for d, r in got.items())
    assert all(x < 1 for d, x in want.items() if d not in got)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Every stage takes nulls, repeats, long texts, empty tables and columns named like its own; all but the last keep the columns."""
    text = "The quick brown fox jumps over the lazy dog near the river bank today. "
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (None, text * 2, None, None, None), (3, "", "en", "s", 0), (4, text * 3000, "en", "s", 5), (5, "mail a@b.co now please, thank you very much indeed", "en", "s", 5)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected int, tokens string, posterior int, rate string, fp int, pii string, _n int"
    docs = spark.createDataFrame([(*r, "x", 1, "x", 1, "x", 1, "x", 1) for r in rows], extra)
    for frame in (docs, docs.limit(0)):
        own = frame
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{n}-{frame is docs}"
            stage(spark, own, ROOT).write.parquet(path)
            out = spark.read.parquet(path)
            assert sorted(out.columns) == sorted([*docs.columns, *(["copies"] if n == 4 else [])])
            own = out
            if frame is docs and n == 2:
                assert sorted((r.doc_id or 0) for r in own.collect()) in ([0, 1, 4, 5], [1, 4, 5], [0, 1, 5], [0, 1])
            if frame is docs and n == 3:
                assert all("a@b.co" not in r.text and r.score == "x" for r in own.collect())
