"""Each stage of the corpus pipeline against what its operator decides, and the whole run."""

import pytest

import corpus_pipeline
from docketry.llm import quality_classifier
from docketry.llm.common import written
from tests.conftest import DATA
from tests.llm.test_operators import brute_components, empty, odd  # noqa: F401  fixtures


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    long_enough = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r.text.split()) >= 20}
    for name in ("quality_rules", "quality_classifier"):
        assert len(good & long_enough & set(kept[name])) >= 0.97 * len(good & long_enough)
    want, _ = brute_components(list(kept["quality_classifier"].items()))
    assert set(kept["near_duplicates"]) == {i for i, root in want.items() if i == root}
    assert set(kept["shared_passages"]) == set(kept["near_duplicates"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in pieces} == set(kept["shared_passages"])
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "shared_passages", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with given documents, and labels for some ids, a null id and null labels."""

    def write(docs):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        labels = [(i, int(i < 20)) for i in range(50)] + [(0, None), (None, 1), (7, 1)]
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_run_on_odd_rows(spark, odd, tables):  # noqa: F811
    """Nulls, empty and long texts, repeated rows, ties and clashing columns: each piece in one place, no id lost between."""
    pieces = corpus_pipeline.run(spark, tables(odd)).collect()
    known = {r.doc_id for r in odd.collect()}
    assert {r.doc_id for r in pieces} <= known
    assert pieces
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    for window in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == window)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048


def test_run_on_no_rows(spark, empty, tables):  # noqa: F811
    assert corpus_pipeline.run(spark, tables(empty)).collect() == []


def test_repeated_labelled_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(i % 4, f"word{i} some text here number {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    once = docs.groupBy("doc_id").agg({"text": "min"}).withColumnRenamed("min(text)", "text")
    (a, m), (b, n) = quality_classifier.train(docs, labels), quality_classifier.train(once, labels)
    scored = [[r.score for r in quality_classifier.score(docs, x).orderBy("id", "score").collect()] for x in ((a, m), (b, n))]
    assert scored[0] == pytest.approx(scored[1], abs=1e-6)
