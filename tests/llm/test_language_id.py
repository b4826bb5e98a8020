"""Language identification: sums over all segmentations by enumeration, expected counts, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docketry.llm import language_id
from tests.conftest import DATA
from tests.llm.test_operators import empty, odd  # noqa: F401


@pytest.fixture(scope="module")
def words():
    return language_id.vocabulary(language_id.default_vocabulary())


def chance_of(words, chances, piece: str) -> float:
    places = {p: i for i, p in enumerate(words.pieces)}
    return chances[places[piece]] if piece in places else chances[words.strange] if len(piece) == 1 else 0.0


def segmentations(text: str):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in segmentations(text[k:]):
            yield [text[:k], *rest]


def chances_like(words, seed: int) -> np.ndarray:
    return language_id._chances(np.random.default_rng(seed).gamma(0.5, 1, len(words.pieces)))


def coded(texts: list[str]) -> np.ndarray:
    return np.array([[ord(c) for c in language_id.START + t] for t in texts], np.uint32)


SAMPLES = [["a", "é", "日"], ["the", "und", "qzx", "ña日"], ["ontion", "strass", "schöne"], ["tionings", "zzzzzzzz"]]


@pytest.mark.parametrize("texts", SAMPLES)
def test_forward_sums_all_segmentations(words, texts):
    chances = np.stack([chances_like(words, 1), chances_like(words, 2)], axis=1)
    got = language_id.forward(coded(texts), words, chances)
    for t, row in zip(texts, got):
        for k in range(2):
            want = sum(math.prod(chance_of(words, chances[:, k], p) for p in s) for s in segmentations(language_id.START + t))
            assert row[k] == pytest.approx(math.log(want), abs=1e-9)


@pytest.mark.parametrize("texts", SAMPLES)
def test_expected_counts_of_pieces(words, texts):
    chances, counts = chances_like(words, 3), np.arange(1.0, len(texts) + 1)
    got = language_id.expected(coded(texts), counts, words, chances)
    want: Counter = Counter()
    for t, n in zip(texts, counts):
        weighted = [(s, math.prod(chance_of(words, chances, p) for p in s)) for s in segmentations(language_id.START + t)]
        for s, weight in weighted:
            for p in s:
                want[p if p in words.pieces else "strange"] += n * weight / sum(w for _, w in weighted)
    for i, p in enumerate(words.pieces):
        assert got[i] == pytest.approx(want[p], abs=1e-9)
    assert got[words.strange] == pytest.approx(want["strange"], abs=1e-9)


def test_long_words_block_by_block(words, monkeypatch):
    rng = random.Random(1)
    long = coded(["".join(rng.choice("abcdeinorstuäß") for _ in range(3000)) for _ in range(2)])
    chances = np.stack([chances_like(words, 4), chances_like(words, 5)], axis=1)
    whole = language_id.forward(long, words, chances)
    monkeypatch.setattr(language_id, "CELLS", 1)
    assert np.allclose(language_id.forward(long, words, chances), whole, rtol=1e-12)
    assert np.isfinite(whole).all() and (whole < -3000).all()


def test_pieces_have_hashes_of_their_own(words):
    assert len(np.unique(words.keys)) == len(words.pieces) == len(words.ids)
    found = words.find(coded(["the"]))
    assert words.pieces[found[3, 0, 3]] == "▁the" and found[3, 0, 2] == words.nothing


def test_rounds_raise_the_likelihood(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    table = language_id.word_counts(docs.selectExpr("lang", "coalesce(text, '') AS text")).collect()
    logs = []
    for rounds in (0, 1, 3):
        model = language_id.train(docs, rounds=rounds)
        rows = [r for r in table if r.lang == "en"]
        logs.append(sum(r.n * x for r, x in zip(rows, model.words([r.word.encode() for r in rows])[:, model.languages.index("en")])))
    assert logs[0] < logs[1] < logs[2]


def test_accuracy_on_rows_that_training_never_sees(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.id: r for r in language_id.identify(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out and truth[i].lang and any(c.isalpha() for c in truth[i].text or "")]
    assert sum(rows[i].lang_pred == truth[i].lang for i in held) >= 0.97 * len(held)
    # what is held out, and the language that a row is said to have, do not reach the prediction
    swapped = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    assert {r.id: r for r in language_id.identify(swapped).collect()} == rows


def test_odd_rows(spark, odd, empty):  # noqa: F811
    model = language_id.train(odd)
    assert model.languages == sorted(model.languages) and language_id.predict(empty, model).count() == 0
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.id: r for r in rows}
    assert [by[i].lang_pred for i in (6, 7, 9)] == ["und"] * 3 and by[6].score == 0 and by[0].lang_pred == "en" == by[20].lang_pred
    assert not any(r.held_out for r in rows if r.id is None)
    # nothing to learn from, a text of one very long word, signs alone
    rest = spark.createDataFrame([(1, "a" * 30_000, None), (2, "12 %& 3", None), (None, "the of and", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(rest).collect()} == {"und"}
    assert {r.id: r.lang_pred for r in language_id.predict(rest, model).collect()}[2] == "und"
    assert {r.id: r.lang_pred for r in language_id.predict(rest, model).collect()}[1] in model.languages
    assert language_id.identify(empty).collect() == []
    # training counts long words in stretches
    long = spark.createDataFrame([(k, ("ontion" if k % 2 else "schein") * 2000, "en" if k % 2 else "de") for k in range(30)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("en" if r.id % 2 else "de") for r in language_id.identify(long).collect())
