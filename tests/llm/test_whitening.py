"""Whitening against one eigendecomposition of the whole covariance, exact sums, and edge cases."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pytest

from docketry.llm import whitening
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def plain(rows: list[tuple[int | None, list]], components: int = 16):
    """(n, S, deviations by row, eigenvalues over trace, covariance, distinct vectors) with Python integers and one eigh."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in kept]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    whitened = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in kept]) @ vectors[:, order[:components]] / np.sqrt(values[order[:components]])
    return n, deviations, values[order] / values.sum(), whitened


def test_whole_table_against_one_decomposition(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n, deviations, explained, whitened = plain(rows)
    got = whitening.whiten(table.repartition(37)).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    by = {(r.id, r.component): r for r in got}
    signs = np.sign([by[rows[0][0], k].whitened * whitened[0, k - 1] for k in range(1, 17)])
    for (i, _), deviation, w in zip(rows, deviations, whitened):
        for k in range(1, 17):
            r = by[i, k]
            assert r.deviation == Decimal(deviation)
            assert r.whitened == pytest.approx(signs[k - 1] * w[k - 1], abs=1e-9)
            assert r.explained == pytest.approx(explained[k - 1], rel=1e-9)
            assert r.identity_error < 1e-10


def test_merges_lose_nothing():
    rng = np.random.default_rng(1)
    rows = rng.integers(-5000, 5000, (900, 24)) * rng.integers(1, 40, 24) + 10**9
    whole = whitening.fitted(rows)
    parts = [whitening.fitted(rows[a:b]) for a, b in ((0, 1), (1, 7), (7, 300), (300, 900))]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        total = parts[order[0]]
        for k in order[1:]:
            total = whitening.merged(total, parts[k])
        assert total.n == 900 and total.sums == whole.sums == [sum(c) for c in rows.T.tolist()]
        # all dimensions are kept: the products of the centred rows agree, not only the leading ones
        assert np.allclose(total.rows.T @ total.rows, whole.rows.T @ whole.rows, rtol=1e-10, atol=1e-4)
        assert len(total.rows) == 24


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [[float(x) for x in rng.normal(size=5)] for _ in range(60)]
    rows = [(k, v, k, "clash") for k, v in enumerate(good)]
    rows += [(0, good[0], 1, "again"), (None, good[3], None, None)] + [(100 + k, good[7], 1, "copy") for k in range(500)]
    odd = [(900, None, 1, ""), (901, [1.0, None, 1.0, 1.0, 1.0], 1, ""), (902, [float("nan")] * 5, 1, ""), (903, [1.0, float("inf"), 0.0, 0.0, 0.0], 1, ""), (904, [], 1, "")]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(11)
    got = whitening.whiten(frame, components=4).collect()
    n, deviations, explained, whitened = plain([(r[0], r[1]) for r in rows], 4)
    assert n == 60 and len(got) == 4 * len(rows) and {r.n for r in got} == {60} and not {900, 901, 902, 903, 904} & {r.id for r in got}
    assert sorted((r.id is None, r.id or 0, r.deviation) for r in got if r.component == 2) == sorted((i is None, i or 0, Decimal(d)) for (i, *_), d in zip(rows, deviations))
    for k in range(1, 5):
        want, have = sorted(np.abs(whitened[:, k - 1])), sorted(abs(r.whitened) for r in got if r.component == k)
        assert np.allclose(have, want, atol=1e-9)
    assert whitening.whiten(frame.limit(0)).collect() == []


def test_lists_without_variance_and_of_several_lengths(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA)
    assert whitening.whiten(frame).collect() == []
    # three dimensions, one of them constant, and two vectors of another length: each list has its own fit
    rows = [(k, [float(k % 7), float(k % 5), 3.0], 0, "") for k in range(35)] + [(100, [0.0, 1.0], 0, ""), (101, [2.0, 1.0], 0, "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(r.n, r.component) for r in got} == {(35, 1), (35, 2), (2, 1)}
    assert {round(r.whitened, 9) for r in got if r.n == 2} == {1.0, -1.0} and max(r.identity_error for r in got) < 1e-12


def test_large_entries_stay_exact_or_end_the_job(spark):
    rows = [(k, [float(2.0**40 + 2.0**20 * k), float(k)], 0, "") for k in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    _, deviations, _, whitened = plain([(i, v) for i, v, *_ in rows])
    assert {(r.id, r.deviation) for r in got} == {(k, Decimal(d)) for k, d in enumerate(deviations)}
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 1), sorted(np.abs(whitened[:, 0])), atol=1e-9)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0], 0, "")], SCHEMA)).collect()
