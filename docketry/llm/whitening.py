"""Whitening of embeddings by merging singular value decompositions.

Entries become integers, floor(64 * c). The fit list is each distinct integer vector once. A task folds its part of the
list into one state, block by block: the number of vectors, their exact sums, and the singular values and right vectors
of the centred rows, as many as there are dimensions. Two states merge without loss: the singular values times vectors
of both, and one more row, the difference of the means times sqrt(n1 n2 / (n1 + n2)), are decomposed again. States of
tasks merge FAN at a time, level by level, so no task sees more than FAN of them; the last has dims x dims numbers,
whatever the input. Right vectors are the components of the covariance, squared singular values over n its eigenvalues.

The error of the result is measured, not assumed: a second pass over the fit list sums the whitened vectors' products.

Edge cases: vectors that are null or hold null or non-finite entries are left out; repeated rows are whitened alike and
fitted once; vectors of different lengths are separate lists, each with its own fit; components without variance (a
constant dimension, fewer vectors than dimensions) have no whitened value and are not returned, so a list of one vector
gives no rows; an empty table gives none; a null id stays null; extra columns are ignored. Entries whose integer no
long holds end the job.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written

#: Integer steps of a unit; what is added to each entry; components that are returned at most; states that merge at once;
#: rows that are decomposed at once.
STEPS, SHIFT, COMPONENTS, FAN, BLOCK = 64, 1_000_000, 16, 16, 4096
#: Eigenvalues below this share of the largest one are rounding, not variance.
NO_VARIANCE = 1e-12


@dataclass
class State:
    """n vectors, their exact sums (Python integers), and the centred rows as singular values times right vectors."""

    n: int
    sums: list[int]
    rows: np.ndarray


def _reduced(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: as many rows as dimensions at most, with the same products."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _exact_sums(rows: np.ndarray) -> list[int]:
    """Column sums as Python integers: high and low halves are summed apart, so that no long overflows."""
    high, low = rows >> 32, rows & 0xFFFFFFFF
    return [(int(a) << 32) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0))]


def fitted(rows: np.ndarray) -> State:
    """The state of a block of integer vectors."""
    sums = _exact_sums(rows)
    first = rows[0]  # subtracted before the division, so that large entries keep their differences
    centred = rows - first
    centred = centred - np.array([(s - len(rows) * int(f)) / len(rows) for s, f in zip(sums, first)])
    return State(len(rows), sums, _reduced(centred))


def merged(a: State, b: State) -> State:
    n = a.n + b.n
    apart = np.array([(x * b.n - y * a.n) / (a.n * b.n) for x, y in zip(a.sums, b.sums)])
    rows = np.vstack([a.rows, b.rows, apart * (a.n * b.n / n) ** 0.5])
    return State(n, [x + y for x, y in zip(a.sums, b.sums)], _reduced(rows))


def integers(vectors: DataFrame, id_col: str, vector_col: str, steps: int = STEPS) -> DataFrame:
    """(id, vector): the vectors that take part, as integers without the shift."""
    vector = F.col(vector_col)
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # a cast of what a long cannot hold raises under ANSI, floor() would cut it to the largest long
    as_long = lambda x: F.when(F.abs(x.cast("double")) < 2.0**55, F.floor(F.lit(float(steps)) * x.cast("double"))).otherwise(F.raise_error(F.lit("an entry is too large for a long")).cast("long"))
    return vectors.where(whole & (F.size(vector) > 0)).select(F.col(id_col).alias("id"), F.transform(vector_col, as_long).alias("vector"))


def _by_length(batches, column: str):
    """(dims, rows, integers) of the vectors in each Arrow batch."""
    for batch in batches:
        lists = batch.column(column)
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(n)
        for dims in np.unique(n).tolist():
            at = np.flatnonzero(n == dims)
            for x in range(0, len(at), BLOCK):
                part = at[x : x + BLOCK]
                yield batch, dims, part, flat[(ends[part] - dims)[:, None] + np.arange(dims)]


def _state_rows(states: dict[int, State]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"dims": pa.array(list(states), pa.int32()), "state": pa.array([pickle.dumps(s) for s in states.values()], pa.binary())})


def fit(distinct: DataFrame) -> dict[int, State]:
    """The state of all distinct vectors of each length, merged level by level."""

    def run(batches):
        states: dict[int, State] = {}
        for _, dims, _, rows in _by_length(batches, "vector"):
            one = fitted(rows)
            states[dims] = merged(states[dims], one) if dims in states else one
        yield _state_rows(states)

    def merge(pdf):
        total = None
        for raw in pdf["state"]:
            one = pickle.loads(raw)
            total = one if total is None else merged(total, one)
        return pd.DataFrame({"dims": pdf["dims"].iloc[:1], "state": [pickle.dumps(total)]})

    states = written(distinct.mapInArrow(run, "dims int, state binary"), "states")
    left = states.groupBy("dims").count().agg(F.max("count")).first()[0] or 0
    while left > 1:
        group = F.pmod(F.xxhash64("state"), F.lit(-(-left // FAN)))
        states = written(states.groupBy("dims", group.alias("part")).applyInPandas(merge, "dims int, state binary"), "states")
        left = states.groupBy("dims").count().agg(F.max("count")).first()[0]
    return {r.dims: pickle.loads(r.state) for r in states.collect()}


@dataclass
class Whitening:
    """What is taken off, the scaled components, each one's share of the variance, and the measured error."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def differences(self, rows: np.ndarray) -> np.ndarray:
        """n x - S, exactly: longs where they hold it and its squares' sum, else Python integers."""
        most = int(max(abs(int(rows.min())), abs(int(rows.max()))))
        bound = self.n * most + max(map(abs, self.sums))
        kind = np.int64 if bound * bound * rows.shape[1] < 1 << 63 else object
        return rows.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, differences: np.ndarray) -> np.ndarray:
        return (differences / self.n).astype(np.float64) @ self.weights


def whitening(state: State, components: int = COMPONENTS) -> Whitening:
    """Unit components by falling eigenvalue, each with its largest entry positive, over the root of its eigenvalue."""
    _, s, vt = np.linalg.svd(state.rows, full_matrices=False)
    values = s**2 / state.n
    kept = int(np.sum(values[:components] > NO_VARIANCE * max(float(values[0]), 1e-300)))
    vt = vt[:kept] * np.sign(vt[np.arange(kept), np.abs(vt[:kept]).argmax(axis=1)])[:, None]
    return Whitening(state.n, state.sums, (vt / np.sqrt(values[:kept])[:, None]).T, values[:kept] / values.sum() if kept else np.empty(0))


def measured(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """For each length the largest entry of the whitened vectors' covariance less the identity, over the fit list."""
    sent = distinct.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for _, dims, _, rows in _by_length(batches, "vector"):
            model = sent.value[dims]
            w = model.whitened(model.differences(rows))
            w = np.hstack([w, np.ones((len(w), 1))])
            sums[dims] = sums.get(dims, 0.0) + w.T @ w
        for dims, total in sums.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"dims": pa.array(np.full(total.size, dims), pa.int32()), "i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "total": total.ravel()})

    products = {dims: np.zeros((model.weights.shape[1] + 1,) * 2) for dims, model in models.items()}
    for dims, i, j, total in distinct.mapInArrow(run, "dims int, i int, j int, total double").groupBy("dims", "i", "j").agg(F.sum("total")).collect():
        products[dims][i, j] = total
    out = {}
    for dims, m in products.items():
        k = len(m) - 1
        mean = m[:k, k] / models[dims].n
        out[dims] = float(np.abs(m[:k, :k] / models[dims].n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    deviation, the sum over dimensions of (n x - S) ** 2, is exact, as a decimal.
    """
    rows = integers(vectors, id_col, vector_col)
    distinct = written(rows.select("vector").distinct(), "distinct_vectors")
    models = {dims: whitening(state, components) for dims, state in fit(distinct).items()}
    for dims, error in measured(distinct, models).items():
        models[dims].error = error
    sent = vectors.sparkSession.sparkContext.broadcast(models)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch, dims, at, rows in _by_length(batches, "vector"):
            model = sent.value[dims]
            k = model.weights.shape[1]
            if not k:
                continue
            apart = model.differences(rows)
            squares = (apart * apart).sum(axis=1)
            own = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0)) if squares.dtype == np.int64 else pa.array([Decimal(x) for x in squares], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(at)), k))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(at)).take(each), "component": pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                "n": pa.array(np.full(len(at) * k, model.n), pa.int64()), "deviation": own.take(each), "whitened": model.whitened(apart).ravel(),
                "explained": np.tile(model.explained, len(at)), "identity_error": np.full(len(at) * k, model.error),
            })

    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
