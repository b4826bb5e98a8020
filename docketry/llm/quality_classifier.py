"""Document quality from random-indexing word vectors and a two-layer network.

Every word and every word shape (letters, digits and signs, without their identity) has a fixed sparse random index
vector. Its word vector is the sum of the index vectors of its neighbours, over the labelled rows that training may
use. A document is the mean of its words' and of its shapes' vectors. A network of two layers, in numpy, is fitted to
these means; a temperature, fitted on training rows that the network did not see, calibrates its probabilities.

Training takes a bounded sample, SAMPLE labelled documents, chosen by a hash of the id and used as whole texts; all
documents are scored. The word vectors live in a fixed number of hashed places, so the model's size is fixed.

Edge cases: a null or empty text has the zero vector and so a score of its own; null ids are scored and never held
out; null or repeated labels: a row without a label of 0 or 1 is not used, of repeated ones the largest counts; with
no labels, or labels of one kind, the score is the share of ones (0.5 without labels); repeated rows score alike;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import chunks, hash_words, whole_text, word_codes

#: Labelled documents that training takes at most; hashed places of words and shapes; length of a vector; neighbours.
SAMPLE, WORDS, SHAPES, WIDTH, WINDOW = 8000, 1 << 14, 1 << 12, 64, 2
PLACES, FEATURES = WORDS + SHAPES, 2 * WIDTH + 3
#: Places whose vectors travel as one row when tasks' sums are added.
SLICE = 1024


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse random index vectors: four ones and four minus ones each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((PLACES, WIDTH), np.float32)
    at = np.argsort(rng.random((PLACES, WIDTH)), axis=1)[:, :8]
    np.put_along_axis(out, at, np.tile(np.array([1, -1] * 4, np.float32), (PLACES, 1)), axis=1)
    return out


_SHAPE = bytes.maketrans(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)), b"9" * 10 + b"A" * 26 + b"a" * 26)


def shape(word: bytes) -> bytes:
    """A word with its digits, upper and lower ASCII letters as classes, other letters as one, runs as one or two."""
    out, run = bytearray(), 0
    for c in word.translate(_SHAPE):
        c = 0x7E if c >= 0x80 else c
        run = run + 1 if out and out[-1] == c else 0
        if run < 2:
            out.append(c)
    return bytes(out[:24])


def places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed places of words and of their shapes."""
    own = (hash_words([w.lower() for w in words]) % np.uint64(WORDS)).astype(np.int64)
    shapes: dict[bytes, int] = {}
    kinds = np.fromiter((shapes.setdefault(shape(w), len(shapes)) for w in words), np.int64, len(words))
    by_shape = (hash_words(list(shapes)) % np.uint64(SHAPES)).astype(np.int64) + WORDS
    return own, by_shape[kinds] if len(words) else np.empty(0, np.int64)


def _context_sums(docs: DataFrame) -> np.ndarray:
    """Each place's word vector, before scaling: tasks sum their neighbours' index vectors, slices are added by key."""

    def run(batches):
        index = index_vectors()
        sums = np.zeros((PLACES, WIDTH), np.float32)
        for part in chunks(batches, "text"):
            codes, words, counts = word_codes(part.column("text"))
            doc = np.repeat(np.arange(len(counts)), counts)
            for kind in places(words.to_pylist()):
                at = kind[codes]
                for step in range(1, WINDOW + 1):
                    near = np.flatnonzero(doc[:-step] == doc[step:]) if len(doc) > step else np.empty(0, np.int64)
                    pair, n = np.unique(at[near] * PLACES + at[near + step], return_counts=True)
                    a, b = pair // PLACES, pair % PLACES
                    for x in range(0, len(pair), 1 << 16):
                        s = slice(x, x + (1 << 16))
                        np.add.at(sums, a[s], index[b[s]] * n[s, None])
                        np.add.at(sums, b[s], index[a[s]] * n[s, None])
        for k in range(0, PLACES, SLICE):
            at = np.flatnonzero(sums[k : k + SLICE].any(axis=1))
            if len(at):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "sums": [sums[k + at].tobytes()]})

    def add(pdf):
        total = np.zeros((SLICE, WIDTH))
        for at, raw in zip(pdf["at"], pdf["sums"]):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(raw, np.float32).reshape(-1, WIDTH)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "sums": [total.astype(np.float32).tobytes()]})

    out = np.zeros((PLACES, WIDTH), np.float32)
    for k, raw in docs.mapInArrow(run, "k int, at binary, sums binary").groupBy("k").applyInPandas(add, "k int, sums binary").collect():
        out[k : k + SLICE] = np.frombuffer(raw, np.float32).reshape(-1, WIDTH)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors; a place that no training word fell into has none."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(length, 1e-9)).astype(np.float32)


def _sums(doc: np.ndarray, place: np.ndarray, n: np.ndarray, docs: int, vectors: np.ndarray) -> np.ndarray:
    """For each document the sum of n times its places' vectors, in blocks of whole documents.

    A document has each place once, so PLACES rows at most.
    """
    out = np.zeros((docs, WIDTH))
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    bounds, at = np.append(starts, len(doc)), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PLACES, side="right")) - 1)
        rows = slice(bounds[at], bounds[stop])
        out[doc[starts[at:stop]]] = np.add.reduceat(vectors[place[rows]] * n[rows, None], starts[at:stop] - bounds[at], axis=0)
        at = stop
    return out


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """For each text the means of its words' and shapes' vectors, and how much it repeats its words.

    Means do not see the order of words, so three shares are added: of words that equal the word before, that
    equal the word two before, and of distinct words.
    """
    codes, words, counts = word_codes(texts)
    codes, docs = codes.astype(np.int64), len(counts)
    doc, out = np.repeat(np.arange(docs), counts), np.zeros((docs, FEATURES), np.float32)
    per_word = 1 / np.maximum(counts, 1)
    for k, kind in enumerate(places(words.to_pylist())):
        pair, n = np.unique(doc * PLACES + kind[codes], return_counts=True)
        out[:, k * WIDTH : (k + 1) * WIDTH] = _sums(pair // PLACES, pair % PLACES, n, docs, vectors) * per_word[:, None]
    for step in (1, 2):
        same = (codes[step:] == codes[:-step]) & (doc[step:] == doc[:-step])
        out[:, 2 * WIDTH + step - 1] = np.bincount(doc[step:][same], minlength=docs) * per_word
    distinct = np.unique(doc * max(1, len(words)) + codes) // max(1, len(words))
    out[:, 2 * WIDTH + 2] = np.bincount(distinct, minlength=docs) * per_word
    return out


@dataclass
class Network:
    """relu(x W1 + b1) W2 + b2, scaled inputs, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> Network:
    """Adam on the logistic loss; a fifth of the rows is kept for the temperature."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    constant = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(mean, scale, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.log(constant / (1 - constant)))
    order = rng.permutation(len(y))
    check, train = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[train].tolist())) < 2:
        return net
    net.w2 = rng.normal(0, (2 / hidden) ** 0.5, hidden)
    names, decay = ("w1", "b1", "w2", "b2"), 1e-4
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for at in range(0, len(train), 128):
            rows = train[at : at + 128]
            z = (x[rows] - mean) / scale
            h = np.maximum(z @ net.w1 + net.b1, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[rows]) / len(rows)
            back = np.outer(d, net.w2) * (h > 0)
            grads = {"w1": z.T @ back + decay * net.w1, "b1": back.sum(0), "w2": h.T @ d + decay * net.w2, "b2": d.sum()}
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
    if len(check):
        logits, truth = net.logits(x[check]), y[check]
        loss = lambda c: np.mean(np.logaddexp(0, -np.where(truth == 1, 1, -1) * logits / c))
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def held_out(id_col: str) -> F.Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most sample labelled rows that are not held out.

    Where several rows share a labelled id, the least of their texts is learned from.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).repartition(8, "id")
    vectors = word_vectors(_context_sums(texts.select("text")))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for part in chunks(batches, "text"):
            x = pooled(part.column("text"), sent.value)
            yield pa.RecordBatch.from_pydict({"id": part.column("id").cast(pa.int64()), "label": part.column("label"), "x": [r.tobytes() for r in x]})

    rows = sorted(texts.mapInArrow(run, "id long, label int, x binary").collect())
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, FEATURES)
    return vectors, fit_network(x, np.array([r.label for r in rows], np.float64))


def _scored(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """__id, __held, __score and __predicted of every row, with the columns keep; a kept text crosses to Python once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept_text = text_col in keep and dict(docs.dtypes)[text_col] == "string"
    text, own = (text_col, []) if kept_text else ("__text", [whole_text(text_col).alias("__text")])
    rows = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("__held"), *own, *keep)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        vectors, net = sent.value
        for part in chunks(batches, text):
            scores = net.scores(pooled(pc.fill_null(part.column(text), ""), vectors))
            cols = {"__id": part.column("__id"), "__held": part.column("__held"), "__score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_pydict(cols | {c: part.column(c) for c in keep})

    schema = f"__id {fields['__id']}, __held boolean, __score double" + "".join(f", `{c}` {fields[c]}" for c in keep)
    return rows.mapInArrow(run, schema).withColumn("__predicted", (F.col("__score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row."""
    out = _scored(docs, model, id_col, text_col, [])
    return out.select(F.col("__id").alias("id"), F.col("__held").alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """Trains on the labelled rows and scores all documents."""
    return score(docs, train(docs, labels, **names), **{k: v for k, v in names.items() if k in ("id_col", "text_col")})


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that are predicted to be of quality."""
    scored = _scored(docs, train(docs, labels, id_col, text_col), id_col, text_col, docs.columns)
    return scored.where("__predicted = 1").select(*docs.columns)
