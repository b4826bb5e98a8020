"""Language of a text by unigram models of pieces, summed over all segmentations.

The pieces are those of a public vocabulary that consist of letters, in lower case, with or without the mark of a word's
start; the vocabulary is fixed and never trained. A language has a probability for each piece, and the probability of a
word is the sum over all its segmentations into pieces, which the forward algorithm gives: words of one length advance
together, one end position at a time, and hashes of the substrings that end there probe the sorted hashes of the pieces.
A character that is no piece counts with a fixed small probability in every language. A text's score is the posterior
of its language, from its words and the languages' shares of the training texts.

Training: words of all texts that may be learned from are counted by language on Spark, then the probabilities are
fitted to the counts by expectation maximisation. In the forward pass each position's sum is split among the pieces that
end there; going backwards, the chance that a segmentation has a border at a position is dealt out by these shares,
which gives the expected count of every piece. Only sums by piece and language come to the driver.

Edge cases: a null text or one without a letter is `und` with score 0, as is everything if nothing can be learned;
null ids are scored, never held out and never learned from; rows without a language are scored alone; repeated rows
are scored alike; ties go to the language that sorts first; words of any length are scored whole (in training, words of
more than STRETCH letters are counted in stretches); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WORDS_KEPT, WordTable, chunks, mixed, whole_text, word_codes, written
from docketry.llm.importance import read_words

START = "▁"
#: Rounds of expectation maximisation; counts that each piece has beforehand; probability of a character that is no piece.
ROUNDS, BEFORE, STRANGE = 3, 0.05, 1e-7
#: Letters of a word that training counts at once; numbers that a batch of words may fill; pieces that travel in one row.
STRETCH, CELLS, SLICE = 4096, 1 << 22, 1024
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B1_000001B3)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The lettered pieces of a SentencePiece model in lower case, in sorted order, found by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        self.pieces = sorted({t for t in texts if t.removeprefix(START).isalpha() or t == START})
        self.longest = max(map(len, self.pieces))
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(self.pieces):
            by_length.setdefault(len(t), []).append(i)
        keys, ids = [], []
        for n, own in by_length.items():
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in own], np.uint64)
            keys.append(self._end_hashes(codes, n)[-1][:, -1])
            ids += own
        order = np.argsort(np.concatenate(keys))
        self.keys, self.ids = np.concatenate(keys)[order], np.array(ids, np.int32)[order]
        self.may = np.zeros(1 << 20, bool)
        self.may[self.keys & np.uint64(len(self.may) - 1)] = True
        #: Numbers of a substring that is no piece, and of a character that is none.
        self.nothing, self.strange = len(self.pieces), len(self.pieces) + 1

    def _end_hashes(self, codes: np.ndarray, longest: int):
        """For n up to longest, hashes of the n characters that end at each column; columns before the n-th are missing."""
        out, power, h = [], np.uint64(1), np.zeros(codes.shape, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, longest + 1):
                h = h[:, 1:] if n > 1 else h
                h = h + (codes[:, : codes.shape[1] - n + 1] + np.uint64(1)) * power
                power *= _BASE
                out.append(mixed(h, n))
        return out

    def find(self, codes: np.ndarray) -> np.ndarray:
        """(length, word, end): the piece of each length that ends at each character of words of one length."""
        words, n = codes.shape
        longest = min(self.longest, n)
        out = np.full((longest, words, n), self.nothing, np.int32)
        for k, h in enumerate(self._end_hashes(codes.astype(np.uint64), longest)):
            rows, cols = np.nonzero(self.may[h & np.uint64(len(self.may) - 1)])
            probe = h[rows, cols]
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            hit = self.keys[at] == probe
            out[k, rows[hit], cols[hit] + k] = self.ids[at[hit]]
        out[0][out[0] == self.nothing] = self.strange
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def runs_of(words: list[bytes]) -> list[list[str]]:
    """The runs of letters, in lower case, of words that read_words() leaves between spaces."""
    import regex

    find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
    texts = (w.decode("utf-8", "replace").lower() for w in words)
    return [[t] if t.isalpha() else find(t) for t in texts]


def _coded(runs: list[str]):
    """(positions, codes) of runs with the start mark, by length, in batches of bounded size."""
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(runs):
        by_length.setdefault(len(r) + 1, []).append(i)
    for n, at in sorted(by_length.items()):
        step = max(1, CELLS // (n * 64))
        for x in range(0, len(at), step):
            own = at[x : x + step]
            joined = "".join(START + runs[i] for i in own)
            yield np.array(own), np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(own), n)


def forward(codes: np.ndarray, words: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, for words of one length (rows) and each column of chances.

    Sums are scaled to 1 at each position; long words go on block by block with what the longest piece needs.
    """
    (count, n), kinds = codes.shape, chances.shape[1]
    window, logs = np.zeros((words.longest, count, kinds)), np.zeros((count, kinds))
    window[0] = 1.0
    block = max(words.longest, CELLS // (16 * words.longest * count))
    for start in range(0, n, block):
        before = min(start, words.longest - 1)
        found = words.find(codes[:, start - before : start + block])[:, :, before:]
        for i in range(found.shape[2]):
            ends = found[:, :, i]
            total = np.einsum("lwk,lwk->wk", window[: len(ends)], chances[ends])
            logs += np.log(total)
            window[1:] = window[:-1] / total
            window[0] = 1.0
    return logs


def expected(codes: np.ndarray, counts: np.ndarray, words: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces in words of one length that occur counts times, under one language's chances."""
    found = words.find(codes)
    longest, count, n = found.shape
    shares, window = np.empty((n, longest, count)), np.zeros((longest, count))
    window[0] = 1.0
    for i in range(n):
        shares[i] = window * chances[found[:, :, i]]
        total = shares[i].sum(axis=0)
        shares[i] /= total
        window[1:] = window[:-1] / total
        window[0] = 1.0
    border = np.zeros((n + 1, count))
    border[n] = counts
    for i in range(n - 1, -1, -1):
        shares[i] *= border[i + 1]
        for k in range(min(longest, i + 1)):
            border[i - k] += shares[i, k]
    return np.bincount(found.transpose(2, 0, 1).ravel(), shares.ravel(), minlength=words.strange + 1)


@dataclass
class Model:
    """Languages in sorted order, the log of their shares, and each piece's probability in each."""

    path: str
    languages: list[str]
    shares: np.ndarray
    chances: np.ndarray

    def words(self, words: list[bytes]) -> np.ndarray:
        """For each word between white space its log probability in each language, and its number of runs of letters."""
        runs = runs_of(words)
        places = {r: k for k, r in enumerate(dict.fromkeys(r for own in runs for r in own))}
        logs = np.zeros((len(places), len(self.languages)))
        for at, codes in _coded(list(places)):
            logs[at] = forward(codes, vocabulary(self.path), self.chances)
        out = np.zeros((len(words), len(self.languages) + 1))
        owner = np.repeat(np.arange(len(words)), [len(own) for own in runs])
        which = np.array([places[r] for own in runs for r in own], np.int64)
        np.add.at(out[:, :-1], owner, logs[which])
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out


def _chances(counts: np.ndarray) -> np.ndarray:
    """Probabilities from counts by piece, with those of what is no piece behind them."""
    known = counts + BEFORE
    return np.concatenate([(1 - STRANGE) * known / known.sum(), [0.0, STRANGE]])


def held_out(id_col: str) -> F.Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): how often each run of letters occurs in texts (lang, text) of each language."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            langs, words = zip(*seen)
            return pa.RecordBatch.from_pydict({"lang": pa.array(langs), "word": pa.array(words), "n": pa.array(list(seen.values()), pa.int64())})

        for part in chunks(batches, "text"):
            codes, words, counts = word_codes(read_words(part.column("text")))
            own = part.column("lang").dictionary_encode()
            lang = np.repeat(own.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
            pair, n = np.unique(lang * len(words) + codes, return_counts=True)
            runs, names = runs_of(words.to_pylist()), own.dictionary.to_pylist()
            for p, k in zip(pair.tolist(), n.tolist()):
                for r in runs[p % len(words)]:
                    for x in range(0, len(r), STRETCH):
                        seen[names[p // len(words)], r[x : x + STRETCH]] += k
            if len(seen) > WORDS_KEPT:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _round(words: DataFrame, model: Model) -> np.ndarray:
    """(language, piece): expected counts over the whole table of words."""
    sent = words.sparkSession.sparkContext.broadcast(model)
    size = model.chances.shape[0]

    def run(batches):
        own, total = vocabulary(sent.value.path), {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("word").to_pylist()
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            for lang in set(langs):
                at = [i for i, x in enumerate(langs) if x == lang]
                k = sent.value.languages.index(lang)
                for rows, codes in _coded([texts[i] for i in at]):
                    sums = expected(codes, n[at][rows], own, sent.value.chances[:, k])
                    total[k] = total.get(k, 0.0) + sums
        for k, sums in total.items():
            for x in range(0, size, SLICE):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "at": pa.array([x], pa.int32()), "sums": [sums[x : x + SLICE].tobytes()]})

    def add(pdf):
        total = sum(np.frombuffer(raw, np.float64) for raw in pdf["sums"])
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "at": pdf["at"].iloc[:1], "sums": [total.tobytes()]})

    out = np.zeros((len(model.languages), size))
    schema = "k int, at int, sums binary"
    for k, at, raw in words.mapInArrow(run, schema).groupBy("k", "at").applyInPandas(add, schema).collect():
        out[k, at : at + SLICE] = np.frombuffer(raw, np.float64)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, rounds: int = ROUNDS) -> Model:
    """The model from all rows with a language that are not held out."""
    path = path or default_vocabulary()
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))
    sizes = sorted((r.lang, r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    own, total = vocabulary(path), sum(n for _, n in sizes)
    shares = np.log(np.array([n / total for _, n in sizes])) if sizes else np.empty(0)
    model = Model(path, [lang for lang, _ in sizes], shares, np.tile(_chances(np.ones(len(own.pieces)))[:, None], (1, len(sizes))))
    if sizes:
        words = written(word_counts(known), "words")
        for _ in range(rounds):
            model.chances = np.stack([_chances(row[: len(own.pieces)]) for row in _round(words, model)], axis=1)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))

    def run(batches):
        own = sent.value
        kinds = len(own.languages)
        names, table = pa.array([*own.languages, UNDETERMINED], pa.string()), WordTable(own.words)
        for part in chunks(batches, "text"):
            numbers, counts = table.number(read_words(part.column("text")))
            known, docs = table.filled(), np.repeat(np.arange(len(counts)), counts)
            logs = np.stack([np.bincount(docs, known[numbers, k], len(counts)) for k in range(kinds + 1)], axis=1)
            read = logs[:, -1] > 0 if kinds else np.zeros(len(counts), bool)
            logs = logs[:, :-1] + own.shares
            best = np.where(read, logs.argmax(axis=1), kinds) if kinds else np.zeros(len(counts), np.int64)
            score = np.where(read, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0) if kinds else np.zeros(len(counts))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "held_out": part.column("held_out"), "lang_pred": names.take(pa.array(best)), "score": score})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **names) -> DataFrame:
    """Trains on the rows with a language that are not held out, and scores all."""
    return predict(docs, train(docs, **names), **{k: v for k, v in names.items() if k in ("id_col", "text_col")})
