"""SentencePiece encoding and decoding in batches of numpy arrays.

A text's words (runs of the space mark and what follows) are segmented apart from each other, since no piece holds a
space mark after another character. Distinct words are grouped by length and advance together, one end position at
a time: hashes of all substrings that end there probe the sorted hashes of the pieces, and a vectorised maximum over
the candidates stores the backpointer.

A unigram model's candidate scores best[start] + score(piece). A BPE model has one right segmentation of every
prefix: the piece that follows its predecessor without a merge across their border. So its candidate scores 0 if the
pair (last piece of the prefix, piece) stays apart when both are built by merges side by side, else minus infinity,
and the maximum finds that one. Characters that are no piece are given as their bytes' pieces, or as the unknown id.

Edge cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded alike; a text of
any length is encoded whole; extra columns are ignored. Decoding gives back every text that the model's normalizer
leaves as it is (here: all that hold no space mark of their own and are valid Unicode).
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WORDS_KEPT, RaggedTable, chunks, mixed, ragged, whole_text

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
_BASE = np.uint64(0x9E3779B1_000001B3)
#: Distinct parts of words whose ids a worker remembers before it starts afresh.
PARTS_KEPT = 600_000
#: Pairs of pieces whose check is remembered: two to this power, each in one place.
MEMO = 21
NEVER = np.int64(1 << 40)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of rows of character codes, all of one length."""
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return mixed(h, codes.shape[1])


class Pieces:
    """A model's pieces: sorted hashes with ids, scores, and for BPE how each piece is built by merges."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, self.bpe = model.normalizer_spec, model.trainer_spec.model_type == 2
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normalizer are read")
        self.prefix = spec.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.kind = np.array([p.type for p in model.pieces])
        if np.any(self.kind == USER):
            raise ValueError("models with user-defined pieces are not read")
        self.score = np.array([p.score for p in model.pieces], np.float64)
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        self.bytes = {int(self.text[i][3:5], 16): int(i) for i in np.flatnonzero(self.kind == BYTE)}
        usable = np.flatnonzero(self.kind == NORMAL)
        if any(SPACE in self.text[i].lstrip(SPACE) for i in usable):
            raise ValueError("pieces that go on after a space are not read")
        self.longest = max(len(self.text[i]) for i in usable)
        hashes = np.concatenate([_hash(np.array([[ord(c) for c in self.text[i]]], np.uint32)) for i in usable])
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], usable[order]
        self.by_text = {self.text[i]: int(i) for i in usable}
        inner = {(ord(a), ord(b)) for i in usable for a, b in zip(self.text[i], self.text[i][1:])}
        self.joints = np.array(sorted(a << 21 | b for a, b in inner), np.int64)
        if self.bpe:
            self._merges()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash; -1: none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def _merges(self) -> None:
        """For each piece its merges in order: their ranks, and the symbols at its left and right ends before each.

        Symbols are ids; a character that is no piece has none and never merges.
        """
        ranks = {t: -self.score[i] for t, i in self.by_text.items()}
        order = {r: k for k, r in enumerate(sorted(set(ranks.values())))}
        self.rank = {t: order[r] for t, r in ranks.items()}
        n, most = len(self.text), self.longest
        self.steps = np.full((n, most), NEVER, np.int64)
        self.left = np.full((n, most), -1, np.int64)
        self.right = np.full((n, most), -1, np.int64)
        self.alone = np.zeros(n, bool)
        for text, i in self.by_text.items():
            symbols, k = list(text), 0
            while True:
                self.left[i, k], self.right[i, k] = self.by_text.get(symbols[0], -1), self.by_text.get(symbols[-1], -1)
                found = [(self.rank[a + b], at) for at, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank]
                if not found:
                    break
                self.steps[i, k], at = min(found)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                k += 1
            self.alone[i] = len(symbols) == 1
        pairs = [(self.by_text[t[:c]], self.by_text[t[c:]], r) for t, r in self.rank.items() for c in range(1, len(t)) if t[:c] in self.by_text and t[c:] in self.by_text]
        key = np.array([a << 20 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key)
        self.pair_keys, self.pair_ranks = key[order], np.array([r for *_, r in pairs], np.int64)[order]
        self.checked, self.answers = np.zeros(1 << MEMO, np.int64), np.zeros(1 << MEMO, bool)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border when pieces a and b are built side by side (ids; -1: a character)."""
        key = (a + 2) << 20 | (b + 2)
        at = (mixed(key.astype(np.uint64)) >> np.uint64(64 - MEMO)).astype(np.int64)
        out = self.answers[at]
        new = np.flatnonzero(self.checked[at] != key)
        if len(new):
            made, back = np.unique(key[new], return_inverse=True)
            out[new] = self._simulated((made >> 20) - 2, (made & (1 << 20) - 1) - 2)[back]
            self.checked[at[new]], self.answers[at[new]] = key[new], out[new]
        return out

    def _simulated(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Runs the merges of both pieces in the order of their ranks; a crossing merge of better rank fails the pair.

        Of equal ranks the leftmost goes first: a's own, then the crossing, then b's own.
        """
        ok = (a >= 0) & (b >= 0)
        out = np.ones(len(a), bool)
        live = np.flatnonzero(ok)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            x, y, p, q = a[live], b[live], i[live], j[live]
            own, other = self.steps[x, p], self.steps[y, q]
            l, r = self.right[x, p], self.left[y, q]
            key = l << 20 | r
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            cross = np.where((l >= 0) & (r >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], NEVER)
            crossed = (cross < own) & (cross <= other) & (cross < NEVER)
            out[live[crossed]] = False
            first = ~crossed & (own <= other) & (own < NEVER)
            second = ~crossed & ~first & (other < NEVER)
            i[live[first]] += 1
            j[live[second]] += 1
            live = live[first | second]
        return out


def segment(model: Pieces, words: list[str]) -> list[list[int]]:
    """The ids of each word, by batches of words of one length."""
    out: list[list[int]] = [[] for _ in words]
    by_length: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by_length.setdefault(len(word), []).append(k)
    for length, own in by_length.items():
        size = max(1, 2_000_000 // max(1, length * model.longest))
        for at in range(0, len(own), size):
            part = own[at : at + size]
            codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
            for k, ids in zip(part, _viterbi(model, codes)):
                out[k] = ids
    return out


def _viterbi(model: Pieces, codes: np.ndarray) -> list[list[int]]:
    n, length = codes.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, n), np.int64)
    last = np.full((length + 1, n), -1, np.int64)  # the piece that ends at each position; -1: a lone character
    # running hashes: prefix[s] holds the hash of codes[s:end] while end advances
    running = np.zeros((length, n), np.uint64)
    lowest = model.score.min() - 10
    for end in range(1, length + 1):
        code = codes[:, end - 1].astype(np.uint64) + np.uint64(1)
        first = max(0, end - model.longest)
        with np.errstate(over="ignore"):
            running[first:end] = running[first:end] * _BASE + code
        ids = np.stack([model.find(mixed(running[s].copy(), end - s)) for s in range(first, end)])
        spans = np.arange(first, end)
        if model.bpe:
            score = np.full(ids.shape, -np.inf)
            for row, s in enumerate(spans):
                cand = np.flatnonzero(ids[row] >= 0) if s < end - 1 else np.arange(n)
                cand = cand[best[s, cand] == 0]
                if not len(cand):
                    continue
                piece = ids[row, cand]
                fits = model.alone[piece] | (piece < 0) | (end - s == 1)
                if s:
                    fits = fits & model.apart(last[s, cand], piece)
                score[row, cand[fits]] = 0
        else:
            score = np.where(ids >= 0, best[first:end] + model.score[ids], -np.inf)
            single = len(spans) - 1
            score[single] = np.where(ids[single] >= 0, score[single], best[end - 1] + lowest)
        choice = np.argmax(score, axis=0)
        best[end] = score[choice, np.arange(n)]
        back[end] = spans[choice]
        last[end] = ids[choice, np.arange(n)]
    out: list[list[int]] = []
    for w in range(n):
        end, found = length, []
        while end:
            start = int(back[end, w])
            piece = int(last[end, w])
            if piece >= 0:
                found.append(piece)
            elif model.bytes:
                found += [model.bytes[x] for x in reversed(chr(codes[w, end - 1]).encode("utf-8", "replace"))]
            else:
                found.append(model.unknown)
            end = start
        out.append(found[::-1])
    return out


class Encoder(RaggedTable):
    """Encodes whole texts; distinct words, and their distinct parts, are segmented once while they are remembered."""

    def __init__(self, path: str):
        super().__init__()
        self.model, self.parts = Pieces(path), {}

    def split(self, text: str) -> list[str]:
        """The words of a text, space marks first."""
        if not text:
            return []
        marked = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        words = marked.split(SPACE)
        out, marks = ([words[0]] if words[0] else []), 0
        for word in words[1:]:
            marks += 1
            if word:
                out.append(SPACE * marks + word)
                marks = 0
        if marks:
            out.append(SPACE * marks)
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Words are cut where no piece has the two characters side by side, as no merge can cross there."""
        if len(self.parts) > PARTS_KEPT:
            self.parts.clear()
        texts = [w.decode("utf-8", "replace") for w in words]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        pair, joints = codes[:-1] << 21 | codes[1:], self.model.joints
        cut = joints[np.minimum(np.searchsorted(joints, pair), len(joints) - 1)] != pair
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        cut[ends[:-1] - 1] = True
        bounds = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(codes)]]).tolist()
        whole = "".join(texts)
        cuts = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
        parts = self.parts
        new = [x for x in dict.fromkeys(cuts) if x not in parts]
        parts.update(zip(new, segment(self.model, new)))
        out, at = [], 0
        per_word = np.diff(np.searchsorted(bounds, np.concatenate([[0], ends]))).tolist()
        for n in per_word:
            out.append(parts[cuts[at]] if n == 1 else [i for x in cuts[at : at + n] for i in parts[x]])
            at += n
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's count."""
        if len(self) > WORDS_KEPT:
            self.forget()
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}").to_numpy(zero_copy_only=False)
        if not self.model.prefix:
            odd[:] = True
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        found = lists.flatten().dictionary_encode()
        mark = SPACE.encode()
        own = [mark + w for w in found.dictionary.cast(pa.large_binary()).to_pylist()]
        place = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
        plain = place[found.indices.to_numpy(zero_copy_only=False)]
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        split = [[self[w.encode("utf-8", "replace")] for w in self.split(x)] for x in texts.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(x) for x in split]
        numbers = np.empty(int(counts.sum()), np.int64)
        starts = np.cumsum(counts) - counts
        numbers[ragged(starts[~odd], counts[~odd])] = plain
        numbers[ragged(starts[odd], counts[odd])] = np.array(list(chain.from_iterable(split)), np.int64)
        return self.spread(numbers, counts)

    def text(self, ids: np.ndarray) -> str:
        """What ids decode to; bytes that are no whole character become the replacement character."""
        model, out, raw = self.model, [], bytearray()
        kinds = model.kind[ids]
        for i, kind in zip(ids.tolist(), kinds.tolist()):
            if kind == BYTE:
                raw.append(int(model.text[i][3:5], 16))
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw.clear()
            if kind == NORMAL:
                out.append(model.text[i])
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(_characters(bytes(raw)))
        joined = "".join(out).replace(SPACE, " ")
        return joined[1:] if model.prefix and joined.startswith(" ") else joined


def _characters(raw: bytes) -> str:
    """UTF-8, each stray byte as one replacement character."""
    return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, which later tasks use again."""
    return Encoder(path)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, digest: bool = False) -> DataFrame:
    """(id, ids) of every text; if asked for, ids_crc32 (ids as little-endian 32-bit integers) and what they decode to."""
    path = model or default_model()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches):
        made = encoder(path)
        for part in chunks(batches, "text"):
            flat, counts = made.ids(part.column("text"))
            found = np.split(flat.astype(np.int32), np.cumsum(counts)[:-1])
            cols = {"id": part.column("id"), "ids": pa.array(found, pa.list_(pa.int32()))}
            if digest:
                cols["ids_crc32"] = pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in found], pa.int64())
            if decoded:
                cols["decoded"] = pa.array([made.text(x) for x in found], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, ids array<int>" + ", ids_crc32 long" * digest + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """rows with the column decoded: the text of each row's ids, null for null."""
    path = model or default_model()

    @F.pandas_udf("string")
    def text(col):
        made = encoder(path)
        return col.map(lambda x: None if x is None else made.text(np.asarray(x, np.int64)))

    return rows.withColumn("decoded", text(ids_col))
