"""Passages that documents share, exactly or nearly, by compact windows.

Tokens are five-word shingles. Under one hash function, a compact window (l, c, r) stands for all runs of shingles
inside [l, r] that hold c, whose least hash is at c: the nodes of a Cartesian tree over the positions that are least in
some run; nearest smaller positions to the left and right bound them. HASHES functions are used together: where
their windows overlap, a group of runs has one signature, the least shingles under all functions and their distance.

What is enough: a passage of n >= RUN shingles at the similarity 0.8 has at most n / 9 shingles that the other lacks,
and every changed, missing or new word takes four or five of them in a row. So some LEAST shingles in a row are
common, and all of their hashes agree: the signature of that run is the same in both documents, under any functions.

1. Texts that are equal are one text; later copies are passages as a whole.
2. Windows are keyed by their signature. Each is paired with the one of the least id that has its key.
3. Interval join: pairs of two documents whose windows, with RUN shingles around, overlap in both, at about one
   distance, make a candidate region.
4. Candidates are verified on their words: maximal passages of at least WORDS words whose shingles have the Jaccard
   similarity THRESHOLD. The document with the smaller id keeps its passage.
5. The first window of a key may have the signature but not the passage. So windows that no passage found so far
   covers are compared with all windows of their key, in tiles of bounded size, by the shingles around them. Each
   takes the window of a smaller id whose common part goes on furthest to the left, and to the right; these go
   through 3 and 4 again. A tile gives out two pairs for a window at most.
Keys that a sample shows to be frequent are dealt over SALTS tasks; first windows are least over all tasks, so the
sample only decides how rows are dealt, not which are paired.

Edge cases: null, empty and short texts have no passages; rows without an id are left out; rows that share an id and
a text are one; ids are cast to long, and text ids end the job; an empty table gives no rows; extra columns are
ignored; a text of any length is used whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WordTable, chunks, drop_path, hash_words, mixed, shingle_hashes, whole_text, written
from docketry.llm.jaccard_join import only

SHINGLE, WORDS, THRESHOLD = 5, 50, 0.8
#: Shingles of the shortest passage, and of the run that any passage has in common with its like; hash functions.
RUN = WORDS - SHINGLE + 1
LEAST, HASHES = 21, 2
#: How far the distance between two documents' positions may move within a region.
DRIFT = 12
#: Keys with FREQUENT windows in a sample of the texts (SAMPLED of them, FRACTION at most) are dealt over SALTS tasks.
#: Their list is shorter than the sample's windows by that factor.
SALTS, SAMPLED, FRACTION, FREQUENT = 32, 200_000, 0.02, 24
#: Windows of one side of a tile; places to which the shingles around a window are hashed, to count what two share.
TILE, CONTEXT = 8192, 512
#: Windows of a tile that is compared pair by pair.
FEW = 4
#: The share of common shingles from which a run around two windows is tried; passages have 8 / 9.
TRIED = 0.85
#: A window's extent on either side of its centre, in the packed row. Longer ones are cut: any LEAST shingles that two
#: documents share lie in a window of their own, so what is cut off is in the windows beside.
REACH = (1 << 13) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

PASSAGES = "doc_id long, start_word long, n_words long, earlier_id long, earlier_start long, earlier_words long, similarity double"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by least values of blocks from both ends."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _centres(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, centres, marked): where the runs of width values begin in each text, and which value is least in each.

    marked: values with their places in the low bits, which makes them distinct. Ties go to the left.
    """
    bits = max(1, len(values)).bit_length()
    place = np.uint64((1 << bits) - 1)
    marked = values & ~place | np.arange(len(values), dtype=np.uint64)
    least = sliding_least(marked, width)
    whole = lengths >= width
    edge = np.zeros(len(values) + 1, np.int64)
    np.add.at(edge, starts[whole], 1)
    np.subtract.at(edge, starts[whole] + lengths[whole] - width + 1, 1)
    runs = np.flatnonzero(np.cumsum(edge[: len(least)]) > 0)
    return runs, (least[runs] & place).astype(np.int64), marked


def _smaller_before(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each value the nearest smaller one before it in its text, -1 if there is none: its ancestor in the Cartesian tree.

    All values between a place and where its pointer stands are larger, so pointers jump along pointers.
    """
    before = np.arange(-1, len(values) - 1)
    at = np.arange(len(values))
    while len(at):
        to = before[at]
        on = (to >= 0) & (doc[to] == doc[at]) & (values[to] > values[at])
        at = at[on]
        before[at] = before[to[on]]
    before[(before >= 0) & (doc[before] != doc)] = -1
    return before


def compact_windows(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least width values, in each of the texts laid end to end, by c.

    Only positions that are least in some run of width values have such a window, and their nearest smaller
    positions are such too, so the Cartesian tree is built over those alone. Ties go to the left.
    """
    _, c, marked = _centres(values, starts, lengths, width)
    return _windows_at(np.unique(c), marked, starts, lengths)


def _windows_at(c: np.ndarray, marked: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # texts without a shingle share their start with the next text
    doc = np.searchsorted(starts, c, side="right") - 1
    before = _smaller_before(marked[c], doc)
    after = len(c) - 1 - _smaller_before(marked[c][::-1], doc[::-1])[::-1]
    left = np.where(before >= 0, c[before] + 1, starts[doc])
    right = np.where(after < len(c), c[np.minimum(after, len(c) - 1)] - 1, starts[doc] + lengths[doc] - 1)
    return left, c, right


def signed_windows(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, l, c, r): where compact windows of all functions overlap, for each group of runs of LEAST shingles that has
    one signature. c: the centre under the first function; all runs inside [l, r] that hold the centres have the key."""
    centres, windows = [], []
    for f in range(HASHES):
        runs, c, marked = _centres(mixed(h.copy(), f + 1), starts, lengths, LEAST)
        centres.append(c)
        windows.append(_windows_at(np.unique(c), marked, starts, lengths))
    change = np.any([c[1:] != c[:-1] for c in centres], axis=0) | (np.diff(runs) != 1)
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(runs)), bool), change]))
    centres = [c[new] for c in centres]
    left, right = np.full(len(new), -1), np.full(len(new), len(h))
    key = np.zeros(len(new), np.uint64)
    for f, (c, (lows, at, highs)) in enumerate(zip(centres, windows)):
        own = np.searchsorted(at, c)
        left, right = np.maximum(left, lows[own]), np.minimum(right, highs[own])
        key = mixed(key ^ h[c] + (c - centres[0]).astype(np.uint64), f + 101)
    return key, left, centres[0], right


def thinned(key: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows without those between two others of their key, in one document and in one stretch of RUN // 2 places.

    A passage of RUN shingles that holds such a window holds one of the two as well, so texts that go in circles need
    no window at every turn. The two get the extents of all. doc, first: each window's text, and where it starts.
    """
    stretch = (c - first) // (RUN // 2)
    order = np.lexsort((c, stretch, key, doc))
    change = np.any([x[order][1:] != x[order][:-1] for x in (doc, key, stretch)], axis=0)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(c)), bool), change]))
    if not len(starts):
        return key, left, c, right
    ends = np.append(starts[1:], len(c)) - 1
    sizes = ends - starts + 1
    left[order], right[order] = np.repeat(np.minimum.reduceat(left[order], starts), sizes), np.repeat(np.maximum.reduceat(right[order], starts), sizes)
    kept = np.sort(order[np.unique(np.concatenate([starts, ends]))])
    return key[kept], left[kept], c[kept], right[kept]


def _windows(rows: DataFrame) -> DataFrame:
    """(key, id, place): every window of every text."""

    def run(batches):
        table = WordTable(hash_words)
        for part in chunks(batches, "text"):
            numbers, counts = table.number(part.column("text"), lower=True)
            used = np.flatnonzero(counts >= WORDS)
            if not len(used):
                continue
            h, n = shingle_hashes(table.filled()[numbers], counts, SHINGLE)
            starts, n = (np.cumsum(n) - n)[used], n[used]
            ids = part.column("id").to_numpy(zero_copy_only=False)[used]
            key, left, c, right = signed_windows(h, starts, n)
            doc = np.searchsorted(starts, c, side="right") - 1
            key, left, c, right = thinned(key, left, c, right, doc, starts[doc])
            doc = np.searchsorted(starts, c, side="right") - 1
            place = (c - starts[doc]) << 30 | np.minimum(c - left, REACH) << 13 | np.minimum(right - c, REACH)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(place)], names=["key", "id", "place"])

    return rows.mapInArrow(run, "key long, id long, place long")


def _dealt(texts: DataFrame, total: int, made: list[str]) -> DataFrame:
    """The windows with a salt: -1, or for keys that a sample has often the task that a window is dealt to."""
    seen = _windows(texts.sample(min(FRACTION, SAMPLED / max(1, total)), seed=5)) if FRACTION < 1 else _windows(texts)
    often = written(seen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("key", F.lit(True).alias("hot")), "frequent", made)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(-1).cast("long")
    return _windows(texts).join(F.broadcast(often), "key", "left").select("key", "id", "place", salt.alias("salt"))


def _met(dealt: DataFrame) -> DataFrame:
    """(key, id, place, salt): windows whose key another window has too, and all windows of frequent keys."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["key", "id", "place", "salt"]
    rows = dealt.repartition(n, "key", "salt").sortWithinPartitions("key")

    def run(batches):
        held, met = None, False  # the last row, not yet given out, and whether the row before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            table = [batch.column(c).to_numpy(zero_copy_only=False) for c in cols]
            if held is not None:
                table = [np.concatenate(x) for x in zip(held, table)]
            same = table[0][1:] == table[0][:-1]
            give = (np.concatenate([[met], same]) | np.concatenate([same, [False]]) | (table[3] >= 0))[:-1]
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][give]) for x in table], names=cols)
            held, met = [x[-1:] for x in table], bool(same[-1]) if len(same) else met
        if held is not None and (met or held[3][0] >= 0):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=cols)

    return rows.mapInArrow(run, "key long, id long, place long, salt long")


def _paired(met: DataFrame) -> DataFrame:
    """(a, b, place_a, place_b), a < b: each window with the least of its key.

    The least are the same however rows are dealt: they are partial minima, summed before they are shuffled.
    """
    least = met.groupBy("key").agg(F.min(F.struct("id", "place")).alias("head"))
    sent = met.select("key", "salt").distinct().join(least, "key")
    rows = met.join(sent, ["key", "salt"]).where("id != head.id")
    return rows.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.place").alias("place_a"), F.col("place").alias("place_b"))


def _open(met: DataFrame, found: DataFrame) -> DataFrame:
    """met with open: whether no passage found in the window's document holds its least shingle."""
    spans = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    c = F.shiftright("place", 30)
    inside = F.exists("spans", lambda x: (c >= x["start_word"]) & (c + SHINGLE <= x["start_word"] + x["n_words"]))
    return met.join(spans, "id", "left").select("key", "id", "place", "salt", (~F.coalesce(inside, F.lit(False))).alias("open"))


def contexts(h: np.ndarray, c: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each centre c the shingles less than RUN away inside [first, last], as 32-bit hashes in order, 0 for none."""
    around = np.empty((len(c), 2 * RUN - 1), np.uint32)
    for k in range(0, len(c), 1 << 13):
        part = slice(k, k + (1 << 13))
        at = c[part, None] + np.arange(1 - RUN, RUN)
        inside = (at >= first[part, None]) & (at <= last[part, None])
        near = h[np.clip(at, first[part, None], last[part, None])] >> np.uint64(32)
        around[part] = np.where(inside, np.maximum(near, np.uint64(1)), np.uint64(0))
    return around


def counted(around: np.ndarray) -> np.ndarray:
    """How many shingles of each row fall on each of CONTEXT places."""
    at = np.arange(len(around))[:, None] * CONTEXT + (around & np.uint32(CONTEXT - 1))
    return np.bincount(at[around > 0], minlength=len(around) * CONTEXT).reshape(-1, CONTEXT).astype(np.float32)


def _described(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked (key, id, place, open, grid) with around: what stands around each window, from the texts.

    places: those of windows that are alike.
    """
    cols = ["key", "place", "open", "grid"]
    joined = rows.join(asked.groupBy("id").agg(F.collect_list(F.struct(*cols)).alias("asked")), "id").select("id", "text", "asked")

    def run(batches):
        table = WordTable(hash_words)
        for part in chunks(batches, "text"):
            numbers, counts = table.number(part.column("text"), lower=True)
            h, n = shingle_hashes(table.filled()[numbers], counts, SHINGLE)
            lists = part.column("asked")
            per, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            key, place, open_, grid = (flat.field(x).to_numpy(zero_copy_only=False) for x in cols)
            doc = np.repeat(np.arange(len(per)), per)
            first = (np.cumsum(n) - n)[doc]
            last, c = first + n[doc] - 1, first + (place >> 30)
            # an id may have several texts; a window of another one may lie beyond this one's end
            used = np.flatnonzero(c <= last)
            first, last, c = first[used], last[used], c[used]
            around = contexts(h, c, first, last)
            doc = doc[used]
            # windows of one key and document with the same around them, as in texts that go in circles, are compared once
            marks = np.stack([key[used].view(np.uint64), doc.astype(np.uint64), *mixed_rows(around)])
            order = np.lexsort((place[used], *marks))
            heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (np.diff(marks[:, order], axis=1) != 0).any(axis=0)]))
            kept, sizes = order[heads], np.diff(np.append(heads, len(order)))
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(place[used][order]))
            asked_open = np.maximum.reduceat(open_[used][order].astype(np.int8), heads).astype(bool) if len(heads) else np.zeros(0, bool)
            used, around = used[kept], around[kept]
            ids = part.column("id").to_numpy(zero_copy_only=False)[doc[kept]]
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * around.shape[1]), len(kept), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
            made = [pa.array(key[used]), pa.array(ids), places, pa.array(asked_open), pa.array(grid[used]), raw]
            yield pa.RecordBatch.from_arrays(made, names=["key", "id", "places", "open", "grid", "around"])

    return joined.mapInArrow(run, "key long, id long, places array<long>, open boolean, grid int, around binary")


def mixed_rows(around: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row."""
    out = np.zeros((2, len(around)), np.uint64)
    for k in range(around.shape[1]):
        out[0] = mixed(out[0] ^ around[:, k].astype(np.uint64), 2 * k)
        out[1] = mixed(out[1] ^ around[:, k].astype(np.uint64), 2 * k + 1)
    return out


def common_extents(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) for rows of contexts: how far from the centre runs of y go on that x may have too; -1 if none.

    A run holds the centre and RUN shingles or more, begins and ends with common ones, and has TRIED of them.
    """
    left, right = np.full(len(x), -1), np.full(len(x), -1)
    s, e = np.meshgrid(np.arange(RUN), np.arange(RUN - 1, 2 * RUN - 1), indexing="ij")
    fits = e - s >= RUN - 1
    s, e = s[fits], e[fits]
    for k in range(0, len(x), 512):
        part = slice(k, k + 512)
        there = ((y[part, :, None] == x[part, None, :]) & (y[part, :, None] > 0)).any(axis=2)
        upto = np.concatenate([np.zeros((len(there), 1), np.int16), np.cumsum(there, axis=1, dtype=np.int16)], axis=1)
        # RUN shingles at either end of such a run have all that it has, less what is outside them
        some = np.flatnonzero((upto[:, RUN:] - upto[:, :-RUN]).max(axis=1) >= RUN - (1 - TRIED) * (2 * RUN - 1) - 1)
        if not len(some):
            continue
        there, upto, part = there[some], upto[some], some + k
        held = there[:, s] & there[:, e] & (upto[:, e + 1] - upto[:, s] >= TRIED * (e - s + 1))
        left[part] = np.where(held, RUN - 1 - s, -1).max(axis=1)
        right[part] = np.where(held, e - RUN + 1, -1).max(axis=1)
    return left, right


def _tiled(met: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, place_a, place_b), a < b: for each open window b, windows of its key with much alike around them.

    Keys are compared in tiles of about TILE windows a side. What two windows may share has at least TRIED of RUN
    shingles of the later one in the earlier; a matrix product of what is around them counts these, or a few more.
    """
    of_key = met.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max(F.when(F.col("open"), F.col("id"))).alias("hi")).where("hi > lo")
    sizes = met.select("key", "salt").distinct().join(of_key, "key").select("key", "salt", F.ceil(F.col("m") / TILE).cast("int").alias("grid"))
    asked = met.join(sizes, ["key", "salt"]).select("key", "id", "place", "open", "grid")
    own = F.pmod(F.xxhash64("id"), F.col("grid")).cast("int")
    dealt = _described(asked, rows).select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "own", "id", "places", "open", "around")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key", "t", "u").sortWithinPartitions("key", "t", "u")
    names = ["key", "t", "u", "own", "id", "open"]

    def tile(cols):
        key, t, u, own, node, open_, places, around = cols
        change = np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])) + 1
        edges = np.concatenate([[0], change, [len(key)]])
        # for each window the best reach to the left and to the right, and the window that has it
        best, with_ = np.full((2, len(key)), -1), np.full((2, len(key)), -1)
        sizes = np.diff(edges)
        few = np.repeat(sizes <= FEW, sizes)
        for step in range(1, FEW):  # small tiles together, pair by pair
            i = np.flatnonzero(few[:-step] & few[step:] & (np.repeat(edges[1:], sizes)[:-step] > np.arange(len(key))[step:])) if step < len(key) else np.empty(0, np.int64)
            i, j = np.where(node[i] < node[i + step], i, i + step), np.where(node[i] < node[i + step], i + step, i)
            keep = (node[i] != node[j]) & open_[j] & ((t[i] == u[i]) | (own[i] != own[j]))
            i, j = i[keep], j[keep]
            for k in range(0, len(i), 1 << 14):
                improved(around, node, best, with_, i[k : k + (1 << 14)], j[k : k + (1 << 14)])
        for low, high in zip(edges[:-1][sizes > FEW].tolist(), edges[1:][sizes > FEW].tolist()):
            later = low + np.flatnonzero(open_[low:high])
            if not len(later):
                continue
            counts = counted(around[later]).T
            for at in range(low, high, 1024):
                some = np.arange(at, min(high, at + 1024))
                common = (counted(around[some]) > 0).astype(np.float32) @ counts >= int(TRIED * RUN)
                common &= node[some][:, None] < node[later]
                if t[low] != u[low]:
                    common &= own[some][:, None] != own[later]
                i, j = np.nonzero(common)
                for k in range(0, len(i), 1 << 14):
                    improved(around, node, best, with_, some[i[k : k + (1 << 14)]], later[j[k : k + (1 << 14)]])
        pairs = np.unique(np.concatenate([np.stack([with_[side][own_], own_], axis=1) for side in (0, 1) for own_ in [np.flatnonzero(with_[side] >= 0)]]), axis=0)
        if len(pairs):
            i, j = pairs.T
            n = np.fromiter(map(len, places[j]), np.int64, len(j))
            first = np.fromiter((x[0] for x in places[i]), np.int64, len(i))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(np.repeat(x, n) for x in (node[i], node[j], first)), np.concatenate(places[j]))], names=["a", "b", "place_a", "place_b"])

    def improved(around, node, best, with_, i, j):
        for side, reach in enumerate(common_extents(around[i], around[j])):
            order = np.lexsort((node[i], -reach, j))
            first = order[np.concatenate([[True], np.diff(j[order]) != 0])]
            p, q, r = i[first], j[first], reach[first]
            better = (r > best[side][q]) | (r == best[side][q]) & (r >= 0) & (node[p] < node[with_[side][q]])
            best[side][q[better]], with_[side][q[better]] = r[better], p[better]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            cols.append(batch.column("places").to_numpy(zero_copy_only=False))
            cols.append(np.frombuffer(b"".join(batch.column("around").to_pylist()), np.uint32).reshape(len(cols[0]), -1))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from tile([x[:cut] for x in cols])
            held = [x[cut:] for x in cols]
        if held is not None:
            yield from tile(held)

    return dealt.mapInArrow(run, "a long, b long, place_a long, place_b long")


def _regions(pairs: DataFrame) -> DataFrame:
    """(a, b, lo_a, hi_a, lo_b, hi_b): the interval join. Shingle positions that windows cover, and RUN on either side.

    Bounds are rounded outwards, so that a document's regions with its partners are often the same.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select("a", "b", "place_a", "place_b").repartition(n, "a", "b").sortWithinPartitions("a", "b", "place_a")

    def joined(a, b, pa_, pb):
        ca, cb = pa_ >> 30, pb >> 30
        la, ra, lb, rb = ca - (pa_ >> 13 & REACH) - RUN, ca + (pa_ & REACH) + RUN, cb - (pb >> 13 & REACH) - RUN, cb + (pb & REACH) + RUN
        # distances with gaps of at most DRIFT belong together; then intervals of a that overlap
        order = np.lexsort((cb - ca, b, a))
        a, b, ca, cb, la, ra, lb, rb = (x[order] for x in (a, b, ca, cb, la, ra, lb, rb))
        apart = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.diff(cb - ca) > DRIFT)
        group = np.concatenate([[0], np.cumsum(apart)]) * (int(ra.max()) + RUN + 1)
        order = np.lexsort((la, group))
        a, b, la, ra, lb, rb, group = (x[order] for x in (a, b, la, ra, lb, rb, group))
        upto = np.maximum.accumulate(ra + group)
        starts = np.flatnonzero(np.concatenate([[True], (la + group)[1:] > upto[:-1]]))
        low, high = (lambda x: np.maximum(0, np.minimum.reduceat(x, starts)) & ~63), (lambda x: np.maximum.reduceat(x, starts) | 63)
        return [a[starts], b[starts], low(la), high(ra), low(lb), high(rb)]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "place_a", "place_b")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in cols]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*(x[:cut] for x in cols))], names=["a", "b", "lo_a", "hi_a", "lo_b", "hi_b"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*held)], names=["a", "b", "lo_a", "hi_a", "lo_b", "hi_b"])

    return rows.mapInArrow(run, "a long, b long, lo_a long, hi_a long, lo_b long, hi_b long")


def shared_passages(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[list[tuple[int, int, int, int, float]]]:
    """For each pair of word hashes: (start, words) in y and in x, and the similarity, of maximal passages of y that x has."""
    out: list[list] = [[] for _ in xs]
    used = [i for i, (x, y) in enumerate(zip(xs, ys)) if min(len(x), len(y)) >= WORDS]
    if not used:
        return out
    sides = []
    for arrays in (xs, ys):
        n = np.array([len(arrays[i]) for i in used])
        h, n = shingle_hashes(np.concatenate([arrays[i] for i in used]).astype(np.uint64), n, SHINGLE)
        sides.append((h, n, np.cumsum(n) - n))
    (p, pn, p_at), (q, qn, q_at) = sides
    own = mixed(np.arange(len(used), dtype=np.uint64), 7)
    keys, asked = p ^ np.repeat(own, pn), q ^ np.repeat(own, qn)
    order = np.argsort(keys, kind="stable")
    at = np.minimum(np.searchsorted(keys[order], asked), len(p) - 1)
    there = np.where(keys[order][at] == asked, order[at] - np.repeat(p_at, qn), -1)
    hits = np.add.reduceat(there >= 0, q_at)
    for k in np.flatnonzero(hits >= RUN * THRESHOLD).tolist():
        x, y = slice(p_at[k], p_at[k] + pn[k]), slice(q_at[k], q_at[k] + qn[k])
        out[used[k]] = _found(p[x], q[y], there[y])
    return out


def _found(p: np.ndarray, q: np.ndarray, there: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages of q that p has; there: where p has each shingle of q, -1 if nowhere."""
    hit = np.flatnonzero(there >= 0)
    ends = np.flatnonzero(np.diff(hit) > 1)
    first, last = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(hit) - 1]])
    # A passage of n shingles, m of them shared, has a similarity of about m / (2n - m).
    dense = 2 * THRESHOLD / (1 + THRESHOLD)
    out, k = [], 0
    while k < len(first):
        lo, matched, j = hit[first[k]], last[k] - first[k] + 1, k
        while j + 1 < len(first) and (matched + last[j + 1] - first[j + 1] + 1) >= dense * (hit[last[j + 1]] - lo + 1):
            j += 1
            matched += last[j] - first[j] + 1
        found = _measured(p, q, there, lo, hit[last[j]])
        if found:
            out.append(found)
        elif j > k:
            out += [x for x in (_measured(p, q, there, hit[first[i]], hit[last[i]]) for i in range(k, j + 1)) if x]
        k = j + 1
    return out


def _measured(p: np.ndarray, q: np.ndarray, there: np.ndarray, lo: int, hi: int) -> tuple[int, int, int, int, float] | None:
    """The passage of q from lo to hi and its counterpart in p, if they are long and similar enough."""
    if hi - lo + 1 < RUN:
        return None
    at = np.flatnonzero(there[lo : hi + 1] >= 0)
    places = there[lo : hi + 1][at]
    shift = int(np.sort(places - at)[len(at) // 2])
    near = places[np.abs(places - at - shift) <= 2 * DRIFT]
    a_lo, a_hi = int(near.min()), int(near.max())
    s, t = np.unique(p[a_lo : a_hi + 1]), np.unique(q[lo : hi + 1])
    common = len(np.intersect1d(s, t, assume_unique=True))
    similarity = common / (len(s) + len(t) - common)
    if similarity < THRESHOLD:
        return None
    return int(lo), int(hi - lo + SHINGLE), a_lo, int(a_hi - a_lo + SHINGLE), float(similarity)


def _slices(rows: DataFrame, asked: DataFrame, made: list[str]) -> DataFrame:
    """(id, lo, hi, words): 32-bit hashes of the words that a region's shingles cover."""
    lists = written(asked.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("asked")), "asked", made)
    joined = only(rows, lists.select("id"), "left_semi").join(lists, "id")

    def run(batches):
        table = WordTable(hash_words)
        for part in chunks(batches, "text"):
            numbers, counts = table.number(part.column("text"), lower=True)
            words, ends = (table.filled()[numbers] >> np.uint64(32)).astype(np.uint32), np.cumsum(counts)
            lists = part.column("asked")
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            lo, hi = (lists.flatten().field(x) for x in ("lo", "hi"))
            start = (ends - counts)[doc]
            cut = [words[a:b].tobytes() for a, b in zip((start + lo.to_numpy()).tolist(), np.minimum(ends[doc], start + hi.to_numpy() + SHINGLE).tolist())]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), lo, hi, pa.array(cut, pa.binary())], names=["id", "lo", "hi", "words"])

    return joined.select("id", "text", "asked").mapInArrow(run, "id long, lo long, hi long, words binary")


#: Words of regions that are verified at once.
VERIFIED = 1 << 20


def _verified(regions: DataFrame, rows: DataFrame, made: list[str]) -> DataFrame:
    """Passages of the regions, verified word by word."""
    asked = regions.select(F.col("a").alias("id"), F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi"))
    slices = written(_slices(rows, asked.union(regions.select("b", "lo_b", "hi_b")), made), "slices", made)
    side = lambda s: slices.select(F.col("id").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), F.col("words").alias(f"x_{s}"))
    both = regions.join(side("a"), ["a", "lo_a", "hi_a"]).join(side("b"), ["b", "lo_b", "hi_b"]).select("a", "b", "lo_a", "lo_b", "x_a", "x_b")

    def run(batches):
        for batch in batches:
            a, b, lo_a, lo_b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "lo_a", "lo_b", "x_a", "x_b"))
            place = np.cumsum([len(p) + len(q) for p, q in zip(x, y)]) // (4 * VERIFIED)
            out = []
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(place)) + 1):
                found = shared_passages([np.frombuffer(x[i], np.uint32) for i in part], [np.frombuffer(y[i], np.uint32) for i in part])
                out += [(b[i], lo_b[i] + start, n, a[i], lo_a[i] + a_start, a_n, similarity) for i, some in zip(part.tolist(), found) for start, n, a_start, a_n, similarity in some]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.float64())], names=[x.split()[0] for x in PASSAGES.split(", ")])

    return both.mapInArrow(run, PASSAGES)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a document that a document with a smaller id has: PASSAGES."""
    made: list[str] = []
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    name = F.md5(F.col("text").cast("binary"))
    named = written(rows.select("id", name.alias("name")), "named", made)
    total, ids = named.agg(F.count("*"), F.count_distinct("id")).first()
    reps = named.groupBy("name").agg(F.min("id").alias("rep"))
    copies = written(named.join(reps, "name").where("id != rep").distinct(), "copies", made)
    firsts = only(rows, written(copies.select(F.col("rep").alias("id")).distinct(), "firsts", made), "left_semi")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    copied = copies.join(firsts.select(F.col("id").alias("rep"), name.alias("name"), words.alias("n")).distinct(), ["rep", "name"])
    spare = copies.select("id").distinct().join(named.join(reps, "name").where("id = rep").select("id").distinct(), "id", "left_anti")
    texts = only(rows, written(spare, "spare", made), "left_anti")
    texts = texts.dropDuplicates(["id", "text"]) if ids < total else texts

    met = written(_met(_dealt(texts, total, made)), "windows", made)
    regions = written(_regions(_paired(met)), "regions", made)
    found = written(_verified(regions, texts, made).distinct(), "passages", made)
    rest = written(_regions(_tiled(written(_open(met, found), "open", made), texts)), "regions", made)
    found = found.union(_verified(rest, texts, made)).distinct()
    whole = copied.where(f"n >= {WORDS}").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("n_words"), F.col("rep").alias("earlier_id"), F.lit(0).cast("long").alias("earlier_start"), F.col("n").alias("earlier_words"), F.lit(1.0).alias("similarity"))
    out = written(found.union(whole), "shared")
    for path in made:
        drop_path(docs.sparkSession, path)
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans (first word, words); lines that lose all their words go."""
    places = [m.span() for m in _WORD.finditer(text)]
    gone, merged = sorted((a, min(a + n, len(places))) for a, n in spans if a < len(places)), []
    for a, b in gone:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out.append(text[at : places[a][0]])
        at = places[b][0] if b < len(places) else len(text)
    return "".join(out) + text[at:]


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their columns, the passages that earlier documents have cut out of the texts.

    Spans are found by id. Rows of an id that has several different texts stay as they are, since a span does not say
    which of them it was found in; a null text stays null.
    """
    spans = find(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("start_word", "n_words")).alias("__spans"))
    # A document has at most one span for each earlier partner and region; spans are pairs of numbers.
    total, ids = docs.agg(F.count(id_col), F.count_distinct(id_col)).first()
    if ids < total:
        name = F.md5(whole_text(text_col).cast("binary"))
        several = docs.groupBy(F.col(id_col).alias("__doc")).agg(F.min(name).alias("least"), F.max(name).alias("most")).where("least != most").select("__doc")
        spans = spans.join(several, "__doc", "left_anti")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_words(t, [(s["start_word"], s["n_words"]) for s in x]) for t, x in zip(texts, lists)])

    joined = docs.join(spans, docs[id_col] == spans["__doc"], "left")
    hit = joined.where(F.col("__doc").isNotNull()).withColumn(text_col, cut(F.col(text_col), F.col("__spans"))).select(*docs.columns)
    return joined.where(F.col("__doc").isNull()).select(*docs.columns).union(hit)
