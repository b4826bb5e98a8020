"""Exact top-k inner products by no-random-access aggregation.

Vectors are turned into integers, floor(scale * x). Rows are packed into blocks; in each block every dimension has
one sorted list. A query reads all lists from their best ends, step by step, and adds what it reads to its rows'
sums. A row's lower bound is its sum and each unread list's worst value, its upper bound its sum and each unread list's
last read value. A query stops when few rows outside can still reach the k-th lower bound, and resolves the final
scores of those that can; at the end of the lists the sums are the scores. A block's result is exact, so the best k
over all blocks are.

The query set meets all rows in places, each of up to HELD blocks of rows: queries, the smaller side, go to each place
once and stream through it. A place's blocks take turns on some thousands of queries, and what a query has found in one
block bounds its search in the next. So a task holds one place's rows and those queries, and what is shuffled is each row
once and each query once a place; vectors travel in the narrowest integers that hold them.

Sums are doubles where scores stay below 2 ** 53, and wider numbers, up to Python's integers, in blocks and for queries
where they might not, so they are always exact.

Edge cases: vectors that are null or hold null or non-finite components, or ones whose integers no long holds, take no
part, as query or candidate; a score that no long holds ends the job; vectors of another length are no candidates; ties go to the smaller id, a null id last; rows that share the query's id count as its own;
an empty table gives no rows; extra columns are ignored; ids are cast to long, and text ids end the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import give_back, written

SCALE, ROWS, QUERIES = 256, 4096, 256
#: Blocks of rows in a place, at most, on average; places that there are before they get more than one block; chunks of queries on which blocks take turns.
HELD, SPREAD, TURN = 32, 64, 16
#: Parts of a list that are read when bounds are compared; each step goes four times as deep as the one before.
PARTS = (32, 8, 2, 1)
_NO_ID = np.iinfo(np.int64).max


class SortedLists:
    """The rows of one block with a sorted list for each dimension, read from either end.

    Queries advance together: a list gives the same entries to all queries that read it from one end, so a step's
    entries, placed by row, reach all sums in one matrix product. read and entries count what queries have read, and
    what there was to read.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, order, axis=0)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(rows))[:, None], rows.shape), axis=0)
        # depth at which a row is read: lists from their ends, for positive weights, then from their starts
        self.at = np.vstack([len(rows) - 1 - rank.T, rank.T])
        self.most = max((abs(int(x)) for x in (rows.min(initial=0), rows.max(initial=0))), default=0)
        self.values = np.vstack([rows.T, rows.T]).astype(np.float64)
        self.read = self.entries = 0

    def _exact(self, queries: np.ndarray) -> type:
        """The numbers in which all sums of these queries are exact."""
        bound = self.most * max(abs(int(x)) for x in (queries.min(initial=0), queries.max(initial=0))) * max(1, self.rows.shape[1])
        if bound < 1 << 53:
            return np.float64
        return np.longdouble if bound < 1 << 63 and np.finfo(np.longdouble).nmant >= 63 else object

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and exact scores of its k best rows, but for those with its own id.

        Rows below a query's floor, a score that k rows elsewhere reach, may be left out.
        """
        (n, dims), out = self.rows.shape, [None] * len(queries)
        kind = self._exact(queries)
        values = self.values if kind is np.float64 else np.vstack([self.rows.T, self.rows.T]).astype(kind)
        active, depth, sums = np.arange(len(queries)), 0, np.zeros((len(queries), n), kind)
        weights = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
        mine = own[:, None] == self.ids
        floor = np.full(len(queries), -np.inf) if floor is None else floor.astype(kind) if kind is not object else floor
        self.entries += n * dims * len(queries)
        for to in [-(-n // part) for part in PARTS]:
            sums += weights @ np.where((self.at >= depth) & (self.at < to), values, kind(0) if kind is not object else 0)
            self.read += (to - depth) * dims * len(active)
            depth = to
            if depth == n:
                sums[mine] = -np.inf
                for q, scores, others, least in zip(active.tolist(), sums, ~mine, np.maximum(self._kth(sums, k), floor)):
                    able = np.flatnonzero((scores >= least) & others)
                    out[q] = self._best(able, self._longs(scores[able]), k)
                break
            lower, upper = self._bounds(sums, weights, depth)
            slack = 1e-9 * (1 + np.abs(upper).max(axis=1, initial=0)) if kind is not object else 0
            lower[mine] = upper[mine] = -np.inf
            able = (upper >= (np.maximum(self._kth(lower, k), floor) - slack)[:, None]).astype(bool) & ~mine
            ends = able.sum(axis=1) <= max(8 * k, n // 32)
            for c in np.flatnonzero(ends).tolist():
                rest, q = np.flatnonzero(able[c]), active[c]
                out[q] = self._best(rest, self._longs(self.rows[rest].astype(object) @ queries[q].astype(object) if kind is object else self.rows[rest] @ queries[q]), k)
            if ends.all():
                break
            active, sums, weights, mine, floor = active[~ends], sums[~ends], weights[~ends], mine[~ends], floor[~ends]
        return out

    def _longs(self, scores: np.ndarray) -> np.ndarray:
        return np.array([int(x) for x in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)

    def _kth(self, scores: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query; below all where there are fewer rows."""
        n = scores.shape[1]
        if scores.dtype == object:
            return np.sort(scores, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)
        return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)

    def _bounds(self, sums: np.ndarray, weights: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all rows' scores when every list has given depth entries."""
        n = len(self.ids)
        unread = (self.at >= depth).astype(weights.dtype)
        worst, last = (np.hstack(x).astype(weights.dtype) for x in ([self.sorted[0], self.sorted[-1]], [self.sorted[n - depth], self.sorted[depth - 1]]))
        return sums + (weights * worst) @ unread, sums + (weights * last) @ unread

    def _best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, width, ids, data): rows packed as they lie in their partition, in integers of width bytes."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            lists = batch.column("vector")
            n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
            ends, ids = np.cumsum(n), batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                rows = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                held.setdefault(int(dim), []).append((ids[at], rows))
                if sum(len(x) for x, _ in held[int(dim)]) >= size:
                    yield from _emit(int(dim), held.pop(int(dim)), size)
        for dim, parts in held.items():
            yield from _emit(dim, parts, size)

    def _emit(dim, parts, size):
        ids, rows = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
        for at in range(0, len(ids), size):
            some = rows[at : at + size]
            width = next(w for w in (2, 4, 8) if w == 8 or (some.min(initial=0) >= -(1 << 8 * w - 1) and some.max(initial=0) < 1 << 8 * w - 1))
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "width": pa.array([width], pa.int32()), "ids": [ids[at : at + size].astype("<i8").tobytes()], "data": [some.astype(f"<i{width}").tobytes()]})

    return vectors.mapInArrow(run, "dim int, width int, ids binary, data binary")


def _unpacked(dim: int, width: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(len(ids), dim)


def _answers(blocks: list[tuple], asked: list[tuple], k: int, size: int):
    """Batches of (query_id, vec_id, score): the k best of these packed blocks' rows for these packed queries."""
    own, queries = (np.concatenate(x) for x in zip(*[_unpacked(*x) for x in asked]))
    parts = [slice(at, at + size) for at in range(0, len(own), size)]
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own)
    floor = np.full(len(own), -np.inf, object)
    for block in blocks:
        lists = SortedLists(*_unpacked(*block))
        for part in parts:
            for q, (ids, scores) in enumerate(lists.top(queries[part], own[part], k, floor[part]), part.start):
                ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                first = np.lexsort((ids, -scores))[:k]
                best[q] = ids[first], scores[first]
                if len(first) == k:
                    floor[q] = int(scores[first[-1]])
    for part in parts:
        out = [(q, v, s) for q, (found, scores) in zip(own[part].tolist(), best[part]) for v, s in zip(found.tolist(), scores.tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])


def search(
    vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
    rows: int = ROWS, queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row."""
    vector = F.col(vector_col)
    held = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0**62
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & held(x))
    kept = vectors.where(whole).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("ask"),
        F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("vector"),
    )
    blocks = written(_blocks(kept.select("id", "vector"), rows), "blocks")
    asking = _blocks(kept.where("ask AND id IS NOT NULL").select("id", "vector"), queries)
    n = blocks.count()
    places = max(1, min(n, SPREAD), -(-n // HELD))
    asking = asking.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).withColumn("asks", F.lit(True))
    blocks = blocks.withColumn("place", F.pmod(F.xxhash64("ids"), F.lit(places)).cast("int")).withColumn("asks", F.lit(False))

    def run(batches):
        # a place's blocks of one length come before the queries of that length
        at, held, asked, waiting = None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["place"], row["dim"]) != at:
                    if held and asked:
                        yield from _answers(held, asked, k, queries)
                    at, held, asked, waiting = (row["place"], row["dim"]), [], [], 0
                packed = row["dim"], row["width"], row["ids"], row["data"]
                if not row["asks"]:
                    held.append(packed)
                elif held:
                    asked.append(packed)
                    waiting += len(row["ids"]) // 8
                    if waiting >= TURN * queries:
                        yield from _answers(held, asked, k, queries)
                        asked, waiting = [], 0
        if held and asked:
            yield from _answers(held, asked, k, queries)
        give_back()

    together = blocks.unionByName(asking).repartition(places, "place").sortWithinPartitions("place", "dim", "asks")
    found = together.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")
