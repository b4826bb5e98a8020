"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document's full windows go out at once; its rest goes to the
open window with the least room that holds it (best fit). When none fits, the fullest window goes out and a new one
opens. The windows that are left open at the end of the partitions are merged: partitions' leftovers meet in groups
and are packed again, whole windows at a time, by the same rule.

Edge cases: a null text is an empty document, which has the end id alone; null ids and repeated rows are packed like
any others; an empty table gives no rows; extra columns are ignored; a text of any length is cut into full windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import tokens
from docketry.llm.common import chunks, scratch, whole_text

LENGTH, OPEN = 2048, 256
#: Partitions whose leftover windows are merged in one task.
MERGED = 64
PIECES = "id long, start long, length long, doc_tokens long, ids binary, window long, offset long, open boolean"


class Packer:
    """The open windows of one partition. place() puts a piece; what it emits is kept in done."""

    def __init__(self, length: int, most: int, first: int = 0):
        self.length, self.most, self.next = length, most, first
        self.open: list[tuple[int, int]] = []  # (room, window), least room first
        self.held: dict[int, list] = {}
        self.done: list = []

    def place(self, size: int, piece: tuple) -> tuple[int, int]:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.done += self.held.pop(self.open.pop(0)[1])
            room, window = self.length, self.next
            self.next += 1
        row = (*piece, window, self.length - room)
        if room == size:
            self.done += [*self.held.pop(window, []), row]
        else:
            self.held.setdefault(window, []).append(row)
            insort(self.open, (room - size, window))
        return window, self.length - room


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int, length: int, most: int) -> DataFrame:
    """Pieces as their windows are emitted; open: those of windows that were left open at the partition's end.

    Window numbers hold the partition's number in their upper bits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        packer = Packer(length, most, TaskContext.get().partitionId() << 33)
        made = tokens.tokenizer(vocabulary)
        for batch in chunks(batches, "text"):
            ids, counts = tokens.with_end(*made.ids(batch.column("text")), end_id)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
            for key, at, n in zip(batch.column("id").to_pylist(), bounds.tolist(), counts.tolist()):
                for start in range(0, n, length):
                    size = min(length, n - start)
                    packer.place(size, (key, start, size, n, bytes(raw[4 * (at + start) : 4 * (at + start + size)])))
            if packer.done:
                yield _batch(packer.done, False)
                packer.done = []
        if packer.held:
            yield _batch([row for window in packer.held.values() for row in window], True)

    return rows.mapInArrow(run, PIECES)


def _batch(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
    names = ["id", "start", "length", "doc_tokens", "ids", "window", "offset"]
    cols = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(cols + [pa.array([is_open] * len(rows), pa.bool_())], names=names + ["open"])


def merges(leftovers: DataFrame, length: int, most: int) -> DataFrame:
    """(window, into, shift): where the pieces of each leftover window go."""
    grouped = leftovers.groupBy("window").agg(F.sum("length").alias("length")).select("window", "length", F.floor(F.shiftright("window", 33) / MERGED).alias("at"))
    n = int(leftovers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = grouped.repartition(n, "at").sortWithinPartitions("at", F.desc("length"), "window")

    def run(batches):
        packer, at, first = None, None, {}
        for batch in batches:
            out = []
            for window, size, group in zip(*(batch.column(c).to_pylist() for c in ("window", "length", "at"))):
                if group != at:
                    packer, at, first = Packer(length, most), group, {}
                own, shift = packer.place(size, ())
                packer.done = []
                out.append((window, first.setdefault(own, window), shift))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["window", "into", "shift"])

    return ranged.mapInArrow(run, "window long, into long, shift long")


def pack(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID,
    length: int = LENGTH, most: int = OPEN,
) -> DataFrame:
    """(id, start, length, doc_tokens, ids, sequence_id, offset) of every piece; ids as little-endian 32-bit integers."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "pieces")
    pieces(docs, vocabulary or tokens.default_vocabulary(), id_col, text_col, end_id, length, most).write.partitionBy("open").parquet(path)
    made = spark.read.schema(PIECES).parquet(path)
    left = made.where("open")
    moved = merges(left.select("window", "length"), length, most)
    cols = ["id", "start", "length", "doc_tokens", "ids"]
    placed = left.join(moved, "window").select(*cols, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return made.where("NOT open").select(*cols, F.col("window").alias("sequence_id"), "offset").union(placed)
