"""Token ids in binary files of compressed bit planes.

A file holds the documents of one id range. Its ids are cut into blocks of a fixed size; each block is transposed
into bit planes (plane k holds bit k of every id) or byte planes, and each plane is compressed by zstandard. Planes
above the block's largest id are left out. The chunk index, at the end, has each block's place and plane lengths,
so one block is read by one seek.

    file    = MAGIC, planes of block 0, planes of block 1, ..., index, length of index (8 bytes), MAGIC
    index   = zstandard of JSON {block, kind, n_ids, chunks: [[place, ids, [plane lengths]]], docs: [ids of each],
              keys: [doc ids]}

Files go to the shared folder under a temporary name and are renamed when whole, so a task that is lost and run
again leaves the same file. Edge cases: a null text is an empty document, which has the end id alone; null ids come
first, ties are ordered by the text; repeated rows are kept; an empty table gives no rows; extra columns are
ignored; a text of any length is cut into blocks.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import tokens
from docketry.llm.common import chunks, scratch, whole_text

MAGIC = b"DKTPLN01"
BLOCK = 1 << 16


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block, lowest first, up to the highest that has a bit set."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(-(-top // 8))]
    bits = np.unpackbits(raw[:, : -(-top // 8)], axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(top)]


def ids_of(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The ids of one block from its planes."""
    if kind == "byte":
        raw = np.zeros((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((count, -(-max(1, len(planes)) // 8) * 8), np.uint8)
    for k, plane in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
    raw = np.zeros((count, 4), np.uint8)
    raw[:, : bits.shape[1] // 8] = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file. add() takes ids of whole documents; memory holds one block and the index."""

    def __init__(self, out, block: int = BLOCK, kind: str = "bit", level: int = 3):
        import zstandard

        self.out, self.block, self.kind, self.packer = out, block, kind, zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.place, self.n_ids = [], 0, len(MAGIC), 0
        self.index = {"block": block, "kind": kind, "chunks": [], "docs": [], "keys": []}
        out.write(MAGIC)

    def add(self, keys: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.index["keys"] += keys
        self.index["docs"] += counts.tolist()
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ready = np.concatenate(self.held)
            whole = len(ready) // self.block * self.block
            for at in range(0, whole, self.block):
                self._flush(ready[at : at + self.block])
            self.held, self.n_held = [ready[whole:]], len(ready) - whole

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(x) for x in planes_of(ids, self.kind)]
        self.index["chunks"].append([self.place, len(ids), [len(x) for x in packed]])
        for x in packed:
            self.out.write(x)
            self.place += len(x)

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        tail = self.packer.compress(json.dumps(self.index | {"n_ids": self.n_ids}).encode())
        self.out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)


class PlaneReader:
    """Reads a file that can seek: the index first, then blocks by number."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        foot = self._read(size - 16, 16)
        if foot[8:] != MAGIC:
            raise ValueError("not a whole plane file")
        (n,) = struct.unpack("<Q", foot[:8])
        self.index = json.loads(self.unpacker.decompress(self._read(size - 16 - n, n)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, count, lengths = self.index["chunks"][k]
        raw, planes, used = self._read(at, sum(lengths)), [], 0
        for n in lengths:
            planes.append(self.unpacker.decompress(raw[used : used + n]))
            used += n
        return ids_of(planes, count, self.index["kind"])

    def documents(self):
        """(key, ids) of each document in order, one block at a time."""
        held, k = np.empty(0, np.uint32), 0
        for key, n in zip(self.index["keys"], self.index["docs"]):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(k))
                have, k = have + len(parts[-1]), k + 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield key, held[:n]
            held = held[n:]


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_planes(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID,
    files: int | None = None, block: int = BLOCK, kind: str = "bit",
) -> DataFrame:
    """Writes docs in ascending id order, one file for each id range; returns the written manifest of the files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions("id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, writer, total = TaskContext.get().partitionId(), None, 0
        store, at = _opened(folder)
        path, own = f"{folder}/part-{part:06d}.planes", f"{at}/.{part:06d}-{uuid.uuid4().hex}"
        made = tokens.tokenizer(vocabulary)
        for batch in chunks(batches, "text"):
            if writer is None:
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(own)
                writer = PlaneWriter(out, block, kind)
            ids, counts = tokens.with_end(*made.ids(batch.column("text")), end_id)
            writer.add(batch.column("id").to_pylist(), counts, ids)
            total += len(counts)
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, f"{at}/part-{part:06d}.planes")
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": total, "n_tokens": writer.n_ids}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_planes(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents as the files hold them; ids as little-endian 32-bit integers.

    start counts the ids of all documents before; a running sum over one row for each file gives files' bases.
    """
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", base.alias("base"), "part")
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, at = _opened(path)
                rows, held = [], 0
                with store.open_input_file(at) as source:
                    for key, ids in PlaneReader(source).documents():
                        rows.append((key, start, len(ids), ids.astype("<u4").tobytes()))
                        start, held = start + len(ids), held + 4 * len(ids)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.repartition(max(n, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def encode(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Writes plane files under folder (a new one in the shared folder by default) and reads them back."""
    folder = folder or scratch(docs.sparkSession, "planes")
    return read_planes(write_planes(docs, folder, vocabulary or tokens.default_vocabulary(), **options))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
