"""Helpers that the training-data operators share: the shared folder, written tables, words of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task holds as words at once.
CHUNK_BYTES = 2 << 20
#: Distinct words that a task remembers before it starts afresh.
WORDS_KEPT = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="docketry-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: later readers do not recompute it, and it outlives executors.

    made: gets the path, so that the caller can drop the table.
    """
    table, path = written_path(df, name)
    if made is not None:
        made.append(path)
    return table


def written_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the path, for tables that are dropped when their step is over."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def whole_text(col: str) -> F.Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def chunks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts hold about CHUNK_BYTES."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES, side="right")))
            # taken, not sliced: string kernels that write new text misread arrays whose offsets start above 0
            yield batch if stop - start == batch.num_rows else batch.take(pa.array(np.arange(start, stop)))
            start = stop
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker that later tasks use again would keep it beside the executor's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _lengths(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's place in the distinct words of these texts, those distinct words, and each text's word count.

    Words are what the six ASCII spaces (0x20, 0x09 to 0x0D) separate; lower folds A-Z alone.
    """
    texts = texts.cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    found = words.filter(full).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.cast(pa.large_binary()), np.diff(upto[np.concatenate([[0], ends]).astype(np.int64)])


class WordTable(dict):
    """Numbers distinct words in order of arrival and keeps one value for each.

    value(words) gives an array of as many values. A word's value depends on the word alone, so tasks agree.
    After WORDS_KEPT words the table starts afresh, which bounds its memory.
    """

    def __init__(self, value: Callable[[list[bytes]], np.ndarray] | None = None):
        super().__init__()
        self.value, self.values = value, None

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def forget(self) -> None:
        self.clear()
        self.values = None

    def number(self, texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after another, and each text's word count; words as for word_codes()."""
        if len(self) > WORDS_KEPT:
            self.forget()
        codes, words, counts = word_codes(texts, lower)
        numbers = np.fromiter(map(self.__getitem__, words.to_pylist()), np.int64, len(words))
        return numbers[codes], counts

    def filled(self) -> np.ndarray:
        """The values of all words numbered so far."""
        have = 0 if self.values is None else len(self.values)
        if have < len(self) or self.values is None:
            words = list(self)[have:]
            new = self.value(words)
            self.values = new if self.values is None else np.concatenate([self.values, new])
        return self.values


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * MIX
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words in each text, one after another, and their count for each text.

    A text with fewer words, but some, has one: its whole sequence.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            h *= np.uint64(0x100000001B3 | 0x5BD1E995 << 32)
            h += hashes[k : k + len(h)]
    h = mixed(h, width)
    n = np.maximum(counts - width + 1, 0)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = h[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for i in short:
            own = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for x in hashes[starts[i] : ends[i]]:
                    own = own * np.uint64(0x100000001B3 | 0x5BD1E995 << 32) + x
            extra.append(mixed(own, int(counts[i])))
        place = np.cumsum(n)[short]
        out = np.insert(out, place, np.concatenate(extra))
        n = n.copy()
        n[short] = 1
    return out, n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each of the runs."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


class RaggedTable(WordTable):
    """A word table whose values are lists of ids. encode(words) gives them for new words."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.flat, self.used, self.lens = np.empty(1 << 16, np.uint32), 0, np.empty(0, np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def spread(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words one after another, and the ids of each run of counts words."""
        known = len(self.lens)
        if known < len(self):
            new = self.encode(list(islice(self, known, None)))
            lens = np.fromiter(map(len, new), np.int64, len(new))
            need = self.used + int(lens.sum())
            if need > len(self.flat):
                grown = np.empty(max(need, 2 * len(self.flat)), np.uint32)
                grown[: self.used] = self.flat[: self.used]
                self.flat = grown
            self.flat[self.used : need] = np.fromiter(chain.from_iterable(new), np.uint32, need - self.used)
            self.used, self.lens = need, np.concatenate([self.lens, lens])
        starts, n = np.cumsum(self.lens) - self.lens, self.lens[numbers]
        per_word, ends = np.concatenate([[0], np.cumsum(n)]), np.cumsum(counts)
        return self.flat[ragged(starts[numbers], n)], per_word[ends] - per_word[ends - counts]
