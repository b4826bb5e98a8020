"""Importance resampling towards a target distribution over hashed word n-grams.

Words are runs of 0-9, a-z and all characters outside ASCII, after A-Z are lowered. A feature is a run of 1 to LONGEST
consecutive words joined by one space, and its bucket the CRC-32 of that string modulo BUCKETS. No such string is built.
Each distinct word's CRC is computed once, and a longer feature's is composed: appending n bytes to a string multiplies
its CRC by the n-th power of a 32 x 32 matrix over GF(2), so crc(x + y) = shift(crc(x), len(y)) ^ crc(y). Powers of two
of that matrix are kept as four tables of 256 entries each, and the bits of a word's length say which ones apply, for
all n-grams of a chunk at once.

A bucket's gain is the log ratio of its smoothed shares in the target and in the documents; a document's weight is the
floored mean of its features' gains, its score the weight and a Gumbel number from a hash of its id, and the highest
scores are drawn, which samples without replacement by weight. Ranks come from counts by score, whose number is bounded
by the range of gains and noise, so that no sort has to pass through one task.

Edge cases: a null or empty text has no features and weight 0; rows without an id have no noise, hence no score, are
not drawn and do not count among those to draw from; repeated rows have like scores and are drawn one after another;
an empty target or table gives each bucket its smoothed share, and an empty table no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WordTable, chunks, whole_text, written

#: Buckets of features; words of the longest feature; per cent of the documents to draw; words that a document needs to
#: be drawn; parts of a unit that gains, weights and scores count.
BUCKETS, LONGEST, PERCENT, MIN_WORDS, SCALE = 10_000, 2, 25, 20, 1000

#: What each byte is read as: A-Z as a-z, other ASCII characters outside words as spaces.
_READ = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def _crc_of_zeros() -> np.ndarray:
    """The images of the 32 unit vectors when one zero byte is appended."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        units = np.where(units & 1, (units >> np.uint32(1)) ^ np.uint32(0xEDB88320), units >> np.uint32(1))
    return units


def _tables(matrix: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), given by the images of its unit vectors, as a table for each byte of its argument."""
    byte = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8] ^= np.where(byte >> np.uint32(k % 8) & 1, matrix[k], np.uint32(0)).astype(np.uint32)
    return out


def _times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


class Shifts:
    """CRCs moved over any number of bytes, by the powers of two that the numbers hold."""

    def __init__(self):
        self.powers = [_tables(_crc_of_zeros())]

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, k = crcs.copy(), 0
        rest = lengths.astype(np.int64)
        while rest.any():
            if k == len(self.powers):
                self.powers.append(_tables(_times(self.powers[-1], _times(self.powers[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))))
            at = np.flatnonzero(rest & 1)
            out[at] = _times(self.powers[k], out[at])
            rest, k = rest >> 1, k + 1
        return out


def read_words(texts: pa.Array) -> pa.Array:
    """The texts with words folded and everything between them as spaces."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_READ[raw]))


class Features:
    """The buckets of all features of texts. A word's CRC is computed once for as long as the word is remembered."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest, self.shifts = buckets, longest, Shifts()
        space = zlib.crc32(b" ")
        self.words = WordTable(lambda words: np.array([(zlib.crc32(w), zlib.crc32(w, space), len(w) + 1) for w in words], np.int64).reshape(-1, 3))

    def __call__(self, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each feature length, each feature's text and bucket; and the word count of each text."""
        numbers, counts = self.words.number(read_words(texts))
        known = self.words.filled()[numbers]
        run, spaced, lengths = known[:, 0].astype(np.uint32), known[:, 1].astype(np.uint32), known[:, 2]
        doc = np.repeat(np.arange(len(counts)), counts)
        out = [(doc, run % np.uint32(self.buckets))]
        for n in range(2, self.longest + 1):
            starts = max(0, len(doc) - n + 1)
            run = self.shifts(run[:starts], lengths[n - 1 :]) ^ spaced[n - 1 :]
            within = np.flatnonzero(doc[:starts] == doc[n - 1 :])
            out.append((doc[within], run[within] % np.uint32(self.buckets)))
        return out, counts


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row for each bucket comes back, whatever the input."""

    def run(batches):
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for part in chunks(batches, "text"):
            for _, at in features(part.column("text"))[0]:
                total += np.bincount(at, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    found = docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in thousandths, floored."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches):
        features = Features(len(gain), longest)
        for part in chunks(batches, "text"):
            found, counts = features(part.column("text"))
            total, n = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            for doc, at in found:
                n += (own := np.bincount(doc, minlength=len(counts)))
                upto = np.concatenate([[0], np.cumsum(gain[at])])  # features stand in the order of their texts
                ends = np.cumsum(own)
                total += upto[ends] - upto[ends - own]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "n_words": pa.array(counts, pa.int64()), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64())})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = 7) -> F.Column:
    """A Gumbel number in thousandths, floored, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, able: F.Column, percent: int = PERCENT) -> DataFrame:
    """scored (id, score, ...) with rank: 1, 2, ... for the given per cent of the able rows of highest score, else null.

    Scores are whole thousandths between the least and greatest gain and noise, so there are some ten thousand of them
    however many rows there are. Rows by score are counted; the counts give where each score's ranks begin, and ties
    are ranked within their score. scored is read twice: pass a written table.
    """
    spark, may = scored.sparkSession, able & F.col("score").isNotNull()
    counts = sorted(((r.score, r.n) for r in scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, before, starts = percent * sum(n for _, n in counts) // 100, 0, []
    for score, n in counts:
        if before >= wanted:
            break
        starts.append((score, before))
        before += n
    least = starts[-1][0] if starts else None
    high = F.coalesce(may & (F.col("score") >= F.lit(least).cast("long")), F.lit(False))
    begin = spark.createDataFrame(starts, "score long, before long")
    ties = Window.partitionBy("score").orderBy(*[F.col(c).asc() for c in scored.columns if c != "score"])
    ranked = scored.where(high).join(F.broadcast(begin), "score").withColumn("rank", F.col("before") + F.row_number().over(ties))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.select(*scored.columns, "rank").union(scored.where(~high).select(*scored.columns, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs; rows with a rank are drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise("id"))
    return drawn(written(scored, "scored"), F.col("n_words") >= MIN_WORDS, percent)
