"""Quality rules by line frequency across documents.

Lines are normalised (ASCII case folded, runs of white space as one space, ends trimmed) and hashed. For each
host, the distinct texts that hold a line are counted: exact copies of a document count once, so a copied
document does not turn its own lines into boilerplate. A line whose count is above the host's limit,
max(min_texts, share * texts of the host), is removed from every document of that host. A document that is left
with too small a share of its words is depleted and rejected.

Edge cases: a null text counts as empty; a null host is a host of its own; rows that are equal in every column
are judged alike; an empty text fails the base rules; lines without a word are never counted or removed; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import chunks, whole_text, word_codes, written

#: A line of a host is removed when more distinct texts than this hold it, and more than SHARE of the host's texts.
MIN_TEXTS, SHARE = 10, 0.01
#: A document is depleted when fewer of its words than this share remain.
LEFT = 0.3
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def normal_line(line: bytes) -> tuple[bytes, int]:
    """A line with ASCII letters folded and white space collapsed, and its words."""
    words = line.lower().split()
    return b" ".join(words), len(words)


def line_hash(line: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def repeated_words(numbers: np.ndarray, counts: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text, the words that lie in a run of width words found twice or more in it.

    Runs are numbered exactly, by doubling: a run of 2w words is a pair of runs of w words.
    """
    ids, w = numbers, 1
    doc = np.repeat(np.arange(len(counts)), counts)
    while w < width and len(ids) > w:
        pair = ids[:-w].astype(np.int64) * (int(ids.max()) + 1) + ids[w:]
        ids = np.unique(pair, return_inverse=True)[1]
        w *= 2
    inside = doc[: max(0, len(numbers) - width + 1)] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    out = np.zeros(len(counts), np.int64)
    if not len(at):
        return out
    key = ids[at].astype(np.int64) * len(counts) + doc[at]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    hits = at[n[back] > 1]
    covered = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(covered, hits, 1)
    np.subtract.at(covered, hits + width, 1)
    np.add.at(out, doc, np.cumsum(covered[:-1]) > 0)
    return out


def _lines(text: bytes) -> tuple[int, list[int], list[int]]:
    """Lines with a word that equal an earlier line; hashes of the distinct normalised lines; their words in all."""
    seen, found, repeats = set(), {}, 0
    for line in text.split(b"\n"):
        normal, words = normal_line(line)
        if words:
            repeats += line in seen
            seen.add(line)
            found[normal] = found.get(normal, 0) + words
    return repeats, [line_hash(x) for x in found], list(found.values())


def line_table(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, text_hash, base counts, lines, line_words) of every row, in one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    types = dict(rows.dtypes)

    def run(batches):
        for part in chunks(batches, "text"):
            texts = part.column("text")
            numbers, _, counts = word_codes(texts)
            held = lambda signs: sum(pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in signs)
            chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) - held(" \t\n\x0b\x0c\r")
            lines = [_lines(x) for x in texts.cast(pa.large_binary()).to_pylist()]
            made = [counts, chars, held(SYMBOLS), [x[0] for x in lines], repeated_words(numbers, counts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("id", "host", "text_hash")]
                + [pa.array(x, pa.int64()) for x in made]
                + [pa.array([x[k] for x in lines], pa.list_(pa.int64())) for k in (1, 2)],
                names=["id", "host", "text_hash", *COUNTS, "lines", "line_words"],
            )

    schema = f"id {types['id']}, host {types['host']}, text_hash long, {', '.join(f'{c} long' for c in COUNTS)}, lines array<long>, line_words array<long>"
    return rows.mapInArrow(run, schema)


def frequent_lines(table: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """(host, line, n_texts) of lines above their host's limit.

    Distinct texts are counted in two steps, by (host, line, text) and then by (host, line), each summed before
    it is shuffled, so a hot host or line never meets in one task.
    """
    per_host = table.groupBy("host", "text_hash").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("host_texts"))
    rows = table.select("host", "text_hash", F.explode("lines").alias("line"))
    counted = rows.groupBy("host", "line", "text_hash").agg(F.lit(1)).groupBy("host", "line").agg(F.count("*").alias("n_texts"))
    joined = counted.where(F.col("n_texts") > min_texts).alias("c").join(per_host.alias("p"), F.expr("c.host <=> p.host"))
    return joined.where(F.col("n_texts") > share * F.col("host_texts")).select("c.host", "line", "n_texts")


def removed_lines(table: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """(host, text_hash, removed_words, removed): each distinct text that loses lines, once for each host."""
    frequent = frequent_lines(table, min_texts, share)
    texts = table.groupBy("host", "text_hash").agg(F.first(F.struct("lines", "line_words")).alias("x"))
    rows = texts.select("host", "text_hash", F.explode(F.arrays_zip("x.lines", "x.line_words")).alias("y"))
    rows = rows.select("host", "text_hash", F.col("y.lines").alias("line"), F.col("y.line_words").alias("words"))
    hit = rows.alias("r").join(frequent.alias("f"), F.expr("r.host <=> f.host AND r.line = f.line"))
    return hit.groupBy("r.host", "text_hash").agg(F.sum("words").alias("removed_words"), F.collect_list("r.line").alias("removed"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_texts: int = MIN_TEXTS,
    share: float = SHARE,
    left: float = LEFT,
) -> DataFrame:
    """One row per row of docs: id, host, text_hash, base counts, removed_words, removed, base_failed, depleted, kept."""
    table = written(line_table(docs, id_col, text_col, host_col), "lines")
    removed = removed_lines(table, min_texts, share)
    base = table.drop("lines", "line_words")
    out = base.alias("b").join(removed.alias("r"), F.expr("b.host <=> r.host AND b.text_hash = r.text_hash"), "left")
    out = out.select("b.*", F.coalesce("removed_words", F.lit(0)).alias("removed_words"), "removed")
    out = out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    out = out.withColumn("depleted", F.expr(f"n_words - removed_words < {left} * n_words"))
    return out.withColumn("kept", F.expr("NOT base_failed AND NOT depleted"))


def without_lines(text: F.Column, removed: F.Column) -> F.Column:
    """A text without the lines whose hashes are listed."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, bad in zip(texts, lists):
            gone = set(bad.tolist()) if bad is not None else set()
            out.append("\n".join(x for x in text.split("\n") if line_hash(normal_line(x.encode("utf-8", "replace"))[0]) not in gone))
        return pd.Series(out)

    return F.when(removed.isNull(), text).otherwise(cut(F.coalesce(text, F.lit("")), removed))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept rows of docs with all their columns, their over-frequent lines removed from the text."""
    judged = judge(docs, id_col, text_col, host_col, **limits).where("kept")
    verdicts = judged.groupBy("host", "text_hash").agg(F.first("removed").alias("__removed"))
    verdicts = verdicts.select(F.col("host").alias("__host"), F.col("text_hash").alias("__verdict_hash"), "__removed")
    keyed = docs.withColumn("__text_hash", F.xxhash64(whole_text(text_col)))
    out = keyed.join(verdicts, F.col(host_col).eqNullSafe(F.col("__host")) & (F.col("__text_hash") == F.col("__verdict_hash")))
    return out.select(*[without_lines(F.col(c), F.col("__removed")).alias(c) if c == text_col else F.col(c) for c in docs.columns])
