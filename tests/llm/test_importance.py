"""Importance resampling: composed CRCs against CRCs of the strings, draws against plain code, edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docketry.llm import importance
from tests.llm.test_operators import empty, odd, text  # noqa: F401

TEXTS = ["", "a", "One  two-THREE 4", "é日本 x ﬁ", "A" * 1000 + " b", "x\x00y\x7fz_w", "  lead and trail  ", "ß" * 300 + "q " * 5]


def words_of(value: str | None) -> list[str]:
    folded = re.sub("[A-Z]+", lambda m: m[0].lower(), value or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def features_of(value: str | None, longest: int = 2) -> list[str]:
    w = words_of(value)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def test_composed_crcs_equal_those_of_the_strings():
    for longest in (1, 2, 4):
        found, counts = importance.Features(997, longest)(pa.array(TEXTS).slice(1))
        assert counts.tolist() == [len(words_of(t)) for t in TEXTS[1:]]
        for n, (doc, at) in enumerate(found, 1):
            want = [(d, zlib.crc32(f.encode()) % 997) for d, t in enumerate(TEXTS[1:]) for f in features_of(t, longest) if f.count(" ") == n - 1]
            assert list(zip(doc.tolist(), at.tolist())) == want


def test_shifts_append_zero_bytes():
    rng = random.Random(3)
    values = [rng.getrandbits(32) for _ in range(50)]
    lengths = [0, 1, 2, 7, 8, 255, 256, 70_000] + [rng.randint(0, 3000) for _ in range(42)]
    moved = importance.Shifts()(np.array(values, np.uint32), np.array(lengths))
    for value, n, got in zip(values, lengths, moved.tolist()):
        left = bytes(rng.getrandbits(8) for _ in range(9))
        right = bytes(rng.getrandbits(8) for _ in range(n))
        one = importance.Shifts()(np.array([zlib.crc32(left)], np.uint32), np.array([n]))[0]
        assert int(one) ^ zlib.crc32(right) == zlib.crc32(left + right)
        if n == 0:
            assert got == value


def plain(docs: list[tuple[int | None, str | None]], target: list[str | None], percent: int = 25):
    """The same by strings, dictionaries and one sort."""

    def counted(texts):
        out = np.zeros(importance.BUCKETS, np.int64)
        for value in texts:
            for f in features_of(value):
                out[zlib.crc32(f.encode()) % importance.BUCKETS] += 1
        return out

    s, t = counted(x for _, x in docs), counted(target)
    size, gain = importance.BUCKETS, {}
    out = []
    for i, value in docs:
        fs, total = features_of(value), 0
        for f in fs:
            b = zlib.crc32(f.encode()) % size
            if b not in gain:
                gain[b] = math.floor(1000 * math.log(float(t[b] + 1) * float(s.sum() + size) / (float(s[b] + 1) * float(t.sum() + size))))
            total += gain[b]
        weight, score = total // len(fs) if fs else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words_of(value)), len(fs), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return out


def test_resampling_against_plain_code(spark, odd, empty):  # noqa: F811
    target = spark.createDataFrame([("the of and to in that",), (None,), ("",), ("as his they",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for percent in (0, 25, 60, 100):
        rows = [tuple(r) for r in importance.resample(odd, target, percent=percent).collect()]
        want = [tuple(r) for r in plain(docs, ["the of and to in that", None, "", "as his they"], percent)]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert importance.resample(empty, target).collect() == []
    # an empty target: the smoothed shares alone decide
    rows = [tuple(r) for r in importance.resample(odd, target.limit(0)).collect()]
    assert sorted(rows, key=repr) == sorted(map(tuple, plain(docs, [])), key=repr)


def test_like_scores_and_repeated_rows(spark):
    rng = random.Random(5)
    base = text(rng, 40)
    docs = spark.createDataFrame([(k // 3, base, k) for k in range(300)], "doc_id long, text string, rank int").repartition(7)
    rows = importance.resample(docs, docs.limit(1)).collect()
    got = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert len(rows) == 300 and got == list(range(1, 76))
    by_rank = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r.score, -r.id) for r in by_rank] == sorted(((r.score, -r.id) for r in by_rank), reverse=True)


def test_the_draw_follows_the_target(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["kappa", "lambda", "mu"] if k % 4 == 0 else ["one", "two", "three"]) for _ in range(60))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("kappa lambda mu kappa mu lambda " * 20,)], "text string")
    drawn = importance.resample(docs, target).where(F.col("rank").isNotNull())
    assert drawn.where("id % 4 = 0").count() > 80  # of 100 drawn; 25 by chance
