"""The training-data operators against SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import (
    common, jaccard_join, packing, passages, quality_classifier, quality_rules, queries, resharding, sentencepieces, token_planes, tokens, topk_search, url_filters,
)
from docketry.llm.components import components
from tests.conftest import DATA

WORDS = "the of and to in that it is was for on are with as his they at be this from have or by one had not but what all were".split()


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "s", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, copies and clashing column names."""
    rng = random.Random(4)
    base, passage = text(rng, 120), text(rng, 70)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [(i, base, "en", "a", 1) for i in range(0, 4)] + [(4, near, "en", "a", 1), (5, near.upper(), None, "b", 1)]
    rows += [(6, None, "en", None, None), (7, "", "en", "a", 0), (7, "", "en", "a", 0), (8, "one two", "en", None, 7), (8, "one two", "en", None, 7), (9, " \t\n ", "de", "b", 3)]
    rows += [(10 + k, f"{text(rng, 40)} {passage} {text(rng, 30)}", "en", "a", 5) for k in range(4)]
    rows += [(20, text(rng, 30_000), "en", "b", 9), (21, "é ß 日本 ﬁ \u00a0x <|endoftext|> don't 12３", "fr", "b", 2), (None, base, "en", "a", 1), (None, None, None, None, None)]
    rows += [(30 + k, f"Shared footer line of this host.\n{text(rng, 45)}", "en", "c", 8) for k in range(15)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "host", "node", "key", "kept", "removed", "text_hash", "shard", "slot", "score", "predicted", "words", "part", "window"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


SQL = sorted(queries.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(name, same_rows):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])


def test_chunks_give_whole_rows():
    rng = random.Random(1)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text(rng, rng.randint(0, 400)) for _ in range(9000)])})
    parts = list(common.chunks([batch], "text"))
    assert len(parts) > 2 and sum(p.num_rows for p in parts) == 9000
    table = common.WordTable(common.hash_words)
    for part in parts:
        numbers, counts = table.number(part.column("text"), lower=True)
        own = [w for t in part.column("text").to_pylist() for w in t.encode().lower().split()]
        assert np.array_equal(table.filled()[numbers], common.hash_words(own)) and counts.sum() == len(own)


def test_rules_on_odd_rows(odd, empty):
    out = quality_rules.judge(odd, min_texts=5, share=0.1)
    rows = out.collect()
    assert len(rows) == odd.count() and quality_rules.judge(empty).count() == 0
    by = {r.id: r for r in rows}
    assert by[6].n_words == 0 and by[6].base_failed and not by[7].kept
    # a copied document does not make its own lines frequent; the footer of host c is, but removing it depletes nobody
    assert by[0].kept and by[30].removed_words == 6 and by[30].kept
    cleaned = quality_rules.cleaned(odd, min_texts=5, share=0.1)
    assert cleaned.columns == odd.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert "footer" not in texts[30] and texts[0] == odd.where("doc_id = 0").first().text
    strict = {r.id: r.kept for r in quality_rules.judge(odd, min_texts=5, share=0.1, left=0.95).collect()}
    assert not strict[30] and strict[10]


def test_token_planes_round_trip(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.default_vocabulary())
    for kind in ("bit", "byte"):
        rows = token_planes.encode(odd, folder=str(tmp_path / kind), files=3, block=1000, kind=kind).collect()
        rows.sort(key=lambda r: r.start)
        want = {(r.doc_id, (r.text or "")) for r in odd.collect()}
        assert len(rows) == odd.count()
        at, seen = 0, set()
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
        expect = {}
        for key, t in want:
            expect.setdefault(key, []).append([*made.encode(t, add_special_tokens=False).ids, 1])
        for r in rows:
            assert r.start == at
            got = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert got in expect[r.doc_id]
            seen.add(r.doc_id)
            at += r.n_tokens
        assert seen == set(expect)
    assert token_planes.encode(empty, folder=str(tmp_path / "none"), files=2).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_of_any_block(kind):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        for top in (1, 2, 255, 256, 65_536, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            assert np.array_equal(token_planes.ids_of(token_planes.planes_of(ids, kind), n, kind), ids)


def test_packing_keeps_every_id_once(odd, empty):
    rows = packing.pack(odd, length=64, most=4).collect()
    tok = tokens.tokenizer(tokens.default_vocabulary())
    total = sum(int(c) + 1 for c in tok.ids(pa.array([r.text or "" for r in odd.collect()]))[1])
    assert sum(r.length for r in rows) == total
    by_sequence: dict[int, list] = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.start + r.length <= r.doc_tokens
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty).count() == 0


def test_packing_against_the_library(spark):
    """Pieces put together give the library's own ids and the end id; sequences lie gapless and hardly need padding."""
    import zlib

    from tokenizers import Tokenizer

    rng = random.Random(13)
    rows = [(k, text(rng, rng.randint(0, 400))) for k in range(60)] + [(90, text(rng, 6000)), (91, ""), (92, None), (93, "Ein “Zitat” — naïve 日本語 <|endoftext|> a\x00b \x1c DON'T")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = Tokenizer.from_file(tokens.default_vocabulary())
    pieces, sequences = {}, {}
    for r in packing.pack(frame).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == token_planes.crc32_of(ids)
        pieces.setdefault(r.id, []).append((r.start, ids.tolist(), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, t in rows:
        parts = sorted(pieces[key])
        want = made.encode(t or "", add_special_tokens=False).ids + [1]
        assert sum((ids for _, ids, _ in parts), []) == want and {n for _, _, n in parts} == {len(want)}
        assert [start for start, _, _ in parts] == [sum(len(x) for _, x, _ in parts[:i]) for i in range(len(parts))]
    total = 0
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048
        total += end
    assert len(sequences) <= -(-total // 2048) + 2


def test_packer_is_best_fit_and_bounded():
    p = packing.Packer(10, 2)
    assert [p.place(n, (n,)) for n in (6, 8, 2, 3)] == [(0, 0), (1, 0), (1, 8), (0, 6)]
    assert p.done == [(8, 1, 0), (2, 1, 8)]
    p.place(5, ("a",)), p.place(7, ("b",))
    assert len(p.open) == 2 and p.done[2:] == [(6, 0, 0), (3, 0, 6)]


def test_flow_is_of_least_cost():
    rng = random.Random(3)
    for _ in range(30):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(n)]
        capacity = [rng.randint(0, 4) for _ in range(m)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                resharding.minimum_cost_flow(supply, capacity, [[0.0] * m] * n)
            continue
        cost = [[float(rng.randint(0, 5)) for _ in range(m)] for _ in range(n)]
        flow = resharding.minimum_cost_flow(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))

        def best(i, room):
            if i == len(units):
                return 0.0
            return min((cost[units[i]][j] + best(i + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j in range(m) if room[j]), default=float("inf"))

        units = [i for i in range(n) for _ in range(supply[i])]
        assert sum(f * c for a, b in zip(flow, cost) for f, c in zip(a, b)) == best(0, tuple(capacity))


def test_resharding_spreads_equal_rows(spark, tmp_path):
    same = spark.createDataFrame([(1, "the same text", 5)] * 4000 + [(None, None, 1)] * 500, "doc_id long, text string, __size long")
    same.repartition(5).write.parquet(str(tmp_path / "same"))
    for docs in (same, spark.read.parquet(str(tmp_path / "same"))):
        out, _ = resharding.reshard(docs, F.lit(0), 1, 4)
        rows = out.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"), F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()
        sizes = [r["size"] for r in rows]
        assert len(rows) == 4 and sum(r.n for r in rows) == 4500 and max(sizes) < 1.1 * min(sizes)
        assert all(r.last == r.n - 1 and r.slots == r.n for r in rows)
        assert out.columns == ["doc_id", "text", "__size", "shard", "slot"] and out.where("doc_id = 1 AND __size = 5").count() == 4000


def test_resharding_keeps_rows_and_moves_little(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("shard", F.lit("clash"))
    old = F.pmod(F.xxhash64("source"), F.lit(4))
    out, summary = resharding.reshard(docs, old, 4, 4)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    sizes, slots = [0] * 4, {}
    for r in rows:
        sizes[r.shard] += len((r.text or "").encode()) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes) - min(sizes) <= 2 * max(len(r.text.encode()) for r in rows)
    least = sum(max(0, s - c) for s, c in zip(summary["supply"], summary["capacity"]))
    assert summary["moved"] <= 1.1 * least + 4 * max(len(r.text.encode()) for r in rows)
    odd_rows, _ = resharding.reshard(odd, F.lit(0), 1, 3)
    assert odd_rows.count() == odd.count()
    assert resharding.reshard(empty, F.lit(0), 1, 3)[0].count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault((i, t), own)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations([(k[0], v) for k, v in sets.items()], 2):
        both = len(s & t)
        if both and 100 * both >= 80 * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, {k: len(v) for k, v in sets.items()}


def test_jaccard_join_against_all_pairs(spark, odd, empty):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect()]
    for k in range(40):  # clusters whose members are near the threshold, and short texts
        base = text(rng, rng.choice([5, 6, 9, 60, 300])).split()
        for j in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"edit{rng.random()}"
            rows.append((1000 + 10 * k + j, " ".join(own)))
    want, sizes = brute_components(rows)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.id: r.component_id for r in got} == want
    assert {r.n_shingles for r in got if r.id == 20} == {sizes[(20, dict(rows)[20])]}
    on_odd = jaccard_join.join(odd).collect()
    assert len(on_odd) == odd.count() and {r.component_id for r in on_odd if r.id is None} == {None}
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.representatives(odd)
    assert kept.columns == odd.columns
    assert {0, 6, 7, 10} <= {r.doc_id for r in kept.collect()} and not {1, 2, 3, 4, 5} & {r.doc_id for r in kept.collect()}


def test_tiles_compare_what_pivots_leave(spark, monkeypatch):
    """Tiles of two nodes and no pivot links give the same components."""
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    real = jaccard_join._members
    monkeypatch.setattr(jaccard_join, "_members", lambda nodes: real(nodes).withColumn("pivot", F.col("node")))
    rng = random.Random(2)
    base = text(rng, 80).split()
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(12)] + [(50 + k, text(rng, 80)) for k in range(5)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in got} == brute_components(rows)[0]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n, m in ((50, 60), (900, 1000), (1500, 1400), (1000, 1100)):
        shared = rng.integers(0, 1 << 63, 400 if n > 400 else 30, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, k - len(shared), dtype=np.uint64)])) for k in (n, m))
        x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
        if len(x) != len(y):
            x, y = jaccard_join.folded(x), jaccard_join.folded(y)
        differ = int(np.bitwise_count(x ^ y).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert np.array_equal(jaccard_join.folded(jaccard_join.bitmap(a)), jaccard_join.folded(np.asarray(jaccard_join.bitmap(a))))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(500, 500 + k) for k in range(1, 30)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in links)}


def test_topk_against_all_scores(spark):
    rng = np.random.default_rng(8)
    vectors = [(int(i), [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(20)] + [(400, [1.0] * 3), (450, [2.0] * 3)]
    vectors += [(700, [1e30] * 8), (500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (None, vectors[5][1]), (650, []), (50, vectors[0][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("rank", F.lit("clash"))
    got: dict = {}
    for r in topk_search.search(frame.repartition(3), F.expr("vec_id % 50 = 0 AND vec_id != 50"), rows=64, queries=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v)]
    want = {}
    for q, x in whole:
        if q is not None and q % 50 == 0 and q != 50:
            scores = sorted(((-int(x @ y), i is None, i or 0, i) for i, y in whole if i != q and len(y) == len(x)))[:5]
            if scores:
                want[q] = {k + 1: (s[3], -s[0]) for k, s in enumerate(scores)}
    assert got == want
    assert topk_search.search(frame.limit(0), F.expr("vec_id % 50 = 0")).count() == 0


def test_topk_of_places_with_several_blocks(spark, monkeypatch):
    """Blocks take turns on chunks of queries; what is found in one bounds the search in the next, ties included."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (400, 4))
    x[::7] = x[0]
    frame = spark.createDataFrame([(int(i), [float(c) / 256 for c in v]) for i, v in zip(rng.permutation(400), x)], "vec_id long, embedding array<double>").repartition(5)
    ask = F.expr("vec_id % 10 = 0")
    plan = topk_search.search(frame, ask, rows=8, queries=4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    want = sorted(map(tuple, topk_search.search(frame, ask, rows=1000).collect()))
    assert len(want) == 40 * 5
    monkeypatch.setattr(topk_search, "SPREAD", 1)
    monkeypatch.setattr(topk_search, "TURN", 2)
    assert sorted(map(tuple, topk_search.search(frame, ask, rows=8, queries=4).collect())) == want


@pytest.mark.parametrize("seed", range(4))
def test_sorted_lists_stop_early_and_right(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-40, 40, (2000, 6))
    rows[::3] = rows[0]
    ids = rng.permutation(2000)
    found = topk_search.SortedLists(ids, rows).top(rows[:20], ids[:20], 5)
    for q, (got, scores) in enumerate(found):
        s = rows @ rows[q]
        keep = np.flatnonzero(ids != ids[q])
        best = keep[np.lexsort((ids[keep], -s[keep]))[:5]]
        assert ids[best].tolist() == got.tolist() and s[best].tolist() == scores.tolist()


def test_sorted_lists_are_not_read_to_the_end_on_clusters():
    """On skewed data, whose best rows stand out in each list, queries stop early, and what they read is counted."""
    rng = np.random.default_rng(3)
    near = rng.integers(900, 1000, (20, 16))
    lists = topk_search.SortedLists(np.arange(4000), np.concatenate([near, rng.integers(-30, 30, (3980, 16))]))
    found = lists.top(near[:10], np.arange(10), 5)
    assert all(set(ids.tolist()) <= set(range(20)) for ids, _ in found)
    assert 0 < lists.read <= lists.entries // 4


URLS = ["https://WWW.Example.COM/en/x?q=/es/", "http://a.example.com/en/", "http://example.com/fr/", "http://x.net/es/1", "http://net/fr/", "http://xnet/es/", "example.com/en/", None, "http://example.com", "://com/", "http://com:80/", "a://b://com/en/", "http://.com/#x", "http://" + "a." * 3000 + "com/" + "b" * 50_000]


def test_url_filters_against_plain_code(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id int, url string").withColumn("host", F.lit("clash"))
    for r in url_filters.judge(frame, queries.URL_RULES).collect():
        url = URLS[r.id % len(URLS)] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[1], want[2])
    assert url_filters.judge(frame.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filters.judge(frame, []).collect()} == {"allow"}


def test_many_rules_go_to_several_cascades(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    want = sorted(map(tuple, url_filters.judge(frame, queries.URL_RULES).collect()), key=repr)
    monkeypatch.setattr(url_filters, "PART_RULES", 2)
    listed = [f"k{7 * i}" for i in range(9)]
    universe = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    made = url_filters.cascades(spark, listed, universe)
    assert len(made) == 5
    assert {r.key for r in universe.where(url_filters.member_of_any(made, F.col("key"))).collect()} == set(listed)
    assert sorted(map(tuple, url_filters.judge(frame, queries.URL_RULES).collect()), key=repr) == want


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = [f"k{7 * i}" for i in range(300)]
    levels = url_filters.cascade(spark, listed, universe)
    assert len(levels) > 1
    found = {r.key for r in universe.where(url_filters.member(levels, F.col("key"))).collect()}
    assert found == set(listed)


def test_passages_against_all_windows(spark, odd, empty):
    rng = random.Random(6)
    shared = [text(rng, n) for n in (50, 51, 64, 120, 300)]
    rows = []
    for k in range(60):
        parts = [text(rng, rng.randint(0, 90))]
        for p in rng.sample(shared, rng.randint(0, 2)):
            parts += [p, text(rng, rng.randint(0, 60))]
        rows.append((k, " ".join(parts)))
    near = shared[3].split()
    near[60] = "different"
    rows += [(90, text(rng, 30) + " " + " ".join(near)), (91, rows[0][1]), (92, rows[0][1])]
    found = passages.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got: dict[int, set] = {}
    for r in found:
        assert r.earlier_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    seen, want = set(), {}
    for i, t in rows:
        w = t.lower().split()
        own = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want[i] = {p for k, x in enumerate(own) if x in seen for p in range(k, k + 50)}
        seen.update(own)
    for i, t in rows:
        # a passage is measured against one earlier document; another may happen to share a word more at an end
        assert len(want[i] - got.get(i, set())) <= 3, i
        if not want[i] and i != 90:
            assert i not in got
    assert len(got[90]) >= 110
    cleaned = {r.doc_id: r.text for r in passages.without_passages(odd).collect()}
    assert passages.without_passages(odd).columns == odd.columns
    original = {r.doc_id: r.text for r in odd.collect()}
    assert cleaned[0] == original[0] and cleaned[6] is None and cleaned[10] == original[10]
    assert all(len(cleaned[k].split()) <= 75 for k in (11, 12, 13)) and cleaned[1] == ""
    assert passages.find(empty).count() == 0


def _covered(found) -> dict[int, set]:
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    return got


def test_passages_do_not_depend_on_salts(spark, monkeypatch):
    """Holders of passages behind one common phrase give the same pairs of windows, dealt over salts or not."""
    rng = random.Random(8)
    phrase = text(rng, 5)
    shared = [f"{text(rng, 25)} {phrase} {text(rng, 30)}" for _ in range(6)]
    rows = [(k, f"{text(rng, 20)} {shared[k % 6]} {text(rng, 20)}") for k in range(36)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    regions, pairs = passages._regions, []

    def kept(found):
        pairs.append({tuple(r) for r in found.select("a", "b", "place_a", "place_b").collect()})
        return regions(found)

    monkeypatch.setattr(passages, "_regions", kept)
    monkeypatch.setattr(passages, "FREQUENT", 1 << 40)
    passages.find(frame)
    plain, pairs[:] = pairs[0], []
    monkeypatch.setattr(passages, "FREQUENT", 2)
    monkeypatch.setattr(passages, "FRACTION", 1)
    monkeypatch.setattr(passages, "SALTS", 16)
    passages.find(frame.repartition(7))
    assert len(plain) > 100 and pairs[0] == plain


def test_passages_behind_stock_phrases(spark):
    """Earlier documents hold each stretch of a passage, so all first windows, but not the passage."""
    rng = random.Random(9)
    shared = text(rng, 50).split()
    rows = [(k, f"{text(rng, 60)} {' '.join(shared[6 * (k % 6) : 6 * (k % 6) + 20])} {text(rng, 60)}") for k in range(240)]
    rows += [(300 + k, f"{text(rng, 30)} {' '.join(shared)} {text(rng, 30)}") for k in range(6)]
    got = _covered(passages.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)))
    assert set(got) == set(range(301, 306)) and all(set(range(30, 80)) <= x for x in got.values())


def test_long_shared_passage(spark):
    """20,000 words in common are found whole, with one word changed in every 100."""
    rng = random.Random(11)
    shared = text(rng, 20_000).split()
    near = [f"changed{k}" if k % 100 == 50 else w for k, w in enumerate(shared)]
    rows = [(k, f"{text(rng, 30)} {' '.join(x)} {text(rng, 30)}") for k, x in enumerate((shared, shared, near))]
    got = _covered(passages.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    assert set(got) == {1, 2} and all(set(range(30, 20_030)) <= x for x in got.values())


def near_holders(rng: random.Random, n: int, group: int) -> tuple[list, list[int]]:
    """Groups of n documents: one with a passage of 50 words, others with one word of it changed (similarity 41 / 51)."""
    rows, copies = [], []
    for g in range(group):
        words = text(rng, 50).split()
        for k in range(n):
            own = list(words)
            if k:
                own[rng.randint(10, 39)] = f"changed{g}x{k}"
                copies.append(g * n + k)
            rows.append((g * n + k, f"{text(rng, 30)} {' '.join(own)} {text(rng, 30)}"))
    return rows, copies


def test_near_passages_of_groups(spark):
    """Passages of 50 words with one changed: of lone pairs, of small groups and of groups that share keys."""
    for n, group in ((2, 100), (3, 60), (40, 5)):
        rows, copies = near_holders(random.Random(10 + n), n, group)
        got = _covered(passages.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)))
        assert len(set(copies) & set(got)) >= 0.99 * len(copies), n


def test_a_stretch_that_goes_on_elsewhere(spark):
    """The first holder of a stretch lacks what is around it in two later documents; that is found as well."""
    rng = random.Random(12)
    left, middle, right = text(rng, 20), text(rng, 60), text(rng, 12)
    rows = [(0, f"{text(rng, 30)} {middle} {text(rng, 30)}")] + [(k, f"{text(rng, 30)} {left} {middle} {right} {text(rng, 30)}") for k in (1, 2, 3)]
    got = _covered(passages.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    assert set(range(50, 110)) <= got[1] and all(set(range(30, 122)) <= got[k] for k in (2, 3))


def test_regions_across_distances(spark):
    """Distances on both sides of a bucket's edge, a chance pair of another distance in between, and a far one."""

    def row(b, ca, shift):
        return 1, b, ca << 30 | 10 << 13 | 10, (ca + shift) << 30 | 10 << 13 | 10

    rows = [row(2, 110, 47), row(2, 112, 48), row(2, 160, 47), row(2, 162, 48)]
    rows += [row(3, 110, 0), row(3, 112, 40), row(3, 114, 0), row(3, 2000, 0)]
    found = passages._regions(spark.createDataFrame(rows, "a long, b long, place_a long, place_b long").coalesce(1))
    got = sorted((r.b, r.lo_a, r.hi_a, r.lo_b, r.hi_b) for r in found.collect())
    assert got == [(2, 0, 255, 64, 319), (3, 0, 191, 0, 191), (3, 0, 191, 64, 255), (3, 1920, 2111, 1920, 2111)]


def test_compact_windows_hold_every_run_once():
    rng = np.random.default_rng(2)
    for lengths in ([40, 0, 9, 25], [10], [9], [100]):
        lengths = np.array(lengths)
        starts = np.cumsum(lengths) - lengths
        values = rng.integers(0, 1 << 63, int(lengths.sum()), dtype=np.uint64)
        left, c, right = passages.compact_windows(values, starts, lengths, 10)
        for s, n in zip(starts, lengths):
            for i in range(s, s + n):
                for j in range(i + 9, s + n):
                    inside = [k for k in range(len(c)) if left[k] <= i <= c[k] <= j <= right[k]]
                    assert len(inside) == 1 and values[c[inside[0]]] == values[i : j + 1].min()


def test_cut_words():
    assert passages.cut_words("a b\nc d  e", [(1, 2)]) == "a d  e"
    assert passages.cut_words("a b c", [(0, 3)]) == "" and passages.cut_words("a b c", [(1, 1), (0, 2)]) == "c"


def test_sentencepieces_match_the_library(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    made = sentencepieces.Encoder(sentencepieces.default_model())
    rng = random.Random(0)
    signs = "ab  \n\tcdeéß日本☃ \U0001f600 theing.,"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", "  a  b  ", "aaaaaaaaaaaa", " " * 50, "▁x"]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    flat, counts = made.ids(pa.array(texts))
    for t, ids, want in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), library.encode(texts)):
        assert ids.tolist() == want, t
        assert made.text(ids) == library.decode(want)
    rows = sentencepieces.encode(odd, decoded=True, digest=True).collect()
    assert sorted(r.decoded for r in rows) == sorted((r.text or "") for r in odd.collect())
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in rows)
    again = sentencepieces.decode(spark.createDataFrame([([], ), (None,), (library.encode("so it is"),)], "ids array<int>")).collect()
    assert [r.decoded for r in again] == ["", None, "so it is"]


def test_classifier_on_held_out_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_classifier.classify(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == truth[r.id] for r in held]) >= 0.9
    kept = quality_classifier.good(odd, labels)
    assert kept.columns == odd.columns
    assert quality_classifier.classify(odd, labels.limit(0)).count() == odd.count()
    assert quality_classifier.classify(empty, labels).count() == 0


def test_training_never_reads_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.id, round(r.score, 6)) for r in quality_classifier.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_topk_scores_of_large_components_are_exact(spark):
    rng = np.random.default_rng(11)
    ones = [1.0] * 64
    rows = [(0, ones), (1, [50000.0] * 64), (2, [49999.0] * 64), (3, [float(x) for x in rng.normal(size=64)]), (4, [-50000.0] * 64)]
    rows += [(k, [float(x) for x in rng.normal(size=64)]) for k in range(5, 60)]
    # products of 2 ** 60 and sums beyond what doubles tell apart
    rows += [(100, [2.0**20 + k for k in range(64)]), (101, [2.0**20 + k + 1 / 256 for k in range(64)]), (102, [2.0**20 - k for k in range(64)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    got: dict = {}
    for r in topk_search.search(frame.repartition(3), F.col("vec_id").isin(0, 3, 100), rows=16, queries=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 3, 100):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q))[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert got[0][0] and {v for _, v, _ in got[0]} >= {1, 2}
    apart = spark.createDataFrame([(0, [2.0**30, 0.0]), (1, [0.0, 2.0**30]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id, r.score) for r in topk_search.search(apart, F.lit(True)).collect()}
    assert found == {(0, 1, 0), (1, 0, 0), (0, 2, 2**46), (2, 0, 2**46), (1, 2, 3 * 2**46), (2, 1, 3 * 2**46)}
    huge = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|too big|overflow"):
        topk_search.search(huge, F.lit(True)).collect()
    rows = topk_search.search(spark.createDataFrame([(0, [2.0**60]), (1, [1.0]), (2, [2.0])], huge.schema), F.lit(True)).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in rows} == {(1, 2, 131072), (2, 1, 131072)}


def test_passages_of_ids_with_several_texts_stay(spark):
    rng = random.Random(31)
    shared, other = text(rng, 80), text(rng, 100)
    rows = [(1, text(rng, 30) + " " + shared), (2, shared + " " + text(rng, 20)), (2, None), (3, shared + " " + text(rng, 10)), (3, other), (4, text(rng, 9) + " " + shared), (4, None)]
    rows[6] = (5, None)
    got = sorted((r.doc_id, len((r.text or "").split())) for r in passages.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 110), (2, 0), (2, 100), (3, 90), (3, 100), (4, 9), (5, 0)]
    lone = spark.createDataFrame([(1, shared), (2, shared), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in passages.without_passages(lone).collect() if r.text is not None) == [(1, shared), (2, "")]
