"""Near-duplicate documents by an exact Jaccard join of word-shingle sets.

1. Every text becomes its set of distinct five-word shingles. Texts with equal sets, by a 128-bit digest, are one
   node, which has the least id of them as its number.
2. Prefix keys: two sets with a Jaccard similarity of the threshold t share a shingle among the first
   n - ceil(t n) + 1 of each, in any fixed order. The order is rarest first: shingles that are counted often (a
   counted list of bounded size) come last, so common passages hardly ever are keys.
3. In each key's band of sizes (a band spans a factor of 1 / t) every node is compared with one pivot, and the
   components of those links are found. Large groups of copies melt into one component here, without all pairs.
   Keys of very frequent shingles are dealt over several tasks; each has a pivot, and the pivots have one too.
4. Tiles: nodes that share a key and lie in different components are compared all the same, in tiles of bounded
   size; of keys that exactly the same nodes share, one is enough, and keys with the same least node meet in one
   task, where a pair is given out once. Each node has a bitmap: the parity of its shingles in hashed bits, about as
   many as it has shingles. The bits in which two bitmaps differ bound the sets' difference from below, so the overlap
   from above; pairs that cannot reach t are dropped.
5. The pairs that are left are verified by intersecting the sorted arrays of shingle hashes.
No link between different sets is lost: each linked pair shares a key, and is compared unless already connected.

Shingles are compared by 64-bit hashes. Edge cases: null and empty texts, and those without a word, have no shingle
and link with nothing; a text of fewer than five words has its whole sequence as one shingle; a row without an id has
its shingle count and no component; rows that share an id and a text are alike, and an id with several texts joins
them; ids are cast to long, and text ids end the job; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WordTable, chunks, drop_path, hash_words, mixed, shingle_hashes, whole_text, written, written_path
from docketry.llm.components import components

WIDTH, THRESHOLD = 5, 0.8
#: A shingle is common if it is in more documents than COMMON_LEAST and than a COMMON_SHARE-th of them. It is looked for
#: where COUNTED shingles of a task have it COMMON_SEEN times. The COMMON_KEPT most frequent ones are sent to all tasks
#: (16 bytes each); which these are changes the order of shingles, so the work, but no link.
COMMON_LEAST, COMMON_SHARE, COMMON_SEEN, COUNTED, COMMON_KEPT = 48, 20_000, 4, 2_000_000, 200_000
#: Documents with a common shingle for each task that its keys are dealt to.
DEALT = 50_000
#: Ids up to this count are sent to all tasks (8 bytes each) to pick documents; more are joined by key.
SENT_IDS = 4_000_000
#: Nodes of one side of a tile.
TILE = 1024
#: Rows of tiles that a task compares at once.
COMPARED = 16_384
NARROW, WIDE = 1024, 8192


def band(n: np.ndarray) -> np.ndarray:
    """Sizes by factors of 1 / THRESHOLD."""
    return np.minimum(np.floor(np.log(np.maximum(n, 1)) / np.log(1 / THRESHOLD)), 63).astype(np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes, in NARROW bits or in more for a large set, up to WIDE: a power of two."""
    bits = min(WIDE, max(NARROW, 1 << max(0, len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int = NARROW // 64) -> np.ndarray:
    """A wide bitmap as one of fewer 64-bit words: a bit's place is its hash modulo the width, so parities add up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def reachable(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements whose bitmaps differ in so many bits can have the threshold."""
    overlap = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return 100 * overlap >= round(100 * THRESHOLD) * (n + m - overlap)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct hashes have the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= round(100 * THRESHOLD) * (len(a) + len(b) - common)


def _name(own: np.ndarray) -> bytes:
    """The 128-bit name of a set, from its sorted hashes."""
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def shingle_sets(batches, text: str):
    """(slice, sets): slices of batches, and the sorted distinct shingle hashes of each text."""
    table = WordTable(hash_words)
    for part in chunks(batches, text):
        numbers, counts = table.number(part.column(text), lower=True)
        hashes, n = shingle_hashes(table.filled()[numbers] if len(numbers) else np.empty(0, np.uint64), counts, WIDTH)
        ends = np.cumsum(n)
        yield part, [np.unique(hashes[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))


def _named(rows: DataFrame) -> DataFrame:
    """(id, name, n) of every row, and in rows with a hash (its count as n) the shingles that tasks have often."""
    schema = pa.schema([("id", pa.int64()), ("name", pa.binary()), ("n", pa.int64()), ("hash", pa.int64())])

    def often(held):
        found, count = np.unique(np.concatenate(held), return_counts=True)
        found, count = found[count >= COMMON_SEEN], count[count >= COMMON_SEEN]
        k = len(found)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(count.astype(np.int64)), pa.array(found.view(np.int64))], schema=schema)

    def run(batches):
        held, size = [], 0
        for part, sets in shingle_sets(batches, "text"):
            n = [len(x) for x in sets]
            names = pa.array([_name(x) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), names, pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], schema=schema)
            held += sets
            size += sum(n)
            if size >= COUNTED:
                yield from often(held)
                held, size = [], 0
        if held:
            yield from often(held)

    return rows.mapInArrow(run, "id long, name binary, n long, hash long")


def only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs whose id is in ids (left_semi) or is not (left_anti); ids are sent to all tasks if they are few enough."""
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", how)


def _keyed(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, n, bits, keys, salts) of each row that has shingles. A key holds a shingle's hash and, low, the band.

    salts: for each key the task it is dealt to, 0 unless the shingle is very frequent.
    """
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        often, count = sent.value
        for part, sets in shingle_sets(batches, "text"):
            out = []
            for node, own in zip(part.column("id").to_pylist(), sets):
                n = len(own)
                if not n:
                    continue
                take = n - -(-round(100 * THRESHOLD) * n // 100) + 1
                first, seen = own[:take], np.zeros(take, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    known = np.where(often[at] == own, count[at], 0)
                    order = np.lexsort((own, np.where(known > 0, known | np.uint64(1 << 63), own >> np.uint64(1))))[:take]
                    first, seen = own[order], known[order].astype(np.int64)
                keys = mixed(first.copy()) & ~np.uint64(63) | band(np.array(n))
                out.append((node, n, bitmap(own).tobytes(), keys.view(np.int64), (node % (1 + seen // DEALT)).astype(np.int32)))
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64()] * 2 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["node", "n", "bits", "keys", "salts"])

    return rows.mapInArrow(run, "node long, n long, bits binary, keys array<long>, salts array<int>")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, pivot): nodes whose key's shingle another node has too; pivot: one node of the key, band and salt.

    Rows of a key come sorted, so a task needs its last row alone. Half of the keys take their least node as pivot,
    half their greatest. Nodes of a dealt key are kept in any case: such a shingle is frequent.
    """
    rows = nodes.select("node", F.explode(F.arrays_zip("keys", "salts")).alias("x")).select("node", F.col("x.keys").alias("key"), F.col("x.salts").alias("salt"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turned = F.when(F.col("key").bitwiseAND(64) == 0, F.col("node")).otherwise(F.bitwise_not(F.col("node")))
    rows = rows.repartition(n, F.shiftright("key", 6), "salt").sortWithinPartitions("key", "salt", turned)

    def run(batches):
        held = pivot = None  # the last row, not yet given out, as (key, node, salt, whether it shares its key); its pivot
        for batch in batches:
            key, node, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "salt"))
            if not len(key):
                continue
            if held is not None:
                key, node, salt = (np.concatenate([[x], y]) for x, y in zip(held, (key, node, salt)))
            same = (key[1:] >> 6) == (key[:-1] >> 6)
            shared = np.concatenate([[held is not None and held[3]], same]) | np.concatenate([same, [False]]) | (salt > 0)
            starts = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            first = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
            pivots = node[first]
            if held is not None:
                pivots[first == 0] = pivot
            give = shared[:-1]
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][give]) for x in (key, node, pivots)], names=["key", "node", "pivot"])
            held, pivot = (key[-1], node[-1], salt[-1], bool(len(same) and same[-1]) or bool(shared[-1])), pivots[-1]
        if held is not None and held[3]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (held[0], held[1], pivot)], names=["key", "node", "pivot"])

    return rows.mapInArrow(run, "key long, node long, pivot long")


def _pivoted(members: DataFrame) -> DataFrame:
    """(a, b), a < b: each node with its pivot, and the pivots of a dealt key with the least of them."""
    own = members.where("node != pivot").select("node", "pivot")
    several = members.where("node = pivot").groupBy("key").agg(F.min("pivot").alias("least"), F.max("pivot").alias("last")).where("least != last")
    among = members.where("node = pivot").join(several, "key").where("node != least").select("node", F.col("least").alias("pivot"))
    return own.union(among).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full bitmaps leave the threshold in reach."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    rows = pairs.join(side("a"), "a").where("n_a IS NOT NULL").join(side("b"), "b")
    rows = rows.where(f"100 * least(n_a, n_b) >= {round(100 * THRESHOLD)} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("bits_a", "bits_b"))
            least = (min(len(p), len(q)) for p, q in zip(x, y))
            differ = np.fromiter((int(np.bitwise_count(folded(p, w) ^ folded(q, w)).sum()) for p, q, w in zip(x, y, least)), np.int64, len(x))
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array(reachable(n, m, differ), pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets have the threshold. Sets are made again, from the texts of the nodes that are asked."""
    asked = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "asked")

    def run(batches):
        for part, sets in shingle_sets(batches, "text"):
            ids = part.column("id").to_numpy(zero_copy_only=False)
            full = np.array([len(x) > 0 for x in sets], bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[full]), pa.array([x.tobytes() for x in sets if len(x)], pa.binary())], names=["node", "hashes"])

    sets = written(only(rows, asked, "left_semi").mapInArrow(run, "node long, hashes binary"), "sets")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("hashes").alias(f"x_{s}"))

    def test(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("x_a", "x_b"))
            yield batch.select(["a", "b"]).filter(pa.array([linked(p, q) for p, q in zip(x, y)], pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "x_a", "x_b").mapInArrow(test, "a long, b long")


def _tiled(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a key, differ in component, and may have the threshold by bitmap."""
    labelled = members.select(F.shiftright("key", 6).alias("key"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes_of = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"x{seed}") for seed in (1, 2)]
    mixed_keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("lead"), F.count("*").alias("m"), *nodes_of).where("lo != hi")
    # keys of one set of nodes (by its 128-bit signature) give the same pairs
    used = mixed_keys.groupBy("m", "x1", "x2", "lead").agg(F.min("key").alias("key"))
    # tiles a side: a power of two, so that like keys of one lead cut their nodes alike
    grid = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("m") / TILE)))).cast("int")
    rows = labelled.join(used.select("key", "lead", grid.alias("grid")), "key")
    rows = rows.join(nodes.select("node", "n", "bits"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("grid")).cast("int")
    rows = rows.select("lead", "key", "node", "root", "n", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1)).alias("other"))
    rows = rows.select("lead", "key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "own", "node", "root", "n", "bits")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "lead", "t", "u").sortWithinPartitions("lead", "t", "u", "key")

    def changes(cols):
        """Where one of the columns changes."""
        return np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1

    def by_width(bits):
        """For each width that occurs, in 64-bit words: rows' places in a matrix of the bitmaps of that width or more."""
        words, out = np.fromiter((len(x) // 8 for x in bits), np.int64, len(bits)), {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words >= w)
            matrix = np.stack([folded(np.frombuffer(bits[i], np.uint64), w) for i in own])
            place = np.full(len(bits), -1)
            place[own] = np.arange(len(own))
            out[w] = place, matrix
        return words, out

    def near(p, q, n, words, matrices):
        """Which of the pairs of rows p and q may have the threshold, by the widest bitmaps that both have."""
        keep, width = np.zeros(len(p), bool), np.minimum(words[p], words[q])
        for w, (place, matrix) in matrices.items():
            own = np.flatnonzero(width == w)
            for s in range(0, len(own), 1 << 13):
                part = own[s : s + (1 << 13)]
                x, y = p[part], q[part]
                differ = np.bitwise_count(matrix[place[x]] ^ matrix[place[y]]).sum(axis=1, dtype=np.int64)
                keep[part] = reachable(n[x], n[y], differ)
        return keep

    def tile(cols):
        """The distinct pairs of whole tiles."""
        _, key, t, u, own, node, root, n, bits = cols
        words, matrices = by_width(bits)
        end = np.repeat(np.append(changes(cols[:4]), len(key)), np.diff(np.concatenate([[0], changes(cols[:4]), [len(key)]])))
        at, step, found = np.arange(len(key)), 1, []
        at = at[end > at + 1]
        while len(at):
            i, j = at, at + step
            keep = (root[i] != root[j]) & ((t[i] == u[i]) | (own[i] != own[j]))
            i, j = i[keep], j[keep]
            keep = 100 * np.minimum(n[i], n[j]) >= round(100 * THRESHOLD) * np.maximum(n[i], n[j])
            i, j = i[keep], j[keep]
            keep = near(i, j, n, words, matrices)
            if keep.any():
                x, y = node[i[keep]], node[j[keep]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            step += 1
            at = at[end[at] > at + step]
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        held, rows_held = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "key", "t", "u", "own", "node", "root", "n")]
                held.append([*cols, np.array(batch.column("bits").to_pylist(), object)])
                rows_held += batch.num_rows
                if rows_held < COMPARED:
                    continue
            if not rows_held:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            whole = len(cols[0])
            if batch is not None:  # keys of one lead stay together if they can; the last tile may go on
                ends = changes([cols[0], *cols[2:4]])
                ends = ends if len(ends) else changes(cols[:4])
                whole = int(ends[-1]) if len(ends) else 0
            if whole:
                yield from tile([x[:whole] for x in cols])
            held, rows_held = [[x[whole:] for x in cols]], len(cols[0]) - whole

    return rows.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the least id that links reach, the row's own included."""
    rows = _rows(docs, id_col, text_col)
    named, named_path = written_path(_named(rows), "named")
    every = named.where("hash IS NULL").select("id", "name", "n")
    total, ids = every.agg(F.count("*"), F.count_distinct("id") + F.count_if(F.col("id").isNull())).first()
    counted = named.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > max(COMMON_LEAST, total // COMMON_SHARE))
    often = sorted((int(np.int64(h).view(np.uint64)), c) for h, c in counted.orderBy(F.desc("n"), "hash").limit(COMMON_KEPT).collect())
    common = np.array([h for h, _ in often], np.uint64), np.array([c for _, c in often], np.uint64)
    full = every.where("name IS NOT NULL AND id IS NOT NULL")
    reps, reps_path = written_path(full.groupBy("name").agg(F.min("id").alias("rep")), "reps")
    spare = full.join(reps, "name").where("id != rep").select("id").distinct()
    # An id that has several texts may be a copy by one and a node's only row by another: it stays.
    spare, spare_path = written_path(spare.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_anti"), "copies")
    texts = only(rows.where("id IS NOT NULL"), spare, "left_anti")
    texts = texts.dropDuplicates(["id", "text"]) if ids < total else texts
    nodes, nodes_path = written_path(_keyed(texts, common), "nodes")
    members, members_path = written_path(_members(nodes), "members")

    first = written(_verified(written(_bounded(_pivoted(members), nodes), "pairs"), texts), "links")
    second = written(_verified(written(_tiled(members, nodes, components(first)), "pairs"), texts), "links")
    for path in (members_path, nodes_path, spare_path):
        drop_path(rows.sparkSession, path)
    known = reps.join(components(first.union(second)).withColumnRenamed("node", "rep"), "rep", "left").select("name", F.coalesce("root", "rep").alias("component_id"))
    out = every.join(known, "name", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that share a component with a smaller id."""
    spare = written(join(docs, id_col, text_col).where("component_id != id").select(F.col("id").alias("__copy_id")).distinct(), "near-copies")
    ids = F.broadcast(spare) if spare.count() <= SENT_IDS else spare
    return docs.join(ids, F.col(id_col).cast("long") == F.col("__copy_id"), "left_anti")
