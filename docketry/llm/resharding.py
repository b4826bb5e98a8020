"""Resharding by minimum-cost flow.

Old shards are cut into blocks by a hash of the row. From the old shards' sizes and the new shards' capacities a
minimum-cost flow gives the bytes that go from each old to each new shard: a byte that stays costs nothing and one
that moves costs its rate. Whole blocks realise the flow, and only the shards that lose or gain blocks are written
again. The driver holds one row for each block; blocks follow the rows (ROWS_PER_BLOCK), so they stay small.

A row is told apart from its like by its place in its file, so that equal rows spread over the blocks as others do.

Edge cases: a null text has size 1; rows with a null old shard count as shard 0; an empty table gives no rows; extra
columns are ignored by the plan and carried along, whatever their names, but for `shard` and `slot`, which are replaced.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import scratch, written

#: Blocks in all, at least; more where a block would hold more rows than this on average.
LEAST_BLOCKS, ROWS_PER_BLOCK = 16_384, 50_000


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Units from each supply to each capacity at the least total cost, by successive shortest paths.

    Each round finds the cheapest path of the residual network (Bellman-Ford, as flow that goes back has negative
    cost) and moves as much along it as it holds. Capacities must sum to at least the supplies.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        dist = [0.0 if i < n and left[i] else float("inf") for i in range(n + m)]
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost[i][j], n + j, True
        path = [min((n + j for j in range(m) if room[j]), key=lambda v: dist[v])]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        much = min([left[path[0]], room[path[-1] - n], *(flow[v][u - n] for u, v in steps if u >= n)])
        for u, v in steps:
            if u < n:
                flow[u][v - n] += much
            else:
                flow[v][u - n] -= much
        left[path[0]] -= much
        room[path[-1] - n] -= much
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that sum to total and differ by one at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def assign_blocks(blocks: list[tuple[int, int, int]], flow: list[list[int]]) -> list[int]:
    """The new shard of each block (old shard, block, bytes), so that whole blocks come close to the flow.

    An old shard's blocks go out largest first, each to the new shard that still wants most of it; what rounding
    gives a new shard beyond its flow is taken off its wants from the next old shard.
    """
    out, own = [0] * len(blocks), {}
    for k, block in enumerate(blocks):
        own.setdefault(block[0], []).append(k)
    beyond = [0] * max(map(len, flow), default=0)
    for old, ks in own.items():
        want = {j: f - beyond[j] for j, f in enumerate(flow[old]) if f}
        for k in sorted(ks, key=lambda k: -blocks[k][2]):
            out[k] = max(want, key=lambda j: (want[j], j == old, -j))
            want[out[k]] -= blocks[k][2]
        for j, short in want.items():
            beyond[j] = -short
    return out


def place_in_file(docs: DataFrame) -> tuple[DataFrame, F.Column]:
    """docs and a column that differs between all its rows: their places in files. Frames that are no files are written."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = written(docs, "documents")
    at = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(at["file_path"], at["row_index"])


def digests(docs: DataFrame, old_shard: F.Column, id_col: str, text_col: str) -> DataFrame:
    """Rows (d, id, __old, __size, __key): d holds the columns, __size is UTF-8 bytes and one, __key gives the block."""
    docs, place = place_in_file(docs)
    text, kept = F.col(text_col).cast("string"), [c for c in docs.columns if c not in ("shard", "slot")]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), F.col(id_col).alias("id"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("__old"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("__size"), F.xxhash64(F.col(id_col), text, place).alias("__key"),
    )


def plan(rows: DataFrame, old_shards: int, new_shards: int, cost: list[list[float]] | None = None, capacity: list[int] | None = None) -> tuple[list[tuple], dict]:
    """The blocks' rows (old, block, new shard, first slot) and a summary: sizes, flow, bytes moved, affected shards.

    rows has __old, __size and __key. Two small aggregations come to the driver: a row for each old shard, and a
    row for each block.
    """
    by_shard = {r[0]: (r[1], r[2]) for r in rows.groupBy("__old").agg(F.sum("__size"), F.count("*")).collect()}
    supply = [by_shard.get(i, (0, 0))[0] for i in range(old_shards)]
    total, n_rows = sum(supply), sum(x[1] for x in by_shard.values())
    n_blocks = max(LEAST_BLOCKS, n_rows // ROWS_PER_BLOCK)
    counts = [max(1, round(n_blocks * s / max(1, total))) for s in supply]
    found = rows.groupBy("__old", block_of(counts).alias("block")).agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
    blocks = sorted((r["__old"], r["block"], r["size"], r["n"]) for r in found.collect())
    capacity = capacity or even_capacities(total, new_shards)
    cost = cost or [[0.0 if i == j else 1.0 for j in range(new_shards)] for i in range(old_shards)]
    flow = minimum_cost_flow(supply, capacity, cost)
    places = assign_blocks([b[:3] for b in blocks], flow)
    first, out = [0] * new_shards, []
    for (old, block, _, n), shard in zip(blocks, places):
        out.append((old, block, shard, first[shard]))
        first[shard] += n
    moved = [(b, s) for b, s in zip(blocks, places) if b[0] != s]
    affected = sorted({s for _, s in moved} | {b[0] for b, _ in moved if b[0] < new_shards})
    return out, {"supply": supply, "capacity": capacity, "flow": flow, "counts": counts, "moved": sum(b[2] for b, _ in moved), "affected": affected}


def block_of(counts: list[int]) -> F.Column:
    """The block of a row in its old shard."""
    sizes = F.array(*[F.lit(c) for c in counts])
    return F.pmod(F.col("__key"), F.element_at(sizes, F.col("__old") + 1)).cast("int")


def reshard(
    docs: DataFrame, old_shard: F.Column, old_shards: int, new_shards: int, folder: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", cost: list[list[float]] | None = None,
) -> tuple[DataFrame, dict]:
    """Rewrites the affected shards under folder, one directory for each, and returns all rows with shard and slot.

    Rows of shards that keep all their blocks, and no more, are read from docs; the rest from the new files.
    """
    spark, folder = docs.sparkSession, folder or scratch(docs.sparkSession, "shards")
    rows = digests(docs, old_shard, id_col, text_col)
    small = written(rows.select("__old", "__size", "__key"), "shard-sizes")
    blocks, summary = plan(small, old_shards, new_shards, cost)
    affected = set(summary["affected"])

    def placed(own: list[tuple]) -> DataFrame:
        places = spark.createDataFrame(own, "__old int, __block int, shard int, __first long")
        order = Window.partitionBy("__old", "__block").orderBy(F.col("id").asc_nulls_first(), "__key")
        out = rows.withColumn("__block", block_of(summary["counts"])).join(places, ["__old", "__block"])
        return out.withColumn("slot", F.col("__first") + F.row_number().over(order) - 1).select("d.*", "shard", "slot")

    anew, kept = [b for b in blocks if b[2] in affected], [b for b in blocks if b[2] not in affected]
    fresh = placed(anew)
    if not affected:
        return placed(kept), summary
    fresh.write.partitionBy("shard").parquet(folder)
    out = spark.read.schema(fresh.schema).parquet(folder).select(*fresh.columns)
    return out.union(placed(kept)) if kept else out, summary
