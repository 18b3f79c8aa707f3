"""Resharding by minimum-cost flow.

From the old shards' sizes and the new shards' capacities a flow network is
solved on the driver (its size is old x new shards, never the data): a byte
that stays in its shard costs 0, a byte that moves costs 1 (or what ``cost``
says).  The flow says how many bytes go from each old shard to each new one.
Each old shard is a sequence of blocks of documents (by a hash of the id); the
flow cuts that sequence into runs, so blocks move whole except where a run
ends inside one.  Files of a shard that neither gains nor loses rows are left
alone; the others are rewritten.

NULL ids and texts are rows like any other (a NULL text has 0 bytes), equal
rows are separate rows, and an empty table gives no rows and no files.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from driftmark.llm.common import attach, cut, text_bytes, tidy
from driftmark.session import scratch_dir

BLOCK_ROWS = 16_384
MIN_BLOCKS = 16


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by at most one and sum to ``total``."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: Sequence[int], demand: Sequence[int],
                  cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Cheapest flow from supplies to demands of the same sum, by successive
    shortest paths with potentials (Dijkstra over the residual arcs)."""
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, want = list(supply), list(demand)
    pot = [0] * n + [min((cost[i][j] for i in range(n)), default=0) for j in range(m)]
    while any(left):
        dist, came = [float("inf")] * (n + m), [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            dist[i] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                arcs = ((n + j, cost[u][j]) for j in range(m))
            else:
                arcs = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in arcs:
                nd = d + c + pot[u] - pot[v]
                if nd < dist[v]:
                    dist[v], came[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        end = min((n + j for j in range(m) if want[j]), key=lambda v: dist[v] + pot[v])
        reach = max(d for d in dist if d < float("inf"))
        pot = [p + min(d, reach) for p, d in zip(pot, dist, strict=True)]
        path, v = [], end
        while came[v] >= 0:
            path.append((came[v], v))
            v = came[v]
        push = min([left[v], want[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        left[v] -= push
        want[end - n] -= push
        for a, b in path:
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
    return flow


def moving_cost(old: int, new: int) -> list[list[int]]:
    return [[int(i != j) for j in range(new)] for i in range(old)]


def _order_key() -> list[Column]:
    return [F.col("h"), F.asc_nulls_first("doc_id"), F.col("size"), F.col("text_crc32")]


def assign(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int,
           capacities: Sequence[int] | None = None, cost: Sequence[Sequence[int]] | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, old, shard, slot)`` of every row.

    ``size`` is the text's UTF-8 bytes plus 1; ``capacities`` (bytes) default
    to equal ones; ``slot`` numbers a shard's rows from 0 without gaps."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), (text_bytes(text) + 1).alias("size"),
                           F.crc32(text.cast("binary")).alias("text_crc32"),
                           F.coalesce(old_shard, F.lit(0)).cast("int").alias("old")), "reshard-sizes")
    sizes = {r["old"]: (r["b"], r["n"]) for r in
             rows.groupBy("old").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    if not set(sizes) <= set(range(old_shards)):
        raise ValueError(f"old shards are 0 to {old_shards - 1}, found {sorted(sizes)}")
    supply = [sizes.get(i, (0, 0))[0] for i in range(old_shards)]
    demand = list(capacities) if capacities else even(sum(supply), new_shards)
    if sum(demand) != sum(supply):
        raise ValueError("capacities must sum to the bytes of all rows")
    flow = min_cost_flow(supply, demand, cost or moving_cost(old_shards, new_shards))
    # what stays comes first, so a shard's own run begins at its first block
    runs = []
    for i, to in enumerate(flow):
        at = 0
        for j in sorted(range(new_shards), key=lambda j, i=i: (j != i, j)):
            if to[j]:
                runs.append((i, at, at + to[j], j))
                at += to[j]
    runs = spark.createDataFrame(runs, "old int, lo long, hi long, shard int")  # at most old + new - 1 rows or so
    n = max((n for _, n in sizes.values()), default=0)
    blocks = max(MIN_BLOCKS, -(-n // BLOCK_ROWS))
    h = F.xxhash64("doc_id", "size")
    rows = rows.withColumn("h", h).withColumn("block", F.pmod("h", F.lit(blocks)))
    # prefix sums in two levels: blocks of a shard, then rows of a block
    per = rows.groupBy("old", "block").agg(F.sum("size").alias("b"))
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("old", "block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("old", "block").orderBy(*_order_key())
    rows = rows.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    mid = F.col("base") + F.col("end") - F.ceil(F.col("size") / 2)
    placed = (rows.join(per, ["old", "block"]).withColumn("mid", mid)
              .join(F.broadcast(runs), (rows["old"] == runs["old"]) & (F.col("mid") >= F.col("lo"))
                    & (F.col("mid") < F.col("hi")))
              .select("doc_id", "size", "text_crc32", rows["old"], "block", "h", "shard"))
    placed = cut(placed, "reshard-placed")
    cells = placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "old", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy(*_order_key()))
    return (placed.withColumn("nth", nth).join(cells, ["shard", "old", "block"])
            .select("doc_id", "size", "text_crc32", "old", "shard",
                    (F.col("first") + F.col("nth") - 1).alias("slot")))


def affected(placed: DataFrame) -> DataFrame:
    """Shards (old or new numbers) that gain or lose rows: ``(shard)``."""
    moved = placed.where("old <> shard")
    return moved.select("shard").union(moved.select("old")).distinct()


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, only_affected: bool = False) -> None:
    """Rewrite the documents as ``folder/shard=<n>/``, with their slot.  With
    ``only_affected`` shards that keep exactly their rows are not written.

    Rows meet their placement by id, size and checksum, in one shuffle of the
    texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if only_affected:
        placed = placed.join(affected(placed), "shard", "left_semi")
    key = {"doc_id": F.col("doc_id"), "size": text_bytes(text) + 1, "text_crc32": F.crc32(text.cast("binary"))}
    out = attach(docs, placed, key, ["shard", "slot"])
    with tidy(docs.sparkSession):
        out.write.partitionBy("shard").option("compression", "zstd").parquet(folder)


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int) -> DataFrame:
    """Place and rewrite all documents; returns them as read back from the
    files, with ``shard`` and ``slot``."""
    placed = cut(assign(docs, old_shard, old_shards, new_shards), "reshard")
    folder = scratch_dir(docs.sparkSession, "shards")
    write_shards(docs, placed, folder)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("shard", "slot")]
    schema = StructType([*kept, StructField("slot", LongType()), StructField("shard", IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(folder)
