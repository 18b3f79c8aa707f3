"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a component (set if it is above 0).  A code is
cut into segments of 8 bits.  A search looks up, segment after segment, all
codes whose segment differs from the query's in exactly r bits, for r = 0, 1,
...; after segment j at radius r every code within ``m * r + j`` bits (m
segments, j from 0) has been seen, by the pigeonhole principle.  Each code
seen is verified by its full Hamming distance, and a query is done as soon as
its k-th smallest verified distance is within that covered radius.  Ties are
broken by id, and complete, since a tie lies within the radius too.

Equal codes are one entry with its k least ids (no more can be among the k
nearest), which Spark limits before the shuffle, so a hot vector costs k rows
a task.  Queries with equal codes are one query.  Entries are dealt into
blocks of about ``INDEX_BLOCK`` codes and queries into blocks of about
``QUERY_BLOCK``; every pair of blocks is one search, and each gives at most
k rows a query.

NULL vectors are not searched and find nothing; NULL and NaN components count as 0;
shorter vectors are filled up with zeros; a NULL id is never a query and is
found under NULL (it sorts first); rows with equal ids and codes are one;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.common import cut, ready

INDEX_BLOCK = 1 << 15
QUERY_BLOCK = 1 << 13
PROBES = 1 << 21  # codes verified at once
NO_ID = -(1 << 63)


def codes(vectors: DataFrame, bits: int, id_col: str, vec_col: str) -> DataFrame:
    """``(id, code)`` of the rows with a vector."""
    width = -(-bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, width * 8), dtype=bool)
            for i, v in enumerate(b.column(1).to_numpy(zero_copy_only=False)):
                out[i, :len(v)] = np.nan_to_num(np.asarray(v, dtype=np.float64)) > 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in np.packbits(out, axis=1)], pa.binary())], names=["id", "code"])

    return (vectors.where(F.col(vec_col).isNotNull())
            .select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                    F.transform(F.col(vec_col).cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0))).alias("v"))
            .mapInArrow(run, "id long, code binary"))


class Index:
    """Multi-index over the rows of a matrix of code bytes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.edge = np.stack([np.searchsorted(codes[self.order[:, j], j], np.arange(257))
                              for j in range(codes.shape[1])])
        self.masks = [np.array([sum(1 << b for b in c) for c in combinations(range(8), r)], dtype=np.uint8)
                      for r in range(9)]

    def probe(self, queries: np.ndarray, j: int, r: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entry, distance) of the entries whose segment j is at r bits
        and that no earlier lookup gave, for rows of ``queries``."""
        m = self.codes.shape[1]
        keys = queries[:, j][:, None] ^ self.masks[r][None, :]
        lo, n = self.edge[j][keys], self.edge[j][keys.astype(np.int64) + 1] - self.edge[j][keys]
        total = np.cumsum(n.sum(axis=1))
        i = 0
        while i < len(queries):
            last = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PROBES, side="right")))
            k = n[i:last].ravel()
            begin = np.repeat(lo[i:last].ravel() - np.concatenate([[0], np.cumsum(k)[:-1]]), k)
            entry = self.order[begin + np.arange(len(begin)), j]
            q = np.repeat(np.arange(i, last), n[i:last].sum(axis=1))
            far = np.bitwise_count(self.codes[entry] ^ queries[q])
            old = (far[:, :j] <= r).any(axis=1) | (far[:, j + 1:] < r).any(axis=1) if m > 1 else np.zeros(len(q), bool)
            yield q[~old], entry[~old], far[~old].sum(axis=1, dtype=np.int64)
            i = last


def search(index: Index, sizes: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, distance): for each query all entries up to the k-th
    distance, an entry counting as ``sizes`` rows."""
    m = index.codes.shape[1]
    seen = np.zeros((len(queries), 8 * m + 1), dtype=np.int64)
    kth = np.full(len(queries), 8 * m)
    live = np.arange(len(queries))
    out: list[tuple] = []
    for r in range(9):
        for j in range(m):
            if not len(live):
                break
            for q, e, d in index.probe(queries[live], j, r):
                q = live[q]
                near = d <= kth[q]
                q, e, d = q[near], e[near], d[near]
                np.add.at(seen, (q, d), sizes[e])
                out.append((q, e, d))
            enough = np.cumsum(seen[live], axis=1) >= k
            kth[live] = np.where(enough.any(axis=1), enough.argmax(axis=1), 8 * m)
            live = live[~(enough.any(axis=1) & (kth[live] <= m * r + j))]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    q, e, d = (np.concatenate(x) for x in zip(*out, strict=True))
    near = d <= kth[q]
    return q[near], e[near], d[near]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the k nearest rows of every row
    where ``is_query`` (of column ``id``) holds, itself included."""
    ready(vectors.sparkSession)
    bits = vectors.agg(F.max(F.size(vec_col))).first()[0] or 1
    coded = cut(codes(vectors, max(8, bits), id_col, vec_col), "codes")
    least = Window.partitionBy("code").orderBy("id")
    entries = cut(coded.distinct().withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k)
                  .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    asks = cut(coded.where(F.col("id") != NO_ID).where(is_query).distinct(), "queries")
    each = asks.select("code").distinct()
    n_entry, n_ask = entries.count(), each.count()
    ib, qb = max(1, -(-n_entry // INDEX_BLOCK)), max(1, -(-n_ask // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("code"), F.lit(ib)).alias("ib"), F.pmod(F.xxhash64("code"), F.lit(qb)).alias("qb")
    every = (lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name))
    left = each.select("code", block[1], every(ib, "ib"))
    right = entries.select("code", "ids", block[0], every(qb, "qb"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"code": pd.Series(dtype=object), "id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="int64")})
        if q.empty or x.empty:
            return none
        rows = [np.frombuffer(b"".join(d["code"]), dtype=np.uint8).reshape(len(d), -1) for d in (q, x)]
        sizes = np.array([len(i) for i in x["ids"]])
        a, e, d = search(Index(rows[1]), sizes, rows[0], k)
        ids = np.concatenate(x["ids"].to_list())
        first = np.cumsum(sizes) - sizes
        n = sizes[e]
        at = np.repeat(first[e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        got = pd.DataFrame({"q": np.repeat(a, n), "distance": np.repeat(d, n), "id": ids[at]})
        got = got.sort_values(["q", "distance", "id"]).groupby("q").head(k)
        return pd.DataFrame({"code": q["code"].to_numpy()[got["q"]], "id": got["id"].to_numpy(), "distance": got["distance"].to_numpy()})

    near = (left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb"))
            .applyInPandas(run, "code binary, id long, distance long"))
    best = Window.partitionBy("code").orderBy("distance", "id")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return (asks.withColumnRenamed("id", "query_id").join(near, "code")
            .select("query_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "distance"))
