"""Mixing sources to target weights by balanced (cube) sampling.

A source's target is its share, by weight, of the words wanted in all; a
target stops at ``cap`` times its source's size and the excess is shared
again by weight among the rest.  A document of a source with target ratio
``r`` is taken ``floor(r)`` times, and once more with probability
``r - floor(r)``.  The extra draws are balanced: the flight phase of the cube
method moves the probabilities through the null space of the constraints
(number of documents, number of words) until all but two of a block are 0 or
1; what is left of the blocks flies again together, level by level, and the
at most two undecided documents of a source land by one random draw each.

Hot sources are dealt into blocks of ``BLOCK`` documents by a hash of the id.
All random numbers come from the seed and the block's name, so reruns agree.
A NULL source is a source of its own, ordered last; a document without words
has size 0 and adds nothing; rows with equal ids are separate documents; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.common import attach, cut, free, quoted, ready, word_count

BLOCK = 2048
EPS = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
            cap: float = 2.0) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from rows ``(source, size)``.

    The level ``t`` at which ``sum(min(cap * size, t * weight))`` reaches
    ``share`` of all words: in ascending order of ``cap * size / weight`` a
    source is capped while the level of the rest is above its own.  One row a
    source after a map-side-combined sum; the windows see only those."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.lit([float(x) for x in weights])
    per = per.withColumn("weight", F.get(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    by = Window.orderBy((F.col("source_size") / F.col("weight")), F.asc_nulls_last("source"))
    all_rows = Window.partitionBy()
    per = per.select(
        "*", (F.sum("source_size").over(all_rows) * share).alias("wanted"),
        F.coalesce(F.sum(F.col("source_size") * cap).over(by.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0.0)).alias("capped_before"),
        (F.sum("weight").over(all_rows)
         - F.coalesce(F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
         ).alias("weight_left"))
    per = per.withColumn("capped", F.col("source_size") * cap * F.col("weight_left")
                         <= (F.col("wanted") - F.col("capped_before")) * F.col("weight"))
    open_ = ~F.col("capped")
    level = ((F.col("wanted") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * cap)).over(all_rows),
                                           F.lit(0.0)))
             / F.sum(F.when(open_, F.col("weight"))).over(all_rows))
    return per.withColumn("level", level).select(
        "source", "source_size", "n_docs",
        F.when(F.col("capped"), F.col("source_size") * F.lit(float(cap)))
        .otherwise(F.least(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(float(cap))))
        .cast("double").alias("target"))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase over one block: ``p`` with all but at most two entries 0
    or 1; ``sum(p)`` and ``sum(p * size)`` keep their values."""
    p, s = p.tolist(), size.tolist()
    draw = iter(rng.random(4 * len(p) + 16).tolist())
    live: list[int] = []
    todo = [i for i in range(len(p) - 1, -1, -1) if EPS < p[i] < 1 - EPS]
    while True:
        while len(live) < 3 and todo:
            live.append(todo.pop())
        if len(live) == 3:
            a, b, c = live
            u = [s[c] - s[b], s[a] - s[c], s[b] - s[a]]
            if not any(u):
                u = [1, -1, 0]
        elif len(live) == 2 and s[live[0]] == s[live[1]]:
            u = [1, -1]
        else:
            return np.array(p)
        up = min([(1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(live, u, strict=True) if d])
        down = min([p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(live, u, strict=True) if d])
        step = up if next(draw) * (up + down) < down else -down
        for i, d in zip(live, u, strict=True):
            p[i] = p[i] + step * d
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]


def _flight(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """One flight of every block.  The rows stay Arrow, so ids keep their type
    and value, NULL or not."""
    def block(key: tuple[pa.Scalar, ...], rows_: pa.Table) -> pa.Table:
        # long documents fly first: what stays undecided is among the last, the shortest
        t = rows_.take(pc.sort_indices(rows_, sort_keys=[("size", "descending"), ("h", "ascending"), ("doc_id", "ascending")]))
        source, number = (k.as_py() for k in key)
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(source).encode()), int(number)])
        p = fly(t.column("p").to_numpy(), t.column("size").to_numpy(), rng)
        return t.set_column(t.schema.get_field_index("p"), t.schema.field("p"), pa.array(p))

    return rows.groupBy("source", "block").applyInArrow(block, rows.schema)


def copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
           seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", size: Column | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)``, a row for
    each row of ``docs``: how often the mix takes it (0 to ``cap``)."""
    ready(docs.sparkSession)
    size = word_count(F.col(text_col)) if size is None else size
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                            size.alias("size")), "sizes")
    goal = cut(targets(sized, weights, share, cap), "targets")
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = (sized.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
            .select("d.doc_id", "d.source", "d.size", "source_size", "target",
                    F.floor(ratio + EPS).cast("long").alias("whole"), h.alias("h"),
                    F.pmod(h, F.ceil(F.col("n_docs") / BLOCK)).alias("block"),
                    F.greatest(ratio - F.floor(ratio + EPS), F.lit(0.0)).alias("p")))
    done, n, level = [], -(-most // BLOCK), 0
    while True:
        rows = cut(_flight(rows, seed, level), "flight")
        done.append(rows.where("p = 0 or p = 1"))
        rows = rows.where("p > 0 and p < 1")
        if n <= 1:
            break
        n, level = -(-2 * n // BLOCK), level + 1
        rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "h"), F.lit(n)).cast("long"))
    # landing: at most two documents a source
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("land"), "h", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    last = rows.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0))
    out = last
    for d in done:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    key = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": word_count(F.col("text"))}
    times = free(docs.columns, "__copies")
    took = cut(copies(docs, **kw), "copies").withColumnRenamed("copies", times)
    own = list(map(quoted, docs.columns))
    return (attach(docs, took, key, [times]).where(F.col(times) > 0)
            .select(*own, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*own))
