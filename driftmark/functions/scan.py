"""Two-level (blocked) prefix and suffix scans.

A running aggregate over an ordered partition is usually written as
``agg(v).over(Window.partitionBy(p).orderBy(o).rowsBetween(...))``.  That
puts every row of partition ``p`` into one task, which is exactly what a hot
stream (a third of all rows in one key) must not do.  The associative
aggregates we need (max, min, sum) split cleanly:

1. inside ``(p, block)`` the running aggregate is a normal window
   (many small partitions, hash-distributed);
2. one row per ``(p, block)`` carries the block total; a window over those
   block rows (``#rows / block size`` of them) yields the carry-in from all
   earlier (or later) blocks;
3. carry and local value combine per row.

The block table is grouped on the same keys the level-1 window already
hash-partitioned by, and the join back is on those keys, so the only large
exchange is the level-1 one.  ``block`` must be monotone in the order.

Without a ``block`` the blocks come from the data (``depth_blocks``): a partition
of up to twice ``TARGET_ROWS`` rows is one block, a larger one is cut where its
rows are, so that blocks hold about that many whether a stream is sparse,
dense or comes in bursts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.util import col_of, key_struct

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Scan:
    """One running aggregate: ``out := agg(value)`` over the rows before
    (``backward=False``) or after (``backward=True``) the current one,
    the current row included iff ``inclusive``."""

    out: str
    value: str
    agg: str = "max"
    backward: bool = False
    inclusive: bool = True


def _combine(agg: str, local: Column, carry: Column) -> Column:
    if agg == "max":
        return F.greatest(local, carry)  # greatest/least skip NULLs
    if agg == "min":
        return F.least(local, carry)
    return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))


#: Rows that a block should hold; the unit that one task sorts.
TARGET_ROWS = 1 << 18
#: Slots a block is cut from, rounds of cutting, rows of a side that is broadcast.
SLOTS, ROUNDS, SMALL = 16, 12, 100_000


def sized(side: DataFrame) -> tuple[DataFrame, int]:
    """A table to be used more than once, marked for broadcast if it is small."""
    from driftmark.session import materialize
    side = materialize(side)
    n = side.count()
    return (F.broadcast(side) if n <= SMALL else side), n


def depth_blocks(df: DataFrame, part_cols: list[str], order_cols: list[str], out: str = "__path",
                 target: int | None = None) -> DataFrame:
    """``df`` with ``out``, an array of numbers that rises with ``order_cols`` (whole
    numbers, NULL first) within a partition and holds for at most about twice
    ``target`` rows; ``df`` itself, without it, if no partition has more.

    Each round counts the rows of what is still too large (map-side combined),
    cuts its range of the first order column that is not the same throughout
    into equal slots, counts those, and gives slots whose running counts fall
    into the same multiple of ``target`` one number.  A slot that holds more by
    itself (a burst) gets one of its own and is cut again in the next round, a
    sparse stretch never."""
    target = target or TARGET_ROWS
    # names of its own: callers order by columns such as ``__b`` or ``__slot``
    own = "__db"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    k, num, slot_, size, before, block = (f"{own}{c}" for c in ("k", "n", "slot", "size", "before", "block"))
    least, most = ([f"{own}{n}{i}" for i in range(len(order_cols))] for n in ("lo", "hi"))
    cur, cut = df.select("*", key_struct(list(part_cols)).alias(k), F.array().cast("array<bigint>").alias(out)), False
    for _ in range(ROUNDS):
        ends = [f(c).alias(n[i]) for i, c in enumerate(order_cols) for n, f in ((least, F.min), (most, F.max))]
        hot, n = sized(cur.groupBy(k, out).agg(F.count(F.lit(1)).alias(num), *ends).where(F.col(num) > 2 * target))
        if not n:
            break
        y = cur.join(hot, [k, out], "left")
        # the first column that tells rows apart, from its least to its greatest value
        use = lo = hi = None
        for i, c in reversed(list(enumerate(order_cols))):
            here = F.col(least[i]) < F.col(most[i])
            use, lo, hi = (v if w is None else F.when(here, v).otherwise(w) for v, w in
                           ((F.col(c), use), (F.col(least[i]), lo), (F.col(most[i]), hi)))
        parts = F.ceil(F.col(num) * SLOTS / target)
        width = F.greatest(F.ceil((hi - lo + 1) / parts), F.lit(1))
        slot = F.when(F.col(num).isNotNull(), F.coalesce(F.floor((use - lo) / width), F.lit(-1))).cast("long")
        y = y.withColumn(slot_, slot).drop(num, *least, *most)
        slots = y.where(F.col(slot_).isNotNull()).groupBy(k, out, slot_).agg(F.count(F.lit(1)).alias(size))
        slots = blocked_scan(slots, [k, out], F.floor(F.col(slot_) / 4096), [slot_],
                             [Scan(before, size, "sum", inclusive=False)])
        number = F.floor(F.col(before) / target).cast("long") * 2 + (F.col(size) > target).cast("long")
        slots, _ = sized(slots.select(k, out, slot_, number.alias(block)))
        y = y.join(slots, [k, out, slot_], "left")
        cur = y.select(*df.columns, k, F.when(F.col(block).isNull(), F.col(out)).otherwise(
            F.concat(out, F.array(block))).alias(out))
        cut = True
    return cur.drop(k) if cut else df


def blocked_scan(df: DataFrame, part_cols: list[str], block, order_cols,
                 scans: list[Scan], target: int | None = None) -> DataFrame:
    """Add one column per :class:`Scan`; see the module doc for the plan.
    ``block=None``: blocks from the data, of about ``target`` rows.

    The partition key travels as one struct column, so the level-1 window,
    the block aggregate and the join back all cluster on the same
    ``(key, block)`` columns and share one exchange of the input.

    Every frame is a running frame starting at ``unboundedPreceding`` (Spark
    evaluates those incrementally); a backward scan runs forward over the
    reversed order, since ``... unboundedFollowing`` frames of min/max are
    re-evaluated per row (quadratic in the partition size).  Order columns
    must be unique within a partition for exclusive scans."""
    pk, bcol, hk = "__pk", "__blk", "__hk"
    columns = df.columns
    if block is None:
        df = depth_blocks(df, part_cols, order_cols, "__path", target)
        block = F.col("__path") if "__path" in df.columns else None
    asc = [col_of(c) for c in order_cols]
    desc = [c.desc() for c in asc]
    # the 64-bit key hash leads every sort: sorts compare a fixed-width
    # prefix instead of the struct (a function of the key, so harmless)
    key = key_struct(list(part_cols))
    x = df.select(*columns, key.alias(pk), F.xxhash64(key).alias(hk), *([] if block is None else [col_of(block).alias(bcol)]))
    own = [hk, pk] if block is None else [hk, pk, bcol]
    local = []
    for i, s in enumerate(scans):
        w1 = Window.partitionBy(*own).orderBy(*(desc if s.backward else asc))
        frame = (Window.unboundedPreceding, 0 if s.inclusive else -1)
        local.append(_AGG[s.agg](s.value).over(w1.rowsBetween(*frame)).alias(f"__loc{i}"))
    x = x.select("*", *local)
    kept = [F.col(c) for c in columns if c not in {s.out for s in scans}]
    if block is None:  # each partition is one block: nothing to carry
        return x.select(*kept, *[_combine(s.agg, F.col(f"__loc{i}"), F.lit(None)).alias(s.out) for i, s in enumerate(scans)])

    blocks = x.groupBy(hk, pk, bcol).agg(
        *[_AGG[s.agg](s.value).alias(f"__tot{i}") for i, s in enumerate(scans)])
    carry_cols = []
    for i, s in enumerate(scans):
        w2 = Window.partitionBy(hk, pk).orderBy(F.col(bcol).desc() if s.backward else F.col(bcol))
        carry_cols.append(
            _AGG[s.agg](f"__tot{i}").over(w2.rowsBetween(Window.unboundedPreceding, -1))
            .alias(f"__car{i}"))
    carry = blocks.select(hk, pk, bcol, *carry_cols)

    y = x.join(carry, [hk, pk, bcol], "left")
    out = [_combine(s.agg, F.col(f"__loc{i}"), F.col(f"__car{i}")).alias(s.out)
           for i, s in enumerate(scans)]
    return y.select(*kept, *out)
