"""Timeline shaping: rebase (S4), reference time (S5), keying."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.functions.scan import Scan, blocked_scan, sized
from driftmark.functions.util import join_nullsafe


def rebase_time(df: DataFrame, anchor_ms: int, stream_cols: list[str]) -> DataFrame:
    """``t := anchor + (t - first_t)``, ``first_t`` = the first non-zero
    event time in arrival order of each stream (0 is the "unset" sentinel).
    The anchor is a parameter, not the wall clock.  ``t_orig`` keeps the
    input.  The per-stream first is a partial aggregate (``min`` of an
    ``(arr, seq, t)`` struct), so a hot stream costs one row per task; the few
    firsts are broadcast if their number is small, and the events stay put."""
    firsts = (df.where(F.col("t") != 0)
                .groupBy(*stream_cols)
                .agg(F.min(F.struct("arr", "seq", "t")).getField("t").alias("__first")))
    firsts, _ = sized(firsts)
    if stream_cols:
        x = join_nullsafe(df, firsts, stream_cols, "left")
    else:
        x = join_nullsafe(df.withColumn("__g", F.lit(0)),
                          firsts.withColumn("__g", F.lit(0)), ["__g"], "left").drop("__g")
    return (x.withColumn("t_orig", F.col("t"))
             .withColumn("t", F.lit(anchor_ms) + (F.col("t") - F.col("__first")))
             .drop("__first"))


def reference_time(df: DataFrame, mode: str, stream_cols: list[str]) -> DataFrame:
    """``ref`` column the deviation is measured against.

    ``ingestion``       the arrival time ``arr``
    ``previous_event``  event time of the previous event of the stream in
                        arrival order (NULL for the first); a max-scan of the
                        ``(arr, seq, t)`` struct over earlier rows."""
    if mode == "ingestion":
        return df.withColumn("ref", F.col("arr"))
    if mode != "previous_event":
        raise ValueError(f"unknown reference mode {mode!r}")
    x = df.withColumn("__o", F.struct("arr", "seq", "t"))
    x = blocked_scan(x, stream_cols, None, ["arr", "seq"],
                     [Scan("__prev", "__o", "max", inclusive=False)])
    return x.withColumn("ref", F.col("__prev.t")).drop("__o", "__prev")


def key_by(df: DataFrame, key_cols: list[str], partitions: int | None = None) -> DataFrame:
    """Hash-partition a stream by key (all rows of a key in one task,
    as every keyed operator downstream needs)."""
    if partitions:
        return df.repartition(partitions, *key_cols)
    return df.repartition(*key_cols)
