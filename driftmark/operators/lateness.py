"""Lateness accounting (L1-L4) as column expressions and aggregates.

Window-level rules (``wend`` exclusive, ``allowed`` = allowed lateness):

* dropped       ``wend - 1 + allowed <= wm_before``   (L3)
* on time       not dropped and ``wm_before < wend - 1``
* late, kept    otherwise: re-fires its window (L4)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions.util import col_of

ON_TIME, LATE_KEPT, DROPPED = "on_time", "late_kept", "dropped"


def flag_late(df: DataFrame) -> DataFrame:
    """L1: ``late := t < wm_before`` (strict)."""
    return df.withColumn("late", F.col("t") < F.col("wm_before"))


def window_class(wend, wm_before, allowed) -> Column:
    wend, wm_before, allowed = col_of(wend), col_of(wm_before), col_of(allowed)
    return (F.when(wend - 1 + allowed <= wm_before, F.lit(DROPPED))
             .when(wm_before < wend - 1, F.lit(ON_TIME))
             .otherwise(F.lit(LATE_KEPT)))


def drop_late(df: DataFrame, width, allowed=0) -> DataFrame:
    """L3: keep rows whose window is still open (needs ``t``, ``wm_before``)."""
    from driftmark.functions.time import window_start
    wend = window_start("t", width) + col_of(width)
    return df.where(~(wend - 1 + col_of(allowed) <= F.col("wm_before")))


def late_stats(df: DataFrame, stream_cols: list[str], steps: DataFrame | None = None) -> DataFrame:
    """L2: per stream total, late, late ratio (+ watermarks generated).

    ``df`` has ``late``; ``steps`` (stream, wm) optionally counts emitted
    watermarks.  Partial aggregation runs map-side, so a hot stream costs
    one row per partition in the exchange."""
    keys = list(stream_cols) or ["__all"]
    if not stream_cols:
        df = df.withColumn("__all", F.lit(0))
        steps = steps.withColumn("__all", F.lit(0)) if steps is not None else None
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("late")).alias("late"))
    out = out.withColumn("late_ratio", F.round(F.try_divide(F.col("late"), F.col("total")), 9))
    if steps is not None:
        from driftmark.functions.util import join_nullsafe
        wms = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("watermarks"))
        out = join_nullsafe(out, wms, keys, "left")
        out = out.withColumn("watermarks", F.coalesce("watermarks", F.lit(0)))
    return out.drop("__all")
