"""One experiment run as a single DataFrame plan.

``bounded_panes``: bounded-disorder watermark on a periodic tick (W2),
lateness (L1-L4) and keyed tumbling panes (T1).  Events are read once and
combined to ``(key, tick, window) -> (n, max t)``; both the tick table of
the watermark and the window groups come from that aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.functions.time import window_start
from driftmark.functions.util import col_of, join_nullsafe
from driftmark.operators.watermarks import bounded_steps, ticks_from_pre, with_tick
from driftmark.operators.windows import tumbling_panes_from_groups, window_fate
from driftmark.session import materialize


def bounded_groups(events: DataFrame, stream_cols: list[str], key_cols: list[str],
                   max_ooo: int, period: int, width: int, weight: str | None = None,
                   tmax: str | None = None):
    """-> (window groups ``(key, wstart, wm_before, n)``, tick table).

    ``weight``/``tmax`` accept pre-aggregated input: each row stands for
    ``weight`` events whose largest event time is ``tmax`` (``t`` and
    ``arr`` being slot starts aligned to every width and period used)."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    fine = materialize(
        with_tick(events, period)
        .withColumn("wstart", window_start("t", col_of(width)))
        .groupBy(*key_cols, "tick", "wstart")
        .agg(n.cast("long").alias("n"), F.max(tmax or "t").alias("tmax")))
    pre = (fine.groupBy(*stream_cols, "tick")
               .agg(F.max("tmax").alias("tick_max"), F.sum("n").alias("n")))
    ticks = materialize(ticks_from_pre(pre, stream_cols, max_ooo))
    g = join_nullsafe(fine.select(*key_cols, "tick", "wstart", "n"),
                      ticks.select(*stream_cols, "tick", F.col("wm_begin").alias("wm_before")),
                      [*stream_cols, "tick"], "left")
    groups = (g.groupBy(*key_cols, "wstart", "wm_before")
               .agg(F.sum("n").cast("long").alias("n")))
    return groups, ticks


def bounded_panes(events: DataFrame, stream_cols: list[str], key_cols: list[str],
                  max_ooo: int, period: int, width: int, allowed: int = 0,
                  weight: str | None = None, tmax: str | None = None, runs: bool = False) -> DataFrame:
    groups, ticks = bounded_groups(events, stream_cols, key_cols, max_ooo, period, width,
                                   weight, tmax)
    steps = bounded_steps(ticks, stream_cols, period)
    return tumbling_panes_from_groups(groups, steps, stream_cols, key_cols, width, allowed, runs)


def bounded_fate(events: DataFrame, stream_cols: list[str], key_cols: list[str],
                 max_ooo: int, period: int, width: int, allowed: int = 0) -> DataFrame:
    groups, _ = bounded_groups(events, stream_cols, key_cols, max_ooo, period, width)
    return window_fate(groups, key_cols, width, allowed)


def time_lag_panes(events: DataFrame, stream_cols: list[str], key_cols: list[str],
                   lag: int, period: int, width: int, allowed: int = 0) -> DataFrame:
    """W4 (clock minus a fixed lag on every tick) -> T1.  The firing
    watermark has a closed form, so no as-of scan is needed."""
    from driftmark.operators.watermarks import last_ticks, time_lag_firing, time_lag_watermark
    from driftmark.operators.windows import window_groups
    x = time_lag_watermark(events, lag, period)
    groups = window_groups(x, key_cols, width)
    fire = time_lag_firing(last_ticks(events, stream_cols, period), stream_cols, lag, period)
    return tumbling_panes_from_groups(groups, fire, stream_cols, key_cols, width, allowed)
