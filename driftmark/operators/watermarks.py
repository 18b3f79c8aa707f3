"""Watermark assigners that are pure DataFrame plans.

Every per-event assigner returns the input plus

``wm_before``  watermark in force when the event is judged (0 = none yet)
``wm_after``   watermark in force once the event (and its tick) is done
``late``       ``t < wm_before``

Periodic assigners work on one row per ``(stream, arrival tick)``: the
events are aggregated first, the running maximum runs over ticks with the
blocked scan (a hot stream is split into tick blocks), and the tick table
is joined back.  Ticks are epoch-aligned: tick ``k`` covers arrivals in
``[k*period, (k+1)*period)`` and its timer fires at ``(k+1)*period``.
The tick holding a stream's last event never fires (end of stream).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.scan import Scan, blocked_scan, depth_blocks, sized
from driftmark.functions.time import floor_div, window_start
from driftmark.functions.util import col_of, join_nullsafe, key_struct

BLOCK_TICKS = 4096


def with_tick(df: DataFrame, period) -> DataFrame:
    return df.withColumn("tick", floor_div(F.col("arr"), col_of(period)))


def bounded_ticks(df: DataFrame, stream_cols: list[str], max_ooo: int,
                  period: int, block_ticks: int = BLOCK_TICKS,
                  changes: bool = False) -> DataFrame:
    """One row per (stream, tick with events):

    ``tick_max``   max event time in the tick
    ``wm_begin``   watermark in force during the tick
                   = max(0, max t over strictly earlier ticks - max_ooo)
    ``wm_end``     watermark after the tick's timer (= ``wm_begin`` for the
                   stream's last tick, whose timer never fires)
    ``is_last``    last tick of the stream
    ``changed``    the previous tick of the stream is ``tick - 1`` and its
                   timer raised the watermark (W3 notification)
    ``first_arr``/``first_seq`` first event of the tick in arrival order
    """
    pre = (with_tick(df, period)
           .groupBy(*stream_cols, "tick")
           .agg(F.max("t").alias("tick_max"), F.count(F.lit(1)).alias("n"),
                F.min(F.struct("arr", "seq")).alias("first")))
    return ticks_from_pre(pre, stream_cols, max_ooo, block_ticks, changes)


def ticks_from_pre(pre: DataFrame, stream_cols: list[str], max_ooo: int,
                   block_ticks: int = BLOCK_TICKS, changes: bool = False) -> DataFrame:
    """Watermark columns for a tick table ``(stream, tick, tick_max, n[, first])``."""
    if "first" not in pre.columns:
        pre = pre.withColumn("first", F.struct(F.lit(None).cast("long").alias("arr"),
                                               F.lit(None).cast("long").alias("seq")))
    ticks = blocked_scan(
        pre, stream_cols, floor_div(F.col("tick"), F.lit(block_ticks)), ["tick"],
        [Scan("prev_max", "tick_max", "max", inclusive=False),
         Scan("cum_max", "tick_max", "max"),
         Scan("next_tick", "tick", "min", backward=True, inclusive=False)])
    ooo = col_of(max_ooo)
    wm_begin = F.greatest(F.coalesce("prev_max", F.lit(0)) - ooo, F.lit(0))
    wm_fire = F.greatest(F.greatest("cum_max", F.lit(0)) - ooo, F.lit(0))
    ticks = (ticks
             .withColumn("wm_begin", wm_begin)
             .withColumn("is_last", F.col("next_tick").isNull())
             .withColumn("wm_end", F.when(F.col("is_last"), F.col("wm_begin"))
                         .otherwise(F.greatest(wm_fire, F.col("wm_begin"))))
             .withColumn("raises", (F.col("wm_end") > F.col("wm_begin")).cast("long")))
    if not changes:
        return ticks.select(*stream_cols, "tick", "n", "tick_max", "wm_begin", "wm_end",
                            "is_last", F.lit(None).cast("boolean").alias("changed"),
                            F.col("first.arr").alias("first_arr"),
                            F.col("first.seq").alias("first_seq"))
    # The flag set by tick k-1 reaches the first event of tick k only if
    # tick k-1 held events (else the empty tick's timer cleared the flag).
    # The previous tick and its `raises` bit travel together in one max scan.
    ticks = blocked_scan(
        ticks.withColumn("code", F.col("tick") * 2 + F.col("raises")),
        stream_cols, floor_div(F.col("tick"), F.lit(block_ticks)), ["tick"],
        [Scan("prev_code", "code", "max", inclusive=False)])
    prev_tick = floor_div(F.col("prev_code"), F.lit(2))
    ticks = ticks.withColumn(
        "changed",
        F.coalesce((prev_tick == F.col("tick") - 1) & (F.pmod("prev_code", F.lit(2)) == 1),
                   F.lit(False)))
    return ticks.select(*stream_cols, "tick", "n", "tick_max", "wm_begin", "wm_end",
                        "is_last", "changed",
                        F.col("first.arr").alias("first_arr"),
                        F.col("first.seq").alias("first_seq"))


def maxima_met(df: DataFrame, stream_cols: list[str], key_cols: list[str], periods: list[int],
               t_slot: int) -> DataFrame:
    """What decides W2 for several periods at once: ``(key, t, max0, max1, ..., n)``,
    where ``max<i>`` is the greatest event time of the stream's ticks of
    ``periods[i]`` before that of the event (NULL: none), ``t`` the start of its slot
    of ``t_slot`` ms and ``n`` the events that are equal in all that.

    The events move once, to blocks of their stream (``depth_blocks``, which no
    tick of any period straddles); what earlier blocks hold is one row a block."""
    arr_slot, whole = math.gcd(*periods), math.lcm(*periods)
    x = depth_blocks(df.select(*key_cols, "t", "arr", floor_div(F.col("arr"), F.lit(whole).cast("long")).alias("__big")),
                     stream_cols, ["__big"])
    pk, hk, path = "__pk", "__hk", "__path"
    blocks = path in x.columns
    own = [hk, pk, *([path] if blocks else [])]
    x = x.withColumn(pk, key_struct(list(stream_cols)))
    x = x.withColumn(hk, F.xxhash64(pk, *([path] if blocks else [])))
    y = (x.repartition(*own)
          .groupBy(*own, *key_cols, window_start("arr", F.lit(arr_slot).cast("long")).alias("arr"),
                   window_start("t", F.lit(t_slot).cast("long")).alias("t"))
          .agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("tmax")))
    for i, p in enumerate(periods):
        # an event without an arrival time comes first
        tick = F.coalesce(floor_div(F.col("arr"), F.lit(p).cast("long")), F.lit(-(1 << 62)))
        w = Window.partitionBy(*own).orderBy("__tick").rangeBetween(Window.unboundedPreceding, -1)
        y = y.withColumn("__tick", tick).withColumn(f"max{i}", F.max("tmax").over(w)).drop("__tick")
    if blocks:
        before = Window.partitionBy(pk).orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
        carry, _ = sized(x.groupBy(*own).agg(F.max("t").alias("__top")).select(*own, F.max("__top").over(before).alias("__car")))
        y = y.join(carry, own, "left").withColumns({f"max{i}": F.greatest(f"max{i}", "__car") for i in range(len(periods))})
    maxima = [f"max{i}" for i in range(len(periods))]
    return (y.groupBy(*own, *key_cols, "t", *maxima).agg(F.sum("n").cast("long").alias("n"))
             .select(*key_cols, "t", *maxima, "n"))


def bounded_watermark(df: DataFrame, stream_cols: list[str], max_ooo: int,
                      period: int, emit: str = "tick", ticks: DataFrame | None = None) -> DataFrame:
    """W2 / W3.  ``ticks``: the table of ``bounded_ticks`` if there already.  ``emit='next_event'`` adds ``wm_changed``: the event is the
    first of its tick and consumes the change flag set by the previous tick."""
    from driftmark.session import materialize
    if ticks is None:
        ticks = materialize(bounded_ticks(df, stream_cols, max_ooo, period,
                                          changes=emit == "next_event"))
    keep = [*stream_cols, "tick", "wm_begin", "wm_end"]
    if emit == "next_event":
        keep += ["changed", "first_arr", "first_seq"]
    out = join_nullsafe(with_tick(df, period), ticks.select(*keep),
                        [*stream_cols, "tick"], "left")
    out = (out.withColumnRenamed("wm_begin", "wm_before")
              .withColumnRenamed("wm_end", "wm_after")
              .withColumn("late", F.col("t") < F.col("wm_before")))
    if emit == "next_event":
        first = (F.col("arr") == F.col("first_arr")) & (F.col("seq") == F.col("first_seq"))
        out = (out.withColumn("wm_changed", first & F.col("changed"))
                  .drop("changed", "first_arr", "first_seq"))
    return out


def bounded_steps(ticks: DataFrame, stream_cols: list[str], period: int) -> DataFrame:
    """Emitted watermarks of W2: ``(stream, wm, at)``; ``at`` = timer time."""
    return (ticks.where(F.col("wm_end") > F.col("wm_begin"))
            .select(*stream_cols, F.col("wm_end").alias("wm"),
                    ((F.col("tick") + 1) * col_of(period)).alias("at")))


def time_lag_watermark(df: DataFrame, lag: int = 100, period: int = 200) -> DataFrame:
    """At every tick the watermark becomes ``tick time - lag`` (the
    reference subtracts 100 ms from the clock).  Pure arithmetic per row."""
    x = with_tick(df, period)
    wm = x.tick * col_of(period) - col_of(lag)
    return (x.withColumn("wm_before", wm)
             .withColumn("wm_after", wm)
             .withColumn("late", F.col("t") < F.col("wm_before")))


def time_lag_firing(stream_last: DataFrame, stream_cols: list[str], lag, period):
    """Firing of W4 for on-time windows: the first tick value
    ``k*period - lag >= wend - 1``; it was emitted iff ``k`` does not pass the
    stream's last tick (``stream_last``: ``(stream, last_tick)``), whose
    timer never fires."""
    lag, period = col_of(lag), col_of(period)

    def fire(on: DataFrame) -> DataFrame:
        k = floor_div(F.col("wend") - 1 + lag + period - 1, period)
        x = (join_nullsafe(on, stream_last, stream_cols, "left") if stream_cols
             else _attach_global(on, stream_last))
        return (x.withColumn("fire_wm", F.when(k <= F.col("last_tick"), k * period - lag))
                 .drop("last_tick"))
    return fire


def _attach_global(on: DataFrame, stream_last: DataFrame) -> DataFrame:
    """Single-stream case: attach the one-row table through a constant key."""
    return join_nullsafe(on.withColumn("__g", F.lit(0)),
                         stream_last.withColumn("__g", F.lit(0)), ["__g"], "left").drop("__g")


def last_ticks(df: DataFrame, stream_cols: list[str], period) -> DataFrame:
    """``(stream, last_tick)``: tick of each stream's last arrival."""
    return (df.groupBy(*stream_cols)
              .agg(floor_div(F.max("arr"), col_of(period)).alias("last_tick")))


def marker_watermark(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Watermarks carried in the stream itself (rows keyed ``W``).

    ``events`` and ``markers`` both have ``seq`` = line order; a marker
    applies to every stream.  The watermark in force for an event is the
    running max of marker times over earlier lines (regressions ignored).
    Markers and events are unioned and one backward-free max scan over line
    order runs in blocks of lines, so no task holds the whole file.
    """
    ev = events.select("*", F.lit(None).cast("long").alias("__mk"))
    mk = markers.select(*[F.lit(None).cast(f.dataType).alias(f.name)
                          for f in events.schema.fields if f.name not in ("seq",)],
                        F.col("seq"), F.col("t").alias("__mk"))
    mk = mk.select(*ev.columns)
    both = ev.unionByName(mk)
    both = blocked_scan(both, [], floor_div(F.col("seq"), F.lit(1 << 16)), ["seq"],
                        [Scan("__before", "__mk", "max", inclusive=False)])
    out = both.where(F.col("__mk").isNull()).drop("__mk")
    wm = F.coalesce(F.col("__before"), F.lit(0))
    return (out.withColumn("wm_before", F.greatest(wm, F.lit(0)))
               .withColumn("wm_after", F.col("wm_before"))
               .withColumn("late", F.col("t") < F.col("wm_before"))
               .drop("__before"))


def steps_from_events(df: DataFrame, stream_cols: list[str]) -> DataFrame:
    """Emitted watermarks of a per-event assigner (W1): rows where the
    watermark rose after the event; ``at`` = arrival of that event."""
    return (df.where(F.col("wm_after") > F.col("wm_before"))
            .select(*stream_cols, F.col("wm_after").alias("wm"), F.col("arr").alias("at")))


def watermark_steps(steps: DataFrame, stream_cols: list[str]) -> DataFrame:
    """Distinct emitted watermarks per stream with their ordinal.

    Emitted watermarks strictly increase, so the ordinal is a running count
    by value, in blocks of about equal numbers of steps (no whole-stream task)."""
    steps = steps.withColumn("__one", F.lit(1))
    out = blocked_scan(steps, stream_cols, None, ["wm"], [Scan("ordinal", "__one", "sum")])
    return out.drop("__one").withColumn("ordinal", F.col("ordinal").cast("long"))
