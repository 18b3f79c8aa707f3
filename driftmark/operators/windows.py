"""Windows and aggregations.

T1 (keyed tumbling panes under a watermark) is computed order-free:

* events are pre-aggregated to ``(key, window, wm_before) -> n``; every
  event of such a group gets the same treatment, so raw rows never travel
  further than the first (map-side combined) aggregation;
* on-time rows of a window form its first pane, fired by the smallest
  emitted watermark ``>= wend - 1`` (watermarks only rise), found by a
  blocked as-of scan over ``(stream, value)``;
* each kept late row re-fires the window with the cumulative count; rows
  of one group share the lag ``wm_before - wend`` and get consecutive
  counts, so the groups only need a running sum ordered by ``wm_before``
  (which rises with arrival).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.functions.scan import Scan, blocked_scan
from driftmark.functions.time import floor_div, gmt_text_ss, window_start
from driftmark.functions.util import col_of, join_nullsafe
from driftmark.operators.lateness import DROPPED, LATE_KEPT, ON_TIME, window_class

PANE_COLS = ["wstart", "wend", "cnt", "lag", "flushed", "late_fire"]
BLOCK_WINDOWS = 1024
REFIRE_PIECE = 10_000  # panes written from one row at a time


def window_groups(df: DataFrame, key_cols: list[str], width: int,
                  count_col: str | None = None) -> DataFrame:
    """Events with ``wm_before`` -> ``(key, wstart, wm_before, n)``."""
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    return (df.withColumn("wstart", window_start("t", col_of(width)))
              .groupBy(*key_cols, "wstart", "wm_before")
              .agg(n.cast("long").alias("n")))


def first_watermark_at_least(probes: DataFrame, steps: DataFrame,
                             stream_cols: list[str], span) -> DataFrame:
    """As-of lookup: every row of ``probes`` (stream columns, ``wend`` and
    any payload) gets ``fire_wm``, the minimum emitted ``wm >= wend - 1`` of
    its stream (NULL if none).

    Probes and steps are unioned and a backward min-scan over
    ``(value, kind)`` runs in value blocks of ``span`` ms; a step equal to
    the probe value sorts after the probe and is therefore seen by it."""
    payload = [c for c in probes.columns if c not in (*stream_cols, "wend")]
    types = {f.name: f.dataType for f in probes.schema.fields}
    p = probes.select(*stream_cols, "wend", *payload,
                      (F.col("wend") - 1).alias("__v"), F.lit(0).alias("__k"),
                      F.lit(None).cast("long").alias("__w"))
    s = steps.select(*stream_cols, F.lit(None).cast("long").alias("wend"),
                     *[F.lit(None).cast(types[c]).alias(c) for c in payload],
                     F.col("wm").alias("__v"), F.lit(1).alias("__k"), F.col("wm").alias("__w"))
    u = blocked_scan(p.unionByName(s), stream_cols,
                     floor_div(F.col("__v"), col_of(span)), ["__v", "__k"],
                     [Scan("fire_wm", "__w", "min", backward=True)])
    return u.where(F.col("__k") == 0).drop("__v", "__k", "__w")


def tumbling_panes_from_groups(groups: DataFrame, firing, stream_cols: list[str],
                               key_cols: list[str], width: int,
                               allowed: int = 0, runs: bool = False) -> DataFrame:
    """T1 + L3 + L4 on pre-aggregated groups ``(key, wstart, wm_before, n)``.

    ``firing`` is either a DataFrame of emitted watermarks ``(stream, wm)``
    or a callable ``f(on_time_windows) -> same + fire_wm`` (closed forms,
    e.g. the time-lag assigner).  ``key_cols`` must contain ``stream_cols``.

    Output per pane: key columns, ``wstart, wend, cnt, lag, flushed,
    late_fire``.  ``flushed`` panes never saw a firing watermark (end of
    stream) and have ``lag`` NULL.  With ``runs`` the re-fires of one group
    stay one row: ``n`` panes with the counts ``cnt``, ``cnt + 1``, ...
    """
    out = _pane_runs(groups, firing, stream_cols, key_cols, width, allowed)
    return out if runs else expand_runs(out)


def pane_count(panes: DataFrame):
    """Panes that a row stands for: its ``n``, or one."""
    return F.col("n") if "n" in panes.columns else F.lit(1).cast("long")


def expand_runs(runs: DataFrame) -> DataFrame:
    """One row a pane, from pieces of bounded length: no row ever holds an
    array as long as a hot window's late elements."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("n") - 1, col_of(REFIRE_PIECE))))
    x = runs.withColumn("__p", piece)
    first = F.col("cnt") + F.col("__p") * REFIRE_PIECE
    last = F.least(first + (REFIRE_PIECE - 1), F.col("cnt") + F.col("n") - 1)
    cols = [F.explode(F.sequence(first, last)).alias("cnt") if c == "cnt" else F.col(c)
            for c in runs.columns if c != "n"]
    return x.select(*cols)


def _pane_runs(groups: DataFrame, firing, stream_cols: list[str], key_cols: list[str],
               width: int, allowed: int) -> DataFrame:
    from driftmark.session import materialize
    missing = [c for c in stream_cols if c not in key_cols]
    if missing:
        raise ValueError(f"stream columns {missing} must be part of the window key")
    g = materialize(
        groups.withColumn("wend", F.col("wstart") + col_of(width))
              .withColumn("cls", window_class("wend", "wm_before", col_of(allowed)))
              .where(F.col("cls") != DROPPED))
    # on-time panes: one per window, fired by the first watermark >= wend - 1
    on = (g.where(F.col("cls") == ON_TIME)
            .groupBy(*key_cols, "wstart", "wend")
            .agg(F.sum("n").cast("long").alias("cnt")))
    if not isinstance(firing, DataFrame):
        on = firing(on)
    elif set(key_cols) == set(stream_cols):
        # one window per (stream, wend): probe the windows themselves
        on = first_watermark_at_least(on, firing, stream_cols,
                                      col_of(width) * F.lit(BLOCK_WINDOWS))
    else:
        ends = on.select(*stream_cols, "wend").distinct()
        fired = first_watermark_at_least(ends, firing, stream_cols,
                                         col_of(width) * F.lit(BLOCK_WINDOWS))
        on = join_nullsafe(on, fired, [*stream_cols, "wend"], "left")
    on_panes = on.select(
        *key_cols, "wstart", "wend", "cnt",
        (F.col("fire_wm") - F.col("wend")).alias("lag"),
        F.col("fire_wm").isNull().alias("flushed"),
        F.lit(False).alias("late_fire"), F.lit(1).cast("long").alias("n"))

    # kept late rows: each re-fires with the cumulative count.  Groups of a
    # window in wm_before order put all on-time groups first (their
    # wm_before < wend - 1 <= any late one), so the exclusive running sum of
    # n is exactly the count before the group's first re-fire.
    x = blocked_scan(g, [*key_cols, "wstart"],
                     floor_div(F.col("wm_before"), col_of(width)), ["wm_before"],
                     [Scan("__before", "n", "sum", inclusive=False)])
    late = x.where(F.col("cls") == LATE_KEPT)
    base = F.col("__before").cast("long")
    late_panes = late.select(
        *key_cols, "wstart", "wend", (base + 1).alias("cnt"),
        (F.col("wm_before") - F.col("wend")).alias("lag"),
        F.lit(False).alias("flushed"),
        F.lit(True).alias("late_fire"), F.col("n").cast("long").alias("n"))
    return on_panes.unionByName(late_panes)


def tumbling_panes(df: DataFrame, firing, stream_cols: list[str], key_cols: list[str],
                   width: int, allowed: int = 0) -> DataFrame:
    """T1 from per-event rows carrying ``t`` and ``wm_before``."""
    return tumbling_panes_from_groups(window_groups(df, key_cols, width), firing,
                                      stream_cols, key_cols, width, allowed)


def window_fate(groups: DataFrame, key_cols: list[str], width: int,
                allowed: int = 0) -> DataFrame:
    """Per key: elements on time / kept late (re-fires) / dropped."""
    g = groups.withColumn(
        "cls", window_class(F.col("wstart") + col_of(width), "wm_before", col_of(allowed)))
    return g.groupBy(*key_cols).agg(
        F.sum(F.when(F.col("cls") == ON_TIME, F.col("n")).otherwise(0)).cast("long").alias("on_time"),
        F.sum(F.when(F.col("cls") == LATE_KEPT, F.col("n")).otherwise(0)).cast("long").alias("refires"),
        F.sum(F.when(F.col("cls") == "dropped", F.col("n")).otherwise(0)).cast("long").alias("dropped"))


def counted_elements(panes: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Total over all pane counts (the reference's shared static sum);
    takes panes or runs of panes."""
    n = pane_count(panes)
    total = n * F.col("cnt") + floor_div(n * (n - 1), F.lit(2).cast("long"))
    return panes.groupBy(*(group_cols or [])).agg(F.sum(total).cast("long").alias("counted"))


# --- windows without a watermark (T2-T8) -------------------------------------

def tumbling_count_all(df: DataFrame, width: int, wm: int) -> DataFrame:
    """Non-keyed tumbling count, lag against a fixed watermark."""
    return (df.withColumn("wstart", window_start("t", col_of(width)))
              .groupBy("wstart").agg(F.count(F.lit(1)).alias("cnt"))
              .withColumn("wend", F.col("wstart") + col_of(width))
              .withColumn("lag", F.lit(wm) - F.col("wend")))


def _exact(value: str, scale: int | None):
    """Sum operand: with ``scale`` the values are summed as DECIMAL, so the
    sum (and the mean) does not depend on the order Spark adds them in."""
    v = F.col(value)
    return v.cast(f"decimal(38,{scale})") if scale is not None else v


def tumbling_avg_all(df: DataFrame, width: int, value: str = "value",
                     scale: int | None = None) -> DataFrame:
    """Window, mean of ``value``, count."""
    return (df.withColumn("wstart", window_start("t", col_of(width)))
              .groupBy("wstart")
              .agg((F.sum(_exact(value, scale)).cast("double") / F.count(value)).alias("avg_value"),
                   F.count(F.lit(1)).alias("cnt"))
              .withColumn("wend", F.col("wstart") + col_of(width)))


def tumbling_count_labels(df: DataFrame, width: int) -> DataFrame:
    """T4: window count labelled with GMT text ``yyyy-MM-dd HH:mm:ss.SS``."""
    return (tumbling_count_all(df, width, 0)
            .select(gmt_text_ss("wstart").alias("start_text"),
                    gmt_text_ss("wend").alias("end_text"), "cnt"))


def arrival_ordinal(df: DataFrame, key_cols: list[str], out: str = "ordinal") -> DataFrame:
    """1-based position of each row in its key's arrival order ``(arr, seq)``,
    by a scan in blocks of about equal numbers of rows."""
    x = df.withColumn("__one", F.lit(1).cast("long"))
    x = blocked_scan(x, key_cols, None, ["arr", "seq"], [Scan(out, "__one", "sum")])
    return x.drop("__one")


def count_windows(df: DataFrame, key_cols: list[str], n: int, purge: bool = True,
                  bounds: bool = False) -> DataFrame:
    """Global window per key that fires every ``n`` elements (arrival
    order).  An incomplete tail never fires.  ``purge=False`` keeps the
    contents, so pane ``i`` counts ``(i+1)*n``.  ``bounds`` adds min/max
    event time of the pane's contents as GMT text."""
    x = arrival_ordinal(df, key_cols)
    x = x.withColumn("win", floor_div(F.col("ordinal") - 1, F.lit(n)))
    per = x.groupBy(*key_cols, "win").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("t").alias("tmin"), F.max("t").alias("tmax"))
    per = per.where(F.col("cnt") == n)
    if not purge:
        # cumulative contents: running min/max/count over windows of the key
        per = blocked_scan(per, key_cols, floor_div(F.col("win"), F.lit(4096)), ["win"],
                           [Scan("ccnt", "cnt", "sum"), Scan("ctmin", "tmin", "min"),
                            Scan("ctmax", "tmax", "max")])
        per = (per.drop("cnt", "tmin", "tmax")
                  .withColumnRenamed("ccnt", "cnt").withColumnRenamed("ctmin", "tmin")
                  .withColumnRenamed("ctmax", "tmax"))
    cols = [*key_cols, "win", F.col("cnt").cast("long").alias("cnt")]
    if bounds:
        cols += [gmt_text_ss("tmin").alias("min_text"), gmt_text_ss("tmax").alias("max_text")]
    return per.select(*cols)


def session_windows(df: DataFrame, key_cols: list[str], gap_ms: int) -> DataFrame:
    """Event-time sessions with gap ``gap_ms`` (rows exactly one gap
    apart share a session, as with Spark's ``session_window``).

    Gaps and islands over event time, in two levels.  Rows are first combined
    to time slots of the gap's length (map-side): rows of one slot share a
    session, so a slot is its first and last time and a count, and a hot key
    is as many rows as it has slots.  Over the slots one scan (in blocks of
    about equal numbers of rows) finds where a slot begins more than a gap
    after the one before ended; the number of such breaks names the session.
    A break's running number only needs each slot's own flag, so both scans
    run over the small table."""
    slot = floor_div(F.col("t"), F.lit(max(gap_ms, 1)).cast("long"))
    x = (df.groupBy(*key_cols, slot.alias("__slot"))
           .agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"), F.count(F.lit(1)).alias("__n")))
    x = blocked_scan(x, key_cols, None, ["__slot"], [Scan("__prev", "__hi", "max", inclusive=False)])
    brk = F.when(F.col("__prev").isNull() | (F.col("__lo") - F.col("__prev") > F.lit(gap_ms)), 1).otherwise(0).cast("long")
    x = blocked_scan(x.withColumn("__brk", brk), key_cols, None, ["__slot"], [Scan("__sid", "__brk", "sum")])
    return (x.groupBy(*key_cols, "__sid")
              .agg(F.min("__lo").alias("sstart"), (F.max("__hi") + F.lit(gap_ms)).alias("send"), F.sum("__n").alias("cnt"))
              .drop("__sid"))


def session_windows_builtin(df: DataFrame, key_cols: list[str], gap_ms: int) -> DataFrame:
    """T7 with Spark's ``session_window`` (all rows of a key merge in one
    task; kept for comparison and for small keys)."""
    ts = F.timestamp_millis(F.col("t"))
    s = (df.groupBy(*key_cols, F.session_window(ts, f"{gap_ms} milliseconds").alias("s"))
           .agg(F.count(F.lit(1)).alias("cnt")))
    return s.select(*key_cols,
                    F.unix_millis(F.col("s.start")).alias("sstart"),
                    F.unix_millis(F.col("s.end")).alias("send"), "cnt")


def running_average(df: DataFrame, key_cols: list[str], value: str = "value", text: bool = False,
                    scale: int | None = None) -> DataFrame:
    """Mean of the non-NULL ``value``s over all earlier-or-equal rows of
    the key in arrival order, NULL while there is none (blocked scan of sum
    and count; ``scale`` sums exactly)."""
    x = df.withColumn("__one", F.col(value).isNotNull().cast("long"))
    if scale is not None:
        x = x.withColumn("__v", _exact(value, scale))
        value = "__v"
    x = blocked_scan(x, key_cols, None, ["arr", "seq"],
                     [Scan("__s", value, "sum"), Scan("__c", "__one", "sum")])
    x = (x.withColumn("running_avg", F.try_divide(F.col("__s").cast("double"), F.col("__c").cast("double")))
          .drop("__one", "__s", "__c", "__v"))
    if text:
        x = x.withColumn("running_text", F.format_string("Average so far is %f", F.col("running_avg")))
    return x
