"""Registered queries (Spark) and their oracles (DuckDB SQL).

Each query takes ``(spark, sf_dir)``, reads the driver's tables in full and
returns a DataFrame.  Queries that exercise text formats render their input
from ``events`` into a fresh folder under the checkpoint root first.  The
oracle, where one exists, restates the expected rows from the tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.plans import adaptive_sql as AQ
from driftmark.plans import oracle_sql as Q
from driftmark.sources.fixtures import event_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

H = 3_600_000                   # one hour in ms
FIXED_WM = 1_706_745_600_000    # 2024-02-01 00:00:00 UTC, a fixed watermark (T2)
LABEL_WIDTH = 90_061            # odd width so window bounds carry milliseconds (T4)
COUNT_N = 100                   # count-window size (T5/T6)
SESSION_GAP = 3 * H             # session gap (T7)
WARMUP = 200                    # warm-up events per stream (W1a/W1b/W1)
REBASE_ANCHOR = 1_700_000_000_000
MARKER_OFFSET = 5 * H           # in-stream markers lag their arrival hour by 5 h
TIME_LAG, TIME_LAG_PERIOD = 100, 200   # reference defaults of the time-lag assigner
VALUE_SCALE = 2                 # `events.value` carries two decimals: sum it exactly


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _ev(spark, sf_dir, *cols, **kw):
    return event_stream(spark, sf_dir, *cols, **kw)


# --- W2 + T1: bounded watermark, tumbling panes ------------------------------

def _panes_oracle(allowed: int, K=("event_type",)) -> str:
    K = list(K)
    return (f"WITH {Q.bounded_panes_sql(['event_type'], K, H, H, H, allowed, pre=Q.ev_cte())}\n"
            f"SELECT * FROM panes")


@register("tumbling_panes", _panes_oracle(0))
def q_tumbling_panes(spark, sf_dir):
    """Flagship: per event type, hourly counts a 1 h bounded watermark on a
    1 h tick emits, with lag; late windows dropped (allowed lateness 0)."""
    from driftmark.plans.runs import bounded_panes
    return bounded_panes(_ev(spark, sf_dir, "event_type"), ["event_type"], ["event_type"],
                         H, H, H, 0)


#: T1 with L3 and L4 said per event, without ticks or groups: the watermark an
#: event met is that of all events of earlier arrival hours; a kept event is
#: on time or re-fires with its own number among the kept ones.
_PER_EVENT = f"""WITH {Q.ev_cte()},
j AS (
  SELECT event_type, arr, seq, t - t % {H} + {H} AS wend,
         greatest(coalesce((SELECT max(x.t) FROM ev x WHERE x.event_type = e.event_type AND x.arr // {H} < e.arr // {H}), 0) - {H}, 0) AS wm
  FROM ev e),
k AS (
  SELECT *, row_number() OVER (PARTITION BY event_type, wend ORDER BY arr, seq) AS nth
  FROM j WHERE wend - 1 + {3 * H} > wm),
o AS (SELECT event_type, wend, count(*) AS cnt FROM k WHERE wm < wend - 1 GROUP BY ALL),
f AS (SELECT o.*, (SELECT min(j.wm) FROM j WHERE j.event_type = o.event_type AND j.wm >= o.wend - 1) AS fire FROM o)
SELECT event_type, wend - {H} AS wstart, wend, cnt, fire - wend AS lag, fire IS NULL AS flushed, false AS late_fire FROM f
UNION ALL
SELECT event_type, wend - {H}, wend, nth, wm - wend, false, true FROM k WHERE wm >= wend - 1"""


@register("tumbling_panes_allowed", _PER_EVENT)
def q_tumbling_panes_allowed(spark, sf_dir):
    from driftmark.plans.runs import bounded_panes
    return bounded_panes(_ev(spark, sf_dir, "event_type"), ["event_type"], ["event_type"],
                         H, H, H, 3 * H)


@register("tumbling_panes_users", _panes_oracle(3 * H, ("event_type", "user_id")))
def q_tumbling_panes_users(spark, sf_dir):
    """Watermark per event type, windows per (event type, user)."""
    from driftmark.plans.runs import bounded_panes
    return bounded_panes(_ev(spark, sf_dir, "event_type", "user_id"), ["event_type"],
                         ["event_type", "user_id"], H, H, H, 3 * H)


@register("bounded_watermark", f"""WITH {Q.ev_cte()},
{Q.bounded_ctes('ev', ['event_type'], ['event_type'], H, H, H)}
SELECT e.seq, e.event_type, e.t, e.arr, e.arr // {H} AS tick,
       k.wm_begin AS wm_before, k.wm_end AS wm_after, e.t < k.wm_begin AS late
FROM ev e JOIN b_ticks k ON e.event_type = k.event_type AND e.arr // {H} = k.tick""")
def q_bounded_watermark(spark, sf_dir):
    from driftmark.operators.watermarks import bounded_watermark
    return bounded_watermark(_ev(spark, sf_dir, "event_type"), ["event_type"], H, H)


@register("bounded_watermark_changes", f"""WITH {Q.ev_cte()},
{Q.bounded_ctes('ev', ['event_type'], ['event_type'], H, H, H)},
kt AS (SELECT event_type, tick, wm_begin, wm_end,
              lag(tick) OVER (PARTITION BY event_type ORDER BY tick) AS prev_tick,
              lag(wm_end > wm_begin) OVER (PARTITION BY event_type ORDER BY tick) AS prev_raised
       FROM b_ticks),
e2 AS (SELECT *, arr // {H} AS tick,
              row_number() OVER (PARTITION BY event_type, arr // {H} ORDER BY arr, seq) AS rn
       FROM ev)
SELECT e.seq, e.event_type, e.t, e.arr, e.tick, k.wm_begin AS wm_before, k.wm_end AS wm_after,
       e.t < k.wm_begin AS late,
       (e.rn = 1 AND coalesce(k.prev_tick = e.tick - 1 AND k.prev_raised, false)) AS wm_changed
FROM e2 e JOIN kt k ON e.event_type = k.event_type AND e.tick = k.tick""")
def q_bounded_watermark_changes(spark, sf_dir):
    from driftmark.operators.watermarks import bounded_watermark
    return bounded_watermark(_ev(spark, sf_dir, "event_type"), ["event_type"], H, H,
                             emit="next_event")


@register("watermark_steps", f"""WITH {Q.ev_cte()},
{Q.bounded_ctes('ev', ['event_type'], ['event_type'], H, H, H)}
SELECT event_type, wm, (tick + 1) * {H} AS at,
       row_number() OVER (PARTITION BY event_type ORDER BY wm) AS ordinal
FROM b_steps""")
def q_watermark_steps(spark, sf_dir):
    from driftmark.operators.watermarks import bounded_steps, bounded_ticks, watermark_steps
    ticks = bounded_ticks(_ev(spark, sf_dir, "event_type"), ["event_type"], H, H)
    return watermark_steps(bounded_steps(ticks, ["event_type"], H), ["event_type"])


@register("late_stats", f"""WITH {Q.ev_cte()},
{Q.bounded_ctes('ev', ['event_type'], ['event_type'], H, H, H)},
w AS (SELECT event_type, count(*) AS watermarks FROM b_steps GROUP BY 1),
l AS (SELECT e.event_type, count(*) AS total, count(*) FILTER (WHERE e.t < k.wm_begin) AS late
      FROM ev e JOIN b_ticks k ON e.event_type = k.event_type AND e.arr // {H} = k.tick
      GROUP BY 1)
SELECT l.event_type, l.total, l.late, round(l.late / l.total, 9) AS late_ratio,
       coalesce(w.watermarks, 0) AS watermarks
FROM l LEFT JOIN w USING (event_type)""")
def q_late_stats(spark, sf_dir):
    from driftmark.operators.lateness import late_stats
    from driftmark.operators.watermarks import bounded_steps, bounded_ticks, bounded_watermark
    from driftmark.session import materialize
    ev = _ev(spark, sf_dir, "event_type")
    ticks = materialize(bounded_ticks(ev, ["event_type"], H, H))
    wm = bounded_watermark(ev, ["event_type"], H, H, ticks=ticks)
    return late_stats(wm, ["event_type"], bounded_steps(ticks, ["event_type"], H))


@register("kept_rows", f"""WITH {Q.ev_cte()},
{Q.bounded_ctes('ev', ['event_type'], ['event_type'], H, H, H)}
SELECT e.seq, e.event_type, e.t, k.wm_begin AS wm_before, e.t < k.wm_begin AS late
FROM ev e JOIN b_ticks k ON e.event_type = k.event_type AND e.arr // {H} = k.tick
WHERE e.t - e.t % {H} + {H} - 1 + {3 * H} > k.wm_begin""")
def q_kept_rows(spark, sf_dir):
    """L1 + L3 per row: events of windows still open 3 h after their end,
    flagged if behind the watermark, keyed by event type (S6)."""
    from driftmark.operators.lateness import drop_late, flag_late
    from driftmark.operators.watermarks import bounded_watermark
    from driftmark.sources.timeline import key_by
    wm = bounded_watermark(key_by(_ev(spark, sf_dir, "event_type"), ["event_type"]), ["event_type"], H, H).drop("late")
    return flag_late(drop_late(wm, H, 3 * H)).select("seq", "event_type", "t", "wm_before", "late")


def _allowed_runs(spark, sf_dir):
    """Panes of ``tumbling_panes_allowed`` as runs: analysis never expands them."""
    from driftmark.plans.runs import bounded_panes
    return bounded_panes(_ev(spark, sf_dir, "event_type"), ["event_type"], ["event_type"], H, H, H, 3 * H, runs=True)


@register("collapse_panes", f"""WITH {Q.bounded_panes_sql(['event_type'], ['event_type'], H, H, H, 3 * H, pre=Q.ev_cte())}
{Q.collapse_sql(['event_type'])}""")
def q_collapse_panes(spark, sf_dir):
    from driftmark.plans.analysis import collapse_panes
    return collapse_panes(_allowed_runs(spark, sf_dir), ["event_type"])


@register("counted_elements", f"""WITH {Q.bounded_panes_sql(['event_type'], ['event_type'], H, H, H, 3 * H, pre=Q.ev_cte())}
SELECT CAST(sum(cnt) AS BIGINT) AS counted FROM panes""")
def q_counted_elements(spark, sf_dir):
    from driftmark.operators.windows import counted_elements
    return counted_elements(_allowed_runs(spark, sf_dir))


# --- W4: time-lag watermark -------------------------------------------------

@register("time_lag_watermark", f"""WITH {Q.ev_cte()}
SELECT seq, event_type, t, arr, arr // {TIME_LAG_PERIOD} AS tick,
       (arr // {TIME_LAG_PERIOD}) * {TIME_LAG_PERIOD} - {TIME_LAG} AS wm_before,
       (arr // {TIME_LAG_PERIOD}) * {TIME_LAG_PERIOD} - {TIME_LAG} AS wm_after,
       t < (arr // {TIME_LAG_PERIOD}) * {TIME_LAG_PERIOD} - {TIME_LAG} AS late
FROM ev""")
def q_time_lag_watermark(spark, sf_dir):
    from driftmark.operators.watermarks import time_lag_watermark
    return time_lag_watermark(_ev(spark, sf_dir, "event_type"), TIME_LAG, TIME_LAG_PERIOD)


_TL_FIRE = (f"(SELECT CASE WHEN (o.wend - 1 + {TIME_LAG} + {TIME_LAG_PERIOD} - 1) // {TIME_LAG_PERIOD}"
            f" <= l.last_tick THEN ((o.wend - 1 + {TIME_LAG} + {TIME_LAG_PERIOD} - 1) // {TIME_LAG_PERIOD})"
            f" * {TIME_LAG_PERIOD} - {TIME_LAG} END FROM tl_last l WHERE l.event_type = o.event_type)")


@register("time_lag_panes", f"""WITH {Q.ev_cte()},
tl_groups AS (
  SELECT event_type, t - t % {H} AS wstart,
         (arr // {TIME_LAG_PERIOD}) * {TIME_LAG_PERIOD} - {TIME_LAG} AS wm_before, count(*) AS n
  FROM ev GROUP BY ALL),
tl_last AS (SELECT event_type, max(arr) // {TIME_LAG_PERIOD} AS last_tick FROM ev GROUP BY 1),
{Q.panes_ctes('tl_groups', ['event_type'], ['event_type'], H, 3 * H, _TL_FIRE)}
SELECT * FROM panes""")
def q_time_lag_panes(spark, sf_dir):
    from driftmark.plans.runs import time_lag_panes
    return time_lag_panes(_ev(spark, sf_dir, "event_type"), ["event_type"], ["event_type"],
                          TIME_LAG, TIME_LAG_PERIOD, H, 3 * H)


# --- T2-T8 ---------------------------------------------------------------------

@register("tumbling_count_all", f"""WITH {Q.ev_cte()}
SELECT t - t % {H} AS wstart, count(*) AS cnt, t - t % {H} + {H} AS wend,
       {FIXED_WM} - (t - t % {H} + {H}) AS lag
FROM ev GROUP BY ALL""")
def q_tumbling_count_all(spark, sf_dir):
    from driftmark.operators.windows import tumbling_count_all
    return tumbling_count_all(_ev(spark, sf_dir), H, FIXED_WM)


@register("tumbling_avg", f"""WITH {Q.ev_cte()}
SELECT t - t % {H} AS wstart,
       CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS avg_value, count(*) AS cnt,
       t - t % {H} + {H} AS wend
FROM ev GROUP BY ALL""")
def q_tumbling_avg(spark, sf_dir):
    from driftmark.operators.windows import tumbling_avg_all
    return tumbling_avg_all(_ev(spark, sf_dir, "value"), H, scale=VALUE_SCALE)


def _gmt_ss_sql(ms: str) -> str:
    return (f"strftime(make_timestamp(CAST(({ms}) AS BIGINT) * 1000), '%Y-%m-%d %H:%M:%S')"
            f" || '.' || printf('%02d', CAST(({ms}) % 1000 AS INTEGER))")


@register("tumbling_labels", f"""WITH {Q.ev_cte()},
w AS (SELECT t - t % {LABEL_WIDTH} AS wstart, count(*) AS cnt FROM ev GROUP BY ALL)
SELECT {_gmt_ss_sql('wstart')} AS start_text, {_gmt_ss_sql(f'wstart + {LABEL_WIDTH}')} AS end_text, cnt
FROM w""")
def q_tumbling_labels(spark, sf_dir):
    from driftmark.operators.windows import tumbling_count_labels
    return tumbling_count_labels(_ev(spark, sf_dir), LABEL_WIDTH)


@register("local_labels", f"""WITH {Q.ev_cte()}
SELECT seq, strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S.') || printf('%03d', CAST(t % 1000 AS INTEGER)) AS label
FROM ev""")
def q_local_labels(spark, sf_dir):
    """Event times as text with three digits of milliseconds."""
    from driftmark.functions.time import local_text_sss
    return _ev(spark, sf_dir).select("seq", local_text_sss("t").alias("label"))


_RN = "row_number() OVER (PARTITION BY event_type ORDER BY arr, seq)"


@register("count_windows", f"""WITH {Q.ev_cte()},
r AS (SELECT event_type, ({_RN} - 1) // {COUNT_N} AS win FROM ev)
SELECT event_type, win, count(*) AS cnt FROM r GROUP BY ALL HAVING count(*) = {COUNT_N}""")
def q_count_windows(spark, sf_dir):
    from driftmark.operators.windows import count_windows
    return count_windows(_ev(spark, sf_dir, "event_type"), ["event_type"], COUNT_N)


@register("count_window_bounds", f"""WITH {Q.ev_cte()},
r AS (SELECT event_type, t, ({_RN} - 1) // {COUNT_N} AS win FROM ev),
g AS (SELECT event_type, win, count(*) AS cnt, min(t) AS tmin, max(t) AS tmax
      FROM r GROUP BY ALL HAVING count(*) = {COUNT_N})
SELECT event_type, win, cnt, {_gmt_ss_sql('tmin')} AS min_text, {_gmt_ss_sql('tmax')} AS max_text FROM g""")
def q_count_window_bounds(spark, sf_dir):
    from driftmark.operators.windows import count_windows
    return count_windows(_ev(spark, sf_dir, "event_type"), ["event_type"], COUNT_N, bounds=True)


@register("count_windows_cumulative", f"""WITH {Q.ev_cte()},
r AS (SELECT event_type, t, ({_RN} - 1) // {COUNT_N} AS win FROM ev),
g AS (SELECT event_type, win, count(*) AS cnt, min(t) AS tmin, max(t) AS tmax
      FROM r GROUP BY ALL HAVING count(*) = {COUNT_N}),
c AS (SELECT event_type, win,
        sum(cnt) OVER (PARTITION BY event_type ORDER BY win) AS cnt,
        min(tmin) OVER (PARTITION BY event_type ORDER BY win) AS tmin,
        max(tmax) OVER (PARTITION BY event_type ORDER BY win) AS tmax FROM g)
SELECT event_type, win, CAST(cnt AS BIGINT) AS cnt, {_gmt_ss_sql('tmin')} AS min_text,
       {_gmt_ss_sql('tmax')} AS max_text FROM c""")
def q_count_windows_cumulative(spark, sf_dir):
    from driftmark.operators.windows import count_windows
    return count_windows(_ev(spark, sf_dir, "event_type"), ["event_type"], COUNT_N,
                         purge=False, bounds=True)


@register("session_windows", f"""WITH {Q.ev_cte()},
s AS (SELECT user_id, t,
        CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {SESSION_GAP}
             THEN 0 ELSE 1 END AS brk FROM ev),
g AS (SELECT user_id, t, sum(brk) OVER (PARTITION BY user_id ORDER BY t
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM s)
SELECT user_id, min(t) AS sstart, max(t) + {SESSION_GAP} AS send, count(*) AS cnt
FROM g GROUP BY user_id, sid""")
def q_session_windows(spark, sf_dir):
    from driftmark.operators.windows import session_windows
    return session_windows(_ev(spark, sf_dir, "user_id"), ["user_id"], SESSION_GAP)


@register("running_average", f"""WITH {Q.ev_cte()}
SELECT seq, event_type,
       CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER w AS DOUBLE) / count(value) OVER w AS running_avg
FROM ev
WINDOW w AS (PARTITION BY event_type ORDER BY arr, seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_average(spark, sf_dir):
    from driftmark.operators.windows import running_average
    x = running_average(_ev(spark, sf_dir, "event_type", "value"), ["event_type"], "value",
                        scale=VALUE_SCALE)
    return x.select("seq", "event_type", "running_avg")


@register("running_average_nulls", f"""WITH {Q.ev_cte()}
SELECT seq, event_type,
       CAST(sum(CAST(CASE WHEN seq % 3 <> 0 THEN value END AS DECIMAL(18, 2))) OVER w AS DOUBLE)
         / nullif(count(CASE WHEN seq % 3 <> 0 THEN value END) OVER w, 0) AS running_avg
FROM ev
WINDOW w AS (PARTITION BY event_type ORDER BY arr, seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_average_nulls(spark, sf_dir):
    """T8 where every third reading is missing."""
    from driftmark.operators.windows import running_average
    ev = _ev(spark, sf_dir, "event_type", "value")
    ev = ev.withColumn("value", F.when(F.col("seq") % 3 != 0, F.col("value")))
    return running_average(ev, ["event_type"], "value", scale=VALUE_SCALE).select("seq", "event_type", "running_avg")


# --- S4/S5, W1a/W1b -------------------------------------------------------------

@register("rebase_time", f"""WITH {Q.ev_cte()},
f AS (SELECT event_type, arg_min(t, (arr, seq)) AS first_t FROM ev WHERE t <> 0 GROUP BY 1)
SELECT e.seq, e.event_type, {REBASE_ANCHOR} + (e.t - f.first_t) AS t, e.t AS t_orig
FROM ev e JOIN f USING (event_type)""")
def q_rebase_time(spark, sf_dir):
    from driftmark.sources.timeline import rebase_time
    x = rebase_time(_ev(spark, sf_dir, "event_type"), REBASE_ANCHOR, ["event_type"])
    return x.select("seq", "event_type", "t", "t_orig")


@register("reference_time", f"""WITH {Q.ev_cte()}
SELECT seq, event_type, t, lag(t) OVER (PARTITION BY event_type ORDER BY arr, seq) AS ref
FROM ev""")
def q_reference_time(spark, sf_dir):
    from driftmark.sources.timeline import reference_time
    x = reference_time(_ev(spark, sf_dir, "event_type"), "previous_event", ["event_type"])
    return x.select("seq", "event_type", "t", "ref")


_WARM = f"""w AS (SELECT event_type, greatest(0, max(abs(arr - t))) AS allowed
      FROM (SELECT *, {_RN} AS rn FROM ev) WHERE rn <= {WARMUP} GROUP BY 1)"""


@register("warmup_skew", f"""WITH {Q.ev_cte()}, {_WARM}
SELECT event_type, allowed FROM w""")
def q_warmup_skew(spark, sf_dir):
    from driftmark.operators.adaptive import warmup_skew
    return warmup_skew(_ev(spark, sf_dir, "event_type"), ["event_type"], WARMUP)


@register("deviation_ratio", f"""WITH {Q.ev_cte()}, {_WARM},
r AS (SELECT *, {_RN} AS rn FROM ev)
SELECT r.seq, r.event_type, abs(r.arr - r.t) AS deviation,
       round(abs(r.arr - r.t) / nullif(w.allowed, 0), 9) AS ratio
FROM r JOIN w USING (event_type) WHERE r.rn > {WARMUP}""")
def q_deviation_ratio(spark, sf_dir):
    from driftmark.operators.adaptive import deviation_ratio
    x = deviation_ratio(_ev(spark, sf_dir, "event_type"), ["event_type"], WARMUP)
    return x.select("seq", "event_type", "deviation", F.round("ratio", 9).alias("ratio"))


# --- P1-P3, A1-A4: sweep and analysis -------------------------------------------

def _periodic_grid():
    from driftmark.plans.sweep import periodic_grid
    return periodic_grid("events")


def _run_ids(spark, configs):
    """All run ids, so that a run without panes is reported too."""
    return spark.range(len(configs)).select(F.col("id").cast("int").alias("cfg"))


def _sweep_sql(S_extra: list[str], select: str) -> str:
    from driftmark.plans.sweep import PERIODIC_KEYS
    S = [*PERIODIC_KEYS, *S_extra]
    pre = (f"{Q.ev_cte()},\n{Q.values_cte('cfg', _periodic_grid())},\n"
           f"x AS (SELECT ev.*, cfg.* FROM ev CROSS JOIN cfg)")
    body = Q.bounded_panes_sql(S, S, "max_ooo", "period", "width", "allowed", src="x", pre=pre)
    return f"WITH {body}\n{select}"


_SWEEP_COLS = "run, event_type, wstart, wend, cnt, lag, flushed, late_fire"


@register("sweep_periodic", _sweep_sql(["event_type"], f"SELECT {_SWEEP_COLS} FROM panes"))
def q_sweep_periodic(spark, sf_dir):
    """The reference's 8 periodic runs, one job, keyed by run."""
    from driftmark.plans.sweep import sweep_periodic
    panes = sweep_periodic(_ev(spark, sf_dir, "event_type"), _periodic_grid(),
                           ["event_type"], ["event_type"])
    return panes.select(*_SWEEP_COLS.split(", "))


_REPORT_SQL = """SELECT 'events' AS dataset, 'Periodic' AS approach, max_ooo AS lateness,
       CAST(NULL AS DOUBLE) AS sensitivity, CAST(NULL AS DOUBLE) AS change_rate,
       CAST(NULL AS DOUBLE) AS threshold, period, width, windows, elements, mean_lag, not_processed
FROM summary"""


@register("run_report", _sweep_sql(["event_type"], "").rstrip() + ",\n" + Q.analyze_sql(["run", "period", "max_ooo", "width", "allowed"],
                                                   ["event_type"]) + "\n" + _REPORT_SQL)
def q_run_report(spark, sf_dir):
    """A1-A3 over the periodic sweep (keyed streams), 12-column report."""
    from driftmark.plans.analysis import analyze_runs, report
    from driftmark.plans.sweep import PERIODIC_KEYS, sweep_periodic_panes, with_config
    grid = _periodic_grid()
    panes = sweep_periodic_panes(_ev(spark, sf_dir, "event_type"), grid,
                                 ["event_type"], ["event_type"], runs=True)
    summary = with_config(analyze_runs(panes, ["cfg"], ["event_type"], _run_ids(spark, grid)), grid, PERIODIC_KEYS)
    return report(summary.select(
        F.lit("events").alias("dataset"), F.lit("Periodic").alias("approach"),
        F.col("max_ooo").alias("lateness"), "period", "width", "windows", "elements",
        "mean_lag", "not_processed"))


@register("compare_runs", _sweep_sql([], "").rstrip() + ",\n"
          + Q.analyze_sql(["run", "period", "max_ooo", "width", "allowed"], []) + "\n" + _REPORT_SQL)
def q_compare_runs(spark, sf_dir):
    """A4 with K1/K2/P3: the periodic sweep over the whole event stream
    (one stream, as the reference runs it) is written as pane text files
    named by run, then every file is parsed back and reported in one job."""
    from driftmark.plans.analysis import compare_runs
    from driftmark.plans.sweep import sweep_periodic_panes, with_config
    from driftmark.session import scratch_dir
    from driftmark.sources.text import write_panes
    grid = _periodic_grid()
    panes = with_config(sweep_periodic_panes(_ev(spark, sf_dir), grid, [], []), grid, ["run"])
    out = scratch_dir(spark, "runs")
    write_panes(panes, out, "text", partition_col="run", compression="gzip")
    return compare_runs(spark, out)


# --- S1-S3, S2+W5, K1+K2: text formats rendered from `events` ------------------

@register("parse_lines", f"""WITH {Q.ev_cte()}
SELECT row_number() OVER (ORDER BY seq) AS line, t AS ts,
       CASE WHEN event_type = 'error' THEN 20.0 ELSE value END AS value, false AS bad
FROM ev""")
def q_parse_lines(spark, sf_dir):
    """S1 + S3: ``ts[,value]`` lines rendered in event order (``error``
    events without a value), parsed back; missing values filled with 20.0."""
    from driftmark.session import scratch_dir
    from driftmark.sources.text import read_timed_values
    ev = _ev(spark, sf_dir, "event_type", "value")
    line = F.when(F.col("event_type") == "error", F.col("t").cast("string")).otherwise(
        F.concat_ws(",", F.col("t").cast("string"), F.col("value").cast("string")))
    path = scratch_dir(spark, "timed")
    ev.orderBy("seq").select(line.alias("value")).write.text(path)
    return read_timed_values(spark, path)


@register("marker_watermark", f"""WITH {Q.ev_cte()}
SELECT event_type AS key, t, value,
       greatest((arr // {H}) * {H} - {MARKER_OFFSET}, 0) AS wm_before,
       t < greatest((arr // {H}) * {H} - {MARKER_OFFSET}, 0) AS late
FROM ev""")
def q_marker_watermark(spark, sf_dir):
    """S2 + W5: events rendered as ``ts,key,value`` lines in arrival order,
    a ``W`` marker line opening every arrival hour (watermark = hour start
    minus 5 h) and a comment header; parsed back and judged against the
    markers in line order."""
    from driftmark.functions.time import floor_div
    from driftmark.operators.watermarks import marker_watermark
    from driftmark.session import scratch_dir
    from driftmark.sources.text import marked_stream, read_marked_events
    ev = _ev(spark, sf_dir, "event_type", "value")
    hour = floor_div(F.col("arr"), F.lit(H))
    evl = ev.select(F.col("arr"), F.lit(1).alias("kind"), F.col("seq"),
                    F.concat_ws(",", F.col("t").cast("string"), "event_type",
                                F.col("value").cast("string")).alias("line"))
    mk = (ev.select((hour * H).alias("arr")).distinct()
            .select("arr", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"),
                    F.concat_ws(",", (F.col("arr") - MARKER_OFFSET).cast("string"),
                                F.lit("W"), F.lit("0")).alias("line")))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("arr"), F.lit(-1).alias("kind"),
                                 F.lit(0).cast("long").alias("seq"),
                                 F.lit("* rendered from events").alias("line"))
    path = scratch_dir(spark, "marked")
    (evl.unionByName(mk).unionByName(head).orderBy("arr", "kind", "seq")
        .select(F.col("line").alias("value")).write.text(path))
    events, markers, _ = marked_stream(read_marked_events(spark, path))
    out = marker_watermark(events, markers)
    return out.select("key", "t", "value", "wm_before", "late")


@register("marked_rejects", f"""WITH {Q.ev_cte()}
SELECT CASE WHEN seq % 40 = 7 THEN NULL ELSE t END AS ts, event_type AS key, seq % 40 = 7 AS bad_ts
FROM ev WHERE seq % 20 = 7 OR value IS NULL""")
def q_marked_rejects(spark, sf_dir):
    """Lines whose time or reading does not parse are returned as
    rejects, not filled in."""
    from driftmark.session import scratch_dir
    from driftmark.sources.text import marked_stream, read_marked_events
    ev = _ev(spark, sf_dir, "event_type", "value")
    broken = F.col("seq") % 20 == 7
    path = scratch_dir(spark, "rejects")
    (ev.select(F.concat_ws(",", F.when(broken & (F.col("seq") % 40 == 7), "soon").otherwise(F.col("t").cast("string")),
                           "event_type", F.when(broken, "warm").otherwise(F.coalesce(F.col("value").cast("string"), F.lit("")))).alias("value"))
       .write.text(path))
    _, _, rejects = marked_stream(read_marked_events(spark, path))
    return rejects.select("ts", "key", F.col("ts").isNull().alias("bad_ts"))


@register("pane_text_roundtrip", f"""WITH {Q.bounded_panes_sql(['event_type'], ['event_type'], H, H, H, 3 * H, pre=Q.ev_cte())}
SELECT wstart, wend, cnt, coalesce(lag, {Q.LONG_MAX} - wend) AS lag, flushed FROM panes""")
def q_pane_text_roundtrip(spark, sf_dir):
    """K1 + K2: panes written as ``(TimeWindow{start=s, end=e},cnt,lag)``
    lines and parsed back (flushed panes carry Long.MAX - end)."""
    from driftmark.session import scratch_dir
    from driftmark.sources.text import read_panes_text, write_panes
    path = scratch_dir(spark, "panes")
    write_panes(q_tumbling_panes_allowed(spark, sf_dir), path, "text")
    return read_panes_text(spark, path).select("wstart", "wend", "cnt", "lag", "flushed")


# --- W1, D1: adaptive watermark and drift detection (rows-only) ------------------

def _adaptive_params(**kw):
    from driftmark.operators.adaptive import adaptive_preset
    from driftmark.operators.drift import AdaptiveParams
    base = adaptive_preset("four")
    base.update(kw)
    return AdaptiveParams(warmup=WARMUP, **base)


def _w1_sql(select: str, adapt: bool = False, **kw) -> str:
    return (f"WITH RECURSIVE {AQ.drifting_ev()},\n"
            f"{AQ.watermark_sql('ev', [AQ.PLAIN | kw], WARMUP, adapt)}\n{select}")


@register("adaptive_watermark", _w1_sql("SELECT * EXCLUDE (run) FROM w1"))
def q_adaptive_watermark(spark, sf_dir):
    """Drift-driven watermark per event type over the drifting-delay
    replay of ``events`` (the sweep's constructor form, warm-up 200)."""
    from driftmark.operators.adaptive import adaptive_watermark
    return adaptive_watermark(_ev(spark, sf_dir, "event_type", drifting=True), ["event_type"],
                              _adaptive_params())


@register("adaptive_steps", _w1_sql("""SELECT event_type, wm_after AS wm, arr AS at,
       row_number() OVER (PARTITION BY event_type ORDER BY wm_after) AS ordinal
FROM w1 WHERE wm_after > wm_before"""))
def q_adaptive_steps(spark, sf_dir):
    """W6 of W1: the watermarks that the drift-driven assigner emits."""
    from driftmark.operators.adaptive import adaptive_watermark
    from driftmark.operators.watermarks import steps_from_events, watermark_steps
    folded = adaptive_watermark(_ev(spark, sf_dir, "event_type", drifting=True), ["event_type"], _adaptive_params())
    return watermark_steps(steps_from_events(folded, ["event_type"]), ["event_type"])


@register("adaptive_panes", f"WITH RECURSIVE {AQ.adaptive_panes_sql(H, 0, WARMUP)}\nSELECT * FROM panes")
def q_adaptive_panes(spark, sf_dir):
    """W1 -> T1: hourly panes per event type under the adaptive watermark."""
    from driftmark.operators.adaptive import adaptive_panes
    return adaptive_panes(_ev(spark, sf_dir, "event_type", drifting=True), ["event_type"],
                          ["event_type"], H, 0, _adaptive_params())


@register("chunk_report", _w1_sql("""SELECT event_type, seq, arr, chunk_span, chunk_elements, chunk_late_ratio,
       cur_sensitivity, accepted, proposed_wm, wm_raw, wm_after
FROM w1 WHERE detected""", change_rate=0.1, threshold=0.1))
def q_chunk_report(spark, sf_dir):
    """One row per detection, with sensitivity feedback on (W1d)."""
    from driftmark.operators.adaptive import adaptive_watermark, chunk_report
    folded = adaptive_watermark(_ev(spark, sf_dir, "event_type", drifting=True), ["event_type"],
                                _adaptive_params(change_rate=0.1, threshold=0.1))
    return chunk_report(folded, ["event_type"])


@register("adaptive_lateness", _w1_sql("SELECT * EXCLUDE (run) FROM w1", adapt=True))
def q_adaptive_lateness(spark, sf_dir):
    """W1e: lateness re-estimated on every accepted watermark."""
    from dataclasses import replace
    from driftmark.operators.adaptive import adaptive_watermark
    p = replace(_adaptive_params(), adapt_lateness=True)
    return adaptive_watermark(_ev(spark, sf_dir, "event_type", drifting=True), ["event_type"], p)


def _detect_sql(x: str) -> str:
    return (f"WITH RECURSIVE {AQ.drifting_ev()},\n"
            f"src AS (SELECT event_type AS stream, seq, arr, {x} AS x FROM ev),\n{AQ.detect_sql('src')}\n{AQ.DETECT_SELECT}")


def _rounded(df):
    """Means and sums to six digits; the tiny offset keeps exact halves from
    being rounded by the last bit of a sum's order."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean", "variance", "total")})


@register("adwin_detect_delay", _detect_sql("CAST(arr - t AS DOUBLE) / 3600000"))
def q_adwin_detect_delay(spark, sf_dir):
    """D1-D3 over the arrival delay in hours, whose distribution changes
    every 500 events."""
    from driftmark.operators.adaptive import adwin_detect
    ev = _ev(spark, sf_dir, "event_type", drifting=True)
    ev = ev.withColumn("delay", (F.col("arr") - F.col("t")).cast("double") / 3_600_000)
    return _rounded(adwin_detect(ev, ["event_type"], "delay"))


@register("adwin_detect", _detect_sql("value").replace(AQ.drifting_ev(), Q.ev_cte()))
def q_adwin_detect(spark, sf_dir):
    """ADWIN over ``value`` per event type in arrival order."""
    from driftmark.operators.adaptive import adwin_detect
    return _rounded(adwin_detect(_ev(spark, sf_dir, "event_type", "value"), ["event_type"], "value"))


def _sweep_adaptive_sql() -> str:
    grid = [(s, c, h, w) for s in (1.0,) for c in (1.0, 0.1, 0.01) for h in (1.1, 0.1, 0.01) for w in (100, 1000)]
    runs = [dict(sensitivity=s, change_rate=c, threshold=h) for s, c, h, w in grid if w == 100]
    values = ", ".join(f"({runs.index(dict(sensitivity=s, change_rate=c, threshold=h))}, CAST({s} AS DOUBLE), CAST({c} AS DOUBLE), "
                       f"CAST({h} AS DOUBLE), CAST({w} AS BIGINT))" for s, c, h, w in grid)
    fire = """(SELECT min(s.wm_after) FROM w1 s WHERE s.run = o.run AND s.event_type = o.event_type
       AND s.wm_after > s.wm_before AND s.wm_after >= o.wend - 1)"""
    body = Q.panes_ctes("a_groups", ["run", "event_type", "width"], ["run", "event_type", "width"], "width", 0, fire)
    return f"""WITH RECURSIVE {AQ.drifting_ev()},
{AQ.watermark_sql('ev', runs, WARMUP)},
grid(run, sensitivity, change_rate, threshold, width) AS (VALUES {values}),
a_groups AS (SELECT w1.run, event_type, width, t - t % width AS wstart, wm_before, count(*) AS n
             FROM w1 JOIN grid ON grid.run = w1.run GROUP BY ALL),
{body},
{Q.analyze_sql(['run', 'width'], ['event_type'])}
SELECT 'events' AS dataset, 'Adaptive' AS approach, CAST(1000 AS BIGINT) AS lateness, sensitivity, change_rate, threshold,
       CAST(NULL AS BIGINT) AS period, width, coalesce(windows, 0) AS windows, coalesce(elements, 0) AS elements, mean_lag,
       coalesce(not_processed, 0) AS not_processed
FROM grid LEFT JOIN summary USING (run, width)"""


@register("sweep_adaptive", _sweep_adaptive_sql())
def q_sweep_adaptive(spark, sf_dir):
    """P1, adaptive half: the reference's 18 runs in one job -> report.
    Runs that differ only in width share one fold (9 folds per stream)."""
    from driftmark.plans.analysis import analyze_runs, report
    from driftmark.plans.sweep import ADAPTIVE_KEYS, sweep_adaptive_panes, with_config
    panes, table = sweep_adaptive_panes(_ev(spark, sf_dir, "event_type", drifting=True),
                                        "events", ["event_type"], ["event_type"], warmup=WARMUP, as_runs=True)
    summary = with_config(analyze_runs(panes, ["cfg"], ["event_type"], _run_ids(spark, table)), table, ADAPTIVE_KEYS)
    return report(summary.select(
        F.lit("events").alias("dataset"), F.lit("Adaptive").alias("approach"),
        F.lit(1000).cast("long").alias("lateness"), "sensitivity", "change_rate", "threshold",
        F.lit(None).cast("long").alias("period"), "width", "windows", "elements",
        "mean_lag", "not_processed"))


@register("pending_runs", _sweep_sql([], """SELECT run, run LIKE '%P-10W-%' AS pending,
       CASE WHEN run NOT LIKE '%P-10W-%' THEN n END AS panes
FROM cfg LEFT JOIN (SELECT run, count(*) AS n FROM panes GROUP BY run) USING (run)"""))
def q_pending_runs(spark, sf_dir):
    """The runs of the periodic grid after those with a period of 200 ms
    are finished: which are still to do, and how many panes the others have
    by the manifest."""
    from driftmark.plans.sweep import finish_runs, finished_runs, pending_configs, sweep_periodic_panes, with_config
    from driftmark.session import scratch_dir
    grid = _periodic_grid()
    first = [c for c in grid if c["period"] == 200]
    path = scratch_dir(spark, "runs")
    panes = with_config(sweep_periodic_panes(_ev(spark, sf_dir), first, [], []), first, ["run"])
    finish_runs(panes, first, path)
    todo = {c["run"] for c in pending_configs(spark, grid, path)}
    runs = spark.createDataFrame([(c["run"], c["run"] in todo) for c in grid], "run string, pending boolean")
    return runs.join(finished_runs(spark, path), "run", "left")


# --- A4 over both halves of the sweep, wide and NULL keys, presets ----------------

def _all_runs_sql() -> str:
    from driftmark.plans.sweep import PERIODIC_KEYS
    S = [*PERIODIC_KEYS, "event_type"]
    pre = f"{AQ.drifting_ev()},\n{Q.values_cte('cfg', _periodic_grid())},\nx AS (SELECT ev.*, cfg.* FROM ev CROSS JOIN cfg)"
    periodic = (f"WITH {Q.bounded_panes_sql(S, S, 'max_ooo', 'period', 'width', 'allowed', src='x', pre=pre)},\n"
                f"{Q.analyze_sql(['event_type', 'run', 'period', 'max_ooo', 'width'], [])}\n"
                + _REPORT_SQL.replace("'events' AS dataset", "event_type AS dataset"))
    adaptive = (_sweep_adaptive_sql().replace("GROUP BY ALL),\nsummary", "GROUP BY ALL),\nsummary")
                .replace(Q.analyze_sql(["run", "width"], ["event_type"]), Q.analyze_sql(["run", "width", "event_type"], []))
                .replace("SELECT 'events' AS dataset", "SELECT event_type AS dataset")
                .replace("FROM grid LEFT JOIN summary USING (run, width)", "FROM grid JOIN summary USING (run, width)"))
    return f"SELECT * FROM ({periodic})\nUNION ALL\nSELECT * FROM ({adaptive})"


@register("compare_all_runs", _all_runs_sql())
def q_compare_all_runs(spark, sf_dir):
    """A4 over all 26 runs of each event type: both halves of the sweep over
    the drifting replay go through pane text named by run (K1, P3) and every
    file is parsed back (K2) and reported in one job."""
    from driftmark.plans.analysis import compare_runs
    from driftmark.plans.sweep import adaptive_grid, sweep_adaptive_panes, sweep_periodic_panes, with_config
    from driftmark.session import scratch_dir
    from driftmark.sources.text import write_panes
    ev, key = _ev(spark, sf_dir, "event_type", drifting=True), ["event_type"]
    periodic = with_config(sweep_periodic_panes(ev, _periodic_grid(), key, key), _periodic_grid(), ["run"])
    panes, table = sweep_adaptive_panes(ev, "events", key, key, warmup=WARMUP, configs=adaptive_grid("events"))
    both = periodic.drop("cfg").unionByName(with_config(panes, table, ["run"]).drop("cfg"))
    # a data set of its own for each stream: its name leads the run's
    named = both.withColumn("run", F.concat("event_type", F.substring("run", len("events") + 1, 1000)))
    out = scratch_dir(spark, "all-runs")
    write_panes(named, out, "text", partition_col="run", compression="gzip")
    return compare_runs(spark, out)


def _wide_keys(ev):
    """A whole-number key beyond 2^53 that is NULL for a fifth of the events."""
    return ev.withColumn("k", F.when(F.col("seq") % 5 > 0, F.lit(2 ** 60) + F.col("seq") % 3))


_WIDE_SQL = "CASE WHEN seq % 5 > 0 THEN 1152921504606846976 + seq % 3 ELSE -1 END"


@register("adaptive_watermark_wide_keys", f"""WITH RECURSIVE {AQ.drifting_ev()},
wide AS (SELECT seq, {_WIDE_SQL} AS event_type, t, arr FROM ev),
{AQ.watermark_sql('wide', [AQ.PLAIN], WARMUP)}
SELECT * EXCLUDE (run, event_type), nullif(event_type, -1) AS k FROM w1""")
def q_adaptive_watermark_wide_keys(spark, sf_dir):
    """W1 per key, where keys are NULL or numbers that a float cannot hold."""
    from driftmark.operators.adaptive import adaptive_watermark
    return adaptive_watermark(_wide_keys(_ev(spark, sf_dir, drifting=True)), ["k"], _adaptive_params())


@register("adwin_detect_wide_keys", f"""WITH RECURSIVE {AQ.drifting_ev()},
src AS (SELECT {_WIDE_SQL} AS stream, seq, arr, CAST(arr - t AS DOUBLE) / 3600000 AS x FROM ev),
{AQ.detect_sql('src')}
SELECT * EXCLUDE (event_type), nullif(event_type, -1) AS k FROM ({AQ.DETECT_SELECT})""")
def q_adwin_detect_wide_keys(spark, sf_dir):
    """D1-D3 per key, where keys are NULL or numbers that a float cannot hold."""
    from driftmark.operators.adaptive import adwin_detect
    ev = _wide_keys(_ev(spark, sf_dir, drifting=True))
    return _rounded(adwin_detect(ev.withColumn("delay", (F.col("arr") - F.col("t")).cast("double") / 3_600_000), ["k"], "delay"))


#: The four forms of the estimator with arguments that matter.
PRESETS = [("default",), ("sensitivity", 0.5), ("three", 0.5, 0.1, 0.1), ("four", 0.5, 0.1, 0.1)]


def _preset_configs() -> list[dict]:
    from driftmark.operators.adaptive import adaptive_preset
    return [adaptive_preset(*p) for p in PRESETS]


@register("adaptive_presets", f"""WITH RECURSIVE {AQ.drifting_ev()},
{AQ.watermark_sql('ev', _preset_configs(), WARMUP)}
SELECT {'CASE run ' + ' '.join(f"WHEN {i} THEN '{p[0]}'" for i, p in enumerate(PRESETS)) + ' END'} AS preset, event_type, seq, arr,
       wm_after AS wm, wm_after > wm_before AS rose, chunk_span, chunk_elements, chunk_late_ratio, cur_sensitivity, accepted, proposed_wm
FROM w1 WHERE detected""")
def q_adaptive_presets(spark, sf_dir):
    """W1f: the four forms of the estimator in one pass over the streams, a row
    for each detection."""
    from driftmark.operators.adaptive import adaptive_steps
    from driftmark.operators.drift import AdaptiveParams
    steps = adaptive_steps(_ev(spark, sf_dir, "event_type", drifting=True), ["event_type"],
                           [AdaptiveParams(warmup=WARMUP, **c) for c in _preset_configs()])
    names = F.array(*[F.lit(p[0]) for p in PRESETS])
    return steps.withColumn("preset", F.element_at(names, F.col("config") + 1)).drop("config")


# --- streaming (slices in arrival order, availableNow) ---------------------------

SLICES = 4


def _live(spark, sf_dir, name, live, *cols, drifting=False, rows=None, slices=SLICES, exactly=False):
    """What ``live`` makes of the events (or of ``rows``), slice by slice."""
    from driftmark.plans.replay import replayed
    return replayed(_ev(spark, sf_dir, *cols, drifting=drifting) if rows is None else rows, name, live, slices, exactly)


def _unflushed(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE NOT flushed"


@register("stream_running_average", ORACLES["running_average"])
def q_stream_running_average(spark, sf_dir):
    """T8 live: the running mean kept in keyed streaming state; micro-batches
    are arrival slices.  Must equal the batch operator row for row."""
    from driftmark.streaming.live import running_average_stream
    out = _live(spark, sf_dir, "ravg", lambda sdf: running_average_stream(sdf, ["event_type"], "value", scale=VALUE_SCALE),
                "event_type", "value")
    return out.select("seq", "event_type", "running_avg")


@register("stream_adaptive", f"WITH RECURSIVE {AQ.adaptive_panes_sql(H, 0, WARMUP)}\nSELECT * FROM panes WHERE NOT flushed")
def q_stream_adaptive(spark, sf_dir):
    """W1 + T1 live via transformWithStateInPandas: panes fired by the
    adaptive watermark (windows never fired stay in state)."""
    from driftmark.streaming.live import adaptive_panes_stream
    return _live(spark, sf_dir, "adapt", lambda sdf: adaptive_panes_stream(sdf, ["event_type"], ["event_type"], H, 0, _adaptive_params()),
                 "event_type", drifting=True)


@register("stream_bounded_panes", _unflushed(_panes_oracle(3 * H)))
def q_stream_bounded_panes(spark, sf_dir):
    """W2 + T1 + L3/L4 live with exact semantics (stateful processors): every
    pane the batch plan fires, none of the end-of-stream flushes."""
    from driftmark.streaming.live import bounded_panes_stream
    return _live(spark, sf_dir, "bounded", lambda sdf: bounded_panes_stream(sdf, ["event_type"], ["event_type"], H, H, H, 3 * H), "event_type")


@register("stream_panes_users", _unflushed(_panes_oracle(3 * H, ("event_type", "user_id"))))
def q_stream_panes_users(spark, sf_dir):
    """T1 live with the watermark per event type and windows per (event type,
    user): the live twin of ``tumbling_panes_users``."""
    from driftmark.streaming.live import bounded_panes_stream
    return _live(spark, sf_dir, "users", lambda sdf: bounded_panes_stream(sdf, ["event_type"], ["event_type", "user_id"], H, H, H, 3 * H),
                 "event_type", "user_id")


@register("stream_time_lag_panes", _unflushed(ORACLES["time_lag_panes"]))
def q_stream_time_lag_panes(spark, sf_dir):
    """W4 + T1 + L3/L4 live."""
    from driftmark.streaming.live import time_lag_panes_stream
    return _live(spark, sf_dir, "lag", lambda sdf: time_lag_panes_stream(sdf, ["event_type"], ["event_type"], TIME_LAG, TIME_LAG_PERIOD, H, 3 * H),
                 "event_type")


def _marked_rows(spark, sf_dir):
    """The events with a marker before the first of each arrival hour: the
    hour's start less 5 h.  Markers have a lower ``seq`` than any event."""
    from driftmark.functions.time import floor_div
    from driftmark.streaming.processors import EVENT, MARKER
    ev = _ev(spark, sf_dir, "event_type").withColumn("kind", F.lit(EVENT))
    hour = floor_div(F.col("arr"), F.lit(H)) * H
    marks = ev.select(hour.alias("arr")).distinct().select(
        F.lit(-1).cast("long").alias("seq"), (F.col("arr") - MARKER_OFFSET).alias("t"), "arr",
        F.lit(None).cast("string").alias("event_type"), F.lit(MARKER).alias("kind"))
    return ev.unionByName(marks)


@register("stream_marker_panes", f"""WITH {Q.ev_cte()},
marks AS (SELECT DISTINCT (arr // {H}) * {H} - {MARKER_OFFSET} AS wm FROM ev),
m_groups AS (
  SELECT event_type, t - t % {H} AS wstart, greatest((arr // {H}) * {H} - {MARKER_OFFSET}, 0) AS wm_before, count(*) AS n
  FROM ev GROUP BY ALL),
{Q.panes_ctes('m_groups', [], ['event_type'], H, 3 * H, '(SELECT min(wm) FROM marks WHERE wm >= o.wend - 1)')}
SELECT * FROM panes WHERE NOT flushed""")
def q_stream_marker_panes(spark, sf_dir):
    """W5 + T1 + L3/L4 live: in-stream markers that hold for every key."""
    from driftmark.streaming.live import marker_panes_stream
    return _live(spark, sf_dir, "marker", lambda sdf: marker_panes_stream(sdf, ["event_type"], H, 3 * H), rows=_marked_rows(spark, sf_dir))


#: The last tick's timer fires although nothing follows it.
_IDLE_SQL = _panes_oracle(3 * H).replace("CASE WHEN is_last THEN wm_begin ELSE greatest(wm_fire, wm_begin) END", "greatest(wm_fire, wm_begin)")


@register("stream_idle_panes", _unflushed(_IDLE_SQL))
def q_stream_idle_panes(spark, sf_dir):
    """W2 + T1 live on a stream that stops: the tick of the last events fires
    by the clock (an hour of arrival time passes in 100 ms)."""
    from driftmark.plans.replay import feed
    from driftmark.session import scratch_dir
    from driftmark.streaming.live import bounded_panes_stream, until_idle
    out, ckpt, made = scratch_dir(spark, "idle-out"), scratch_dir(spark, "idle-ckpt"), []
    ev = _ev(spark, sf_dir, "event_type")
    rows = ev.count()

    def run(sdf):
        made.append(bounded_panes_stream(sdf, ["event_type"], ["event_type"], H, H, H, 3 * H, idle=True, speed=H / 100))
        # batches are further apart than the 100 ms after which a timer is due
        until_idle(made[-1].writeStream.format("parquet").option("checkpointLocation", ckpt)
                   .trigger(processingTime="200 milliseconds").start(out), rows)

    feed(ev, 1, run)
    return spark.read.schema(made[0].schema).parquet(out)


def _ended(ev):
    """The events and an end for each of their streams."""
    from driftmark.streaming.processors import END, EVENT
    last = ev.groupBy("event_type").agg(F.max("arr").alias("arr")).select(
        F.lit(2 ** 62).cast("long").alias("seq"), F.lit(0).cast("long").alias("t"), "arr", "event_type", F.lit(END).alias("kind"))
    return ev.withColumn("kind", F.lit(EVENT)).unionByName(last)


@register("stream_flushed_panes", _panes_oracle(3 * H))
def q_stream_flushed_panes(spark, sf_dir):
    """W2 + T1 live on a stream that ends: an end row flushes what is open, so
    the panes are those of the batch plan, flushed ones included."""
    from driftmark.streaming.live import bounded_panes_stream
    return _live(spark, sf_dir, "flush", lambda sdf: bounded_panes_stream(sdf, ["event_type"], ["event_type"], H, H, H, 3 * H),
                 rows=_ended(_ev(spark, sf_dir, "event_type")))


@register("stream_pane_text", ORACLES["pane_text_roundtrip"])
def q_stream_pane_text(spark, sf_dir):
    """K1 live: the panes of a finished stream written as text, one folder a
    micro-batch, and parsed back."""
    from driftmark.plans.replay import feed
    from driftmark.session import scratch_dir
    from driftmark.sources.text import read_panes_text
    from driftmark.streaming.live import bounded_panes_stream, finish, write_panes_stream
    out, ckpt = scratch_dir(spark, "pane-text"), scratch_dir(spark, "pane-text-ckpt")
    feed(_ended(_ev(spark, sf_dir, "event_type")), SLICES, lambda sdf: finish(write_panes_stream(
        bounded_panes_stream(sdf, ["event_type"], ["event_type"], H, H, H, 3 * H), out, ckpt)))
    return read_panes_text(spark, out).select("wstart", "wend", "cnt", "lag", "flushed")


NATIVE_SLICES = 8  # what is dropped depends on the micro-batches


def _native_sql(slices: int = NATIVE_SLICES) -> str:
    """Micro-batches are arrival slices.  A batch drops rows whose window had
    ended by the watermark that the batch before it evicted by, which is set by
    the batches before that one."""
    return f"""WITH {Q.ev_cte()},
b AS (SELECT min(arr) AS lo, greatest(1, (max(arr) - min(arr)) // {slices} + 1) AS span FROM ev),
s AS (SELECT event_type, t, t - t % {H} AS wstart, (arr - lo) // span AS batch FROM ev, b),
m AS (SELECT batch, max(t) AS top FROM s GROUP BY batch),
l AS (SELECT x.batch, (SELECT max(top) FROM m WHERE m.batch < x.batch - 1) - {H} AS wm FROM m x)
SELECT event_type, wstart, wstart + {H} AS wend, count(*) AS cnt
FROM s JOIN l USING (batch)
WHERE (wm IS NULL OR wstart + {H} > wm) AND wstart + {H} <= (SELECT max(top) FROM m) - {H}
GROUP BY ALL"""


@register("stream_tumbling_native", _native_sql())
def q_stream_tumbling_native(spark, sf_dir):
    """Built-in live counterpart of W2 + T1: withWatermark(delay 1 h) and
    hourly event-time windows per event type (approximate, §7.4)."""
    from driftmark.streaming.live import tumbling_counts_native
    return _live(spark, sf_dir, "native", lambda sdf: tumbling_counts_native(sdf, ["event_type"], H, H), "event_type",
                 slices=NATIVE_SLICES, exactly=True)


@register("stream_sessions", f"""WITH ses AS ({ORACLES['session_windows']})
SELECT * FROM ses WHERE send <= (SELECT max(epoch_us(ts) // 1000) FROM events) - {7 * H}""")
def q_stream_sessions(spark, sf_dir):
    """T7 live: session windows per user behind a 7 h watermark delay."""
    from driftmark.streaming.live import session_windows_stream
    return _live(spark, sf_dir, "sess", lambda sdf: session_windows_stream(sdf, ["user_id"], SESSION_GAP, 7 * H), "user_id")


# --- a second dataset: lineitem, arriving in order-key order -------------------

DAY = 86_400_000
LI_PERIOD = 1_000            # watermark tick every 1,000 order keys
LI_BOUND = 30 * DAY          # bounded disorder of ship dates
LI_CTE = """li AS (
  SELECT l_returnflag, epoch_us(l_shipdate) // 1000 AS t, l_orderkey AS arr FROM lineitem)"""


@register("lineitem_panes", f"""WITH {Q.bounded_panes_sql(['l_returnflag'], ['l_returnflag'], LI_BOUND, LI_PERIOD, DAY, 7 * DAY, src='li', pre=LI_CTE)}
SELECT * FROM panes""")
def q_lineitem_panes(spark, sf_dir):
    """Daily ship-date panes per return flag while line items arrive in
    order-key order: 30-day bounded watermark on a 1,000-key tick, 7 days
    allowed lateness."""
    from driftmark.plans.runs import bounded_panes
    from driftmark.sources.fixtures import lineitem_stream
    li = lineitem_stream(spark, sf_dir, "l_returnflag")
    return bounded_panes(li, ["l_returnflag"], ["l_returnflag"], LI_BOUND, LI_PERIOD, DAY, 7 * DAY)
