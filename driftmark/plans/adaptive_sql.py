"""DuckDB SQL for the drift detector and the drift-driven watermark.

A recursive query with one row per stream and step.  The histogram is three
lists (items, sums, squared deviations of the buckets, oldest first).  A step
inserts one value, merges one pair of buckets, or makes one cut test; rows in
state ``D`` are the results after an event.  Nothing here follows the Spark
side, which inserts and tests in vectorised stretches; constants are stated
again on purpose.
"""

from __future__ import annotations


def drifting_ev(name: str = "ev") -> str:
    """``events`` with the delay unit 3,600 or 21,600 ms, changing every 500 ids."""
    return f"""{name} AS MATERIALIZED (
  SELECT event_id AS seq, event_type, value, epoch_us(ts) // 1000 AS t,
         epoch_us(ts) // 1000 + ((event_id * 7919 + 104729) % 1009)
           * CASE WHEN (event_id // 500) % 2 = 0 THEN 3600 ELSE 21600 END AS arr
  FROM events)"""


_LEN = "list_sum(z)"
_SPREAD = ("(list_sum(v) + list_sum(list_transform(range(1, len(z) + 1), "
           "lambda q: z[q] * pow(u[q] / z[q] - list_sum(u) / list_sum(z), 2))))")


def _differs(delta: str) -> str:
    """Whether some split of the histogram speaks for a change."""
    n0, s0 = "list_sum(z[1:k])", "list_sum(u[1:k])"
    dd = f"ln(2.0 * ln({_LEN}) / {delta})"
    m = f"(1.0 / ({n0} - 4) + 1.0 / ({_LEN} - {n0} - 4))"
    root = f"2.0 * {m} * ({_SPREAD} / {_LEN}) * {dd}"
    return f"""({_LEN} > 10 AND len(list_filter(range(1, len(z)), lambda k:
        CASE WHEN {n0} <= 6 OR {_LEN} - {n0} <= 6 THEN false
             WHEN {root} < 0 THEN false
             ELSE abs({s0} / {n0} - (list_sum(u) - {s0}) / ({_LEN} - {n0})) > sqrt({root}) + 2.0 / 3.0 * {dd} * {m} END)) > 0)"""


_AT = "list_position(z, lvl)"          # oldest bucket of the size that is too often there
_MERGED_Z = f"list_concat(z[1:{_AT} - 1], [2 * lvl], z[{_AT} + 2:])"
_MERGED_U = f"list_concat(u[1:{_AT} - 1], [u[{_AT}] + u[{_AT} + 1]], u[{_AT} + 2:])"
_MERGED_V = (f"list_concat(v[1:{_AT} - 1], [v[{_AT}] + v[{_AT} + 1] + lvl / 2.0 * pow((u[{_AT}] - u[{_AT} + 1]) / lvl, 2)], "
             f"v[{_AT} + 2:])")


def detect_sql(src: str, delta: float = 0.002, clock: int = 32) -> str:
    """CTEs ``src_i`` and ``d1`` over ``src(stream, seq, arr, x)``."""
    after = f"CASE WHEN i % {clock} = 0 THEN 'C' ELSE 'D' END"
    return f"""{src}_i AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY arr, seq) AS i FROM {src} WHERE x IS NOT NULL),
d1 AS (
  SELECT stream, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS arr, 'D' AS st,
         CAST(1 AS BIGINT) AS lvl, CAST([] AS BIGINT[]) AS z, CAST([] AS DOUBLE[]) AS u, CAST([] AS DOUBLE[]) AS v,
         false AS changed, CAST(0 AS BIGINT) AS peak
  FROM (SELECT DISTINCT stream FROM {src}_i)
  UNION ALL
  SELECT stream, i, seq, arr,
         CASE st WHEN 'I' THEN CASE WHEN len(list_filter(z, lambda q: q = 1)) > 5 THEN 'M' ELSE {after} END
                 WHEN 'M' THEN CASE WHEN len(list_filter(z, lambda q: q = lvl)) > 5 THEN 'M' ELSE {after} END
                 WHEN 'X' THEN 'C' ELSE 'D' END AS st,
         lvl, z, u, v, changed, peak
  FROM (
    SELECT d.stream, coalesce(e.i, d.i) AS i, coalesce(e.seq, d.seq) AS seq, coalesce(e.arr, d.arr) AS arr,
           CASE WHEN e.i IS NOT NULL THEN 'I' WHEN st = 'M' THEN 'M' WHEN cut THEN 'X' ELSE 'E' END AS st,
           CASE WHEN e.i IS NOT NULL THEN 1 WHEN st = 'M' THEN 2 * lvl ELSE lvl END AS lvl,
           CASE WHEN e.i IS NOT NULL THEN list_append(z, 1) WHEN st = 'M' THEN {_MERGED_Z} WHEN cut THEN z[2:] ELSE z END AS z,
           CASE WHEN e.i IS NOT NULL THEN list_append(u, e.x) WHEN st = 'M' THEN {_MERGED_U} WHEN cut THEN u[2:] ELSE u END AS u,
           CASE WHEN e.i IS NOT NULL THEN list_append(v, 0.0) WHEN st = 'M' THEN {_MERGED_V} WHEN cut THEN v[2:] ELSE v END AS v,
           CASE WHEN e.i IS NOT NULL THEN false ELSE changed OR cut END AS changed,
           CASE WHEN e.i IS NOT NULL THEN greatest(peak, len(z) + 1) ELSE peak END AS peak
    FROM (SELECT *, CASE WHEN st = 'C' THEN {_differs(str(delta))} ELSE false END AS cut FROM d1) d
    LEFT JOIN {src}_i e ON e.stream = d.stream AND e.i = d.i + 1 AND d.st = 'D'
    WHERE d.st <> 'D' OR e.i IS NOT NULL))"""


DETECT_SELECT = f"""SELECT stream AS event_type, seq, arr, changed, CAST({_LEN} AS BIGINT) AS width,
       round(list_sum(u) / {_LEN} + 1e-9, 6) AS mean, round({_SPREAD} / {_LEN} + 1e-9, 6) AS variance,
       round(list_sum(u) + 1e-9, 6) AS total,
       CAST(sum(CAST(changed AS INTEGER)) OVER w AS BIGINT) AS detections,
       CAST(sum({_LEN}) OVER w AS DOUBLE) AS cum_width, peak AS peak_buckets
FROM d1 WHERE st = 'D' AND i > 0
WINDOW w AS (PARTITION BY stream ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def watermark_sql(src: str, runs: list[dict], warmup: int, adapt_lateness: bool = False, clock: int = 32) -> str:
    """CTEs of the drift-driven watermark over ``src(event_type, seq, t, arr)``
    for every run (``run, sensitivity, change_rate, threshold``); result ``w1``
    with a row an event and run."""
    values = ", ".join(f"({i}, CAST({r['sensitivity']!r} AS DOUBLE), CAST({r['change_rate']!r} AS DOUBLE), "
                       f"CAST({r['threshold']!r} AS DOUBLE), CAST({r.get('max_lateness', 0)} AS BIGINT), "
                       f"CAST({r.get('clock', clock)} AS BIGINT))" for i, r in enumerate(runs))
    after = f"CASE WHEN (i - {warmup}) % clk = 0 THEN 'C' ELSE 'D' END"
    new = "e.i IS NOT NULL"
    fed = f"(e.i IS NOT NULL AND e.i > {warmup})"
    dev = "abs(e.arr - e.t)"
    ratio = "(chunk_late / chunk_total)"
    span = "(cmax - cmin)"
    accept = f"(wm_raw = 0 OR (wm_raw < cmin - {span} AND {ratio} < thr))"
    found = "(q.st = 'E' AND changed)"
    return f"""w_run(run, sens0, rate, thr, allowed0, clk) AS (VALUES {values}),
w_i AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY arr, seq) AS i FROM {src}),
w_st AS (
  SELECT run, rate, thr, clk, event_type, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS t,
         CAST(NULL AS BIGINT) AS arr, 'D' AS st, CAST(1 AS BIGINT) AS lvl, CAST([] AS BIGINT[]) AS z,
         CAST([] AS DOUBLE[]) AS u, CAST([] AS DOUBLE[]) AS v, false AS changed,
         allowed0 AS allowed, CAST(0 AS BIGINT) AS wm_raw, CAST(0 AS BIGINT) AS wm, CAST(0 AS BIGINT) AS wm_before,
         false AS late, CAST(0 AS BIGINT) AS chunk_total, CAST(0 AS BIGINT) AS chunk_late,
         CAST(NULL AS BIGINT) AS cmax, CAST(NULL AS BIGINT) AS cmin, CAST(NULL AS BIGINT) AS max_dev, sens0 AS sens,
         CAST(0 AS BIGINT) AS accepted_width, CAST(NULL AS BIGINT) AS chunk_span, CAST(NULL AS BIGINT) AS chunk_elements,
         CAST(NULL AS DOUBLE) AS chunk_late_ratio, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS BIGINT) AS proposed_wm
  FROM w_run, (SELECT DISTINCT event_type FROM w_i)
  UNION ALL
  SELECT run, rate, thr, clk, event_type, i, seq, t, arr,
         CASE q.st WHEN 'W' THEN 'D'
                   WHEN 'I' THEN CASE WHEN len(list_filter(z, lambda k: k = 1)) > 5 THEN 'M' ELSE {after} END
                   WHEN 'M' THEN CASE WHEN len(list_filter(z, lambda k: k = lvl)) > 5 THEN 'M' ELSE {after} END
                   WHEN 'X' THEN 'C' ELSE 'D' END,
         lvl, z, u, v, changed,
         CASE WHEN {found} AND {accept} AND {str(adapt_lateness).lower()} THEN max_dev ELSE allowed END,
         CASE WHEN {found} AND {accept} THEN cmax - allowed ELSE wm_raw END,
         CASE WHEN {found} AND {accept} THEN greatest(wm, cmax - allowed)
              WHEN {found} THEN greatest(wm, wm_raw) ELSE wm END,
         wm_before, late,
         CASE WHEN {found} AND {accept} THEN 0 ELSE chunk_total END,
         CASE WHEN {found} AND {accept} THEN 0 ELSE chunk_late END,
         CASE WHEN {found} THEN NULL ELSE cmax END, CASE WHEN {found} THEN NULL ELSE cmin END,
         CASE WHEN {found} AND {accept} AND {str(adapt_lateness).lower()} THEN NULL ELSE max_dev END,
         CASE WHEN {found} THEN CASE WHEN {ratio} < thr THEN least(1.0, sens / rate) ELSE greatest(sens * rate, 1e-23) END
              ELSE sens END,
         CASE WHEN {found} AND {accept} THEN {_LEN} ELSE accepted_width END,
         CASE WHEN {found} THEN {span} END, CASE WHEN {found} THEN chunk_total END, CASE WHEN {found} THEN {ratio} END,
         CASE WHEN {found} THEN {accept} END,
         CASE WHEN {found} THEN CASE WHEN {accept} THEN cmax - allowed ELSE cmax - {span} END END
  FROM (
    SELECT run, rate, thr, clk, d.event_type, coalesce(e.i, d.i) AS i, coalesce(e.seq, d.seq) AS seq, coalesce(e.t, d.t) AS t,
           coalesce(e.arr, d.arr) AS arr,
           CASE WHEN {fed} THEN 'I' WHEN {new} THEN 'W' WHEN st = 'M' THEN 'M' WHEN cut THEN 'X' ELSE 'E' END AS st,
           CASE WHEN {new} THEN 1 WHEN st = 'M' THEN 2 * lvl ELSE lvl END AS lvl,
           CASE WHEN {fed} THEN list_append(z, 1) WHEN st = 'M' THEN {_MERGED_Z} WHEN cut THEN z[2:] ELSE z END AS z,
           CASE WHEN {fed} THEN list_append(u, CAST({dev} AS DOUBLE) / allowed) WHEN st = 'M' THEN {_MERGED_U} WHEN cut THEN u[2:] ELSE u END AS u,
           CASE WHEN {fed} THEN list_append(v, 0.0) WHEN st = 'M' THEN {_MERGED_V} WHEN cut THEN v[2:] ELSE v END AS v,
           CASE WHEN {new} THEN false ELSE changed OR cut END AS changed,
           CASE WHEN {new} AND NOT {fed} THEN greatest(allowed, {dev}) ELSE allowed END AS allowed,
           wm_raw, wm, CASE WHEN {new} THEN wm ELSE wm_before END AS wm_before,
           CASE WHEN {fed} THEN e.t < wm_raw WHEN {new} THEN false ELSE late END AS late,
           chunk_total + CAST({fed} AS BIGINT) AS chunk_total,
           chunk_late + CASE WHEN {fed} AND e.t < wm_raw THEN 1 ELSE 0 END AS chunk_late,
           CASE WHEN {fed} THEN greatest(cmax, e.t) ELSE cmax END AS cmax,
           CASE WHEN {fed} THEN least(cmin, e.t) ELSE cmin END AS cmin,
           CASE WHEN {fed} THEN greatest(max_dev, {dev}) ELSE max_dev END AS max_dev,
           sens, accepted_width
    FROM (SELECT *, CASE WHEN st = 'C' THEN {_differs('sens')} ELSE false END AS cut FROM w_st) d
    LEFT JOIN w_i e ON e.event_type = d.event_type AND e.i = d.i + 1 AND d.st = 'D'
    WHERE d.st <> 'D' OR e.i IS NOT NULL) q),
w1 AS MATERIALIZED (
  SELECT run, event_type, seq, t, arr, wm_before, wm AS wm_after, wm_raw, late, changed AS detected,
         sens AS cur_sensitivity, allowed, CAST(coalesce({_LEN}, 0) AS BIGINT) AS adwin_width, chunk_span, chunk_elements,
         chunk_late_ratio, accepted, proposed_wm, accepted_width
  FROM w_st WHERE st = 'D' AND i > 0)"""


#: The estimator's plain form: sensitivity 1, no feedback, threshold 1.1.
PLAIN = dict(sensitivity=1.0, change_rate=1.0, threshold=1.1)


def adaptive_panes_sql(width: int, allowed: int, warmup: int) -> str:
    """WITH body whose last CTE is ``panes`` (hourly panes under ``w1``)."""
    from driftmark.plans.oracle_sql import panes_ctes
    fire = "(SELECT min(s.wm_after) FROM w1 s WHERE s.event_type = o.event_type AND s.wm_after > s.wm_before AND s.wm_after >= o.wend - 1)"
    return f"""{drifting_ev()},
{watermark_sql('ev', [PLAIN], warmup)},
a_groups AS (SELECT event_type, t - t % {width} AS wstart, wm_before, count(*) AS n FROM w1 GROUP BY ALL),
{panes_ctes('a_groups', ['event_type'], ['event_type'], width, allowed, fire)}"""
