"""DuckDB SQL builders for the oracle side of the query catalog.

These state the same semantics directly in window-function SQL over the
driver's tables (one partition per stream, plain ``ROWS`` frames,
correlated as-of subqueries): a brute-force restatement, not a copy of
the Spark plans, which use blocked scans and pre-aggregation instead.
"""

from __future__ import annotations

from driftmark.sources.fixtures import DELAY_ADD, DELAY_MOD, DELAY_MULT, DELAY_UNIT_MS

LONG_MAX = 9223372036854775807


def ev_cte(name: str = "ev") -> str:
    return f"""{name} AS (
  SELECT event_id AS seq, event_type, user_id, value,
         epoch_us(ts) // 1000 AS t,
         epoch_us(ts) // 1000
           + ((event_id * {DELAY_MULT} + {DELAY_ADD}) % {DELAY_MOD}) * {DELAY_UNIT_MS} AS arr
  FROM events)"""


def _cols(cols: list[str], alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return "".join(f"{p}{c}, " for c in cols)


def _match(cols: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols) or "TRUE"


def _part(cols: list[str]) -> str:
    return f"PARTITION BY {', '.join(cols)}" if cols else ""


def bounded_ctes(src: str, S: list[str], K: list[str], ooo, period, width) -> str:
    """CTEs b_fine, b_ticks, b_steps, b_groups for the bounded watermark."""
    ps = _part(S)
    return f"""b_fine AS (
  SELECT {_cols(K)}arr // {period} AS tick, t - t % {width} AS wstart,
         count(*) AS n, max(t) AS tmax
  FROM {src} GROUP BY ALL),
b_pre AS (SELECT {_cols(S)}tick, max(tmax) AS tick_max FROM b_fine GROUP BY ALL),
b_tw AS (
  SELECT {_cols(S)}tick, tick_max,
    greatest(coalesce(max(tick_max) OVER ({ps} ORDER BY tick
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {ooo}, 0) AS wm_begin,
    greatest(max(tick_max) OVER ({ps} ORDER BY tick
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {ooo}, 0) AS wm_fire,
    lead(tick) OVER ({ps} ORDER BY tick) IS NULL AS is_last
  FROM b_pre),
b_ticks AS (
  SELECT *, CASE WHEN is_last THEN wm_begin ELSE greatest(wm_fire, wm_begin) END AS wm_end
  FROM b_tw),
b_steps AS (SELECT {_cols(S)}wm_end AS wm, tick FROM b_ticks WHERE wm_end > wm_begin),
b_groups AS (
  SELECT {_cols(K, 'f')}f.wstart, k.wm_begin AS wm_before, sum(f.n) AS n
  FROM b_fine f JOIN b_ticks k ON {_match(S, 'f', 'k')} AND f.tick = k.tick
  GROUP BY ALL)"""


def panes_ctes(groups: str, S: list[str], K: list[str], width, allowed, fire_sql: str) -> str:
    """CTEs p_cls .. panes.  ``fire_sql`` is a scalar expression over the
    on-time window row ``o`` giving the firing watermark (or NULL)."""
    return f"""p_cls AS (
  SELECT *, wstart + {width} AS wend,
    CASE WHEN wstart + {width} - 1 + {allowed} <= wm_before THEN 'dropped'
         WHEN wm_before < wstart + {width} - 1 THEN 'on_time'
         ELSE 'late' END AS cls
  FROM {groups}),
p_on AS (SELECT {_cols(K)}wstart, wend, sum(n) AS cnt FROM p_cls WHERE cls = 'on_time' GROUP BY ALL),
p_fire AS (SELECT o.*, {fire_sql} AS fire_wm FROM p_on o),
p_late AS (SELECT {_cols(K)}wstart, wend, wm_before, sum(n) AS n FROM p_cls WHERE cls = 'late' GROUP BY ALL),
p_late2 AS (
  SELECT l.*, coalesce(o.cnt, 0) + coalesce(sum(l.n) OVER (
           PARTITION BY {_cols(K, 'l')}l.wstart ORDER BY l.wm_before
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM p_late l LEFT JOIN p_on o ON {_match(K, 'l', 'o')} AND l.wstart = o.wstart),
p_late3 AS (SELECT *, unnest(generate_series(1, CAST(n AS BIGINT))) AS i FROM p_late2),
panes AS (
  SELECT {_cols(K)}wstart, wend, CAST(cnt AS BIGINT) AS cnt, fire_wm - wend AS lag,
         fire_wm IS NULL AS flushed, false AS late_fire
  FROM p_fire
  UNION ALL
  SELECT {_cols(K)}wstart, wend, CAST(base + i AS BIGINT) AS cnt, wm_before - wend AS lag,
         false AS flushed, true AS late_fire
  FROM p_late3)"""


def steps_fire(S: list[str]) -> str:
    return f"(SELECT min(s.wm) FROM b_steps s WHERE {_match(S, 's', 'o')} AND s.wm >= o.wend - 1)"


def bounded_panes_sql(S: list[str], K: list[str], ooo, period, width, allowed,
                      src: str = "ev", pre: str = "") -> str:
    """WITH-clause body producing ``panes``."""
    head = f"{pre},\n" if pre else ""
    return (f"{head}{bounded_ctes(src, S, K, ooo, period, width)},\n"
            f"{panes_ctes('b_groups', S, K, width, allowed, steps_fire(S))}")


def collapse_sql(group_cols: list[str], panes: str = "panes") -> str:
    return f"""SELECT {_cols(group_cols)}wend,
       CAST(min(cnt) + count(*) - 1 AS BIGINT) AS elements, arg_min(lag, cnt) AS lag
FROM {panes} WHERE NOT flushed GROUP BY ALL"""


def analyze_sql(run_cols: list[str], stream_cols: list[str], panes: str = "panes") -> str:
    return f"""pw AS (
  SELECT {_cols(run_cols)}{_cols(stream_cols)}wend,
         min(CASE WHEN NOT flushed THEN cnt END) AS first_cnt,
         count(CASE WHEN NOT flushed THEN 1 END) AS npanes,
         arg_min(CASE WHEN NOT flushed THEN lag END, CASE WHEN NOT flushed THEN cnt END) AS first_lag,
         sum(CASE WHEN flushed THEN cnt END) AS flushed_cnt
  FROM {panes} GROUP BY ALL),
summary AS (
  SELECT {_cols(run_cols)}count(first_cnt) AS windows,
         CAST(coalesce(sum(first_cnt + npanes - 1), 0) AS BIGINT) AS elements,
         CAST(sum(first_lag) AS DOUBLE) / nullif(count(first_cnt), 0) AS mean_lag,
         CAST(coalesce(sum(flushed_cnt), 0) AS BIGINT) AS not_processed
  FROM pw GROUP BY ALL)"""


def values_cte(name: str, rows: list[dict]) -> str:
    keys = list(rows[0])

    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"CAST({v} AS BIGINT)"
    body = ",\n    ".join("(" + ", ".join(lit(r[k]) for k in keys) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES\n    {body}) v({', '.join(keys)}))"
