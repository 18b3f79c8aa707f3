"""Stateful processors for ``groupBy(...).transformWithStateInPandas``.

Live panes (T1 with L3/L4) are two chained stages, so that windows may be
keyed finer than the stream whose watermark governs them.

``ClockProcessor``, one per stream: orders the stream's events by arrival,
    advances a watermark policy (W1, W2, W4 or W5) and sends every event on to
    the windows together with the watermark it met.  It knows which window
    ends are open and which of the ``BUCKETS`` groups of window keys hold any of
    them (a bit each), and sends a control row to just those when an end fires
    or expires.  With ``idle`` it also sets a processing-time timer for the next
    tick: a stream that stops still fires every tick it would have fired.
``WindowProcessor``, one per (stream, bucket, window end): counts per key,
    fires them when told, re-fires for kept late events, and forgets them when
    told.  A micro-batch touches only the windows that its rows belong to or
    that are due.
``RunningAverageProcessor``  T8 live: ValueState ``(count, exact sum)``.

All state is typed (numbers and arrays of numbers), so it outlives the classes
that wrote it.  Rows of one key inside a micro-batch arrive in no particular
order and are sorted by arrival ``(arr, seq)``: a stream's rows of one micro-batch
are in memory together as plain numbers, which the source's ``maxFilesPerTrigger``
or ``maxBytesPerTrigger`` bounds.  Events that one tick judges alike are combined
as they come, and events that met the same watermark travel on as one row.  Micro-batches themselves must follow arrival
order; an event that arrives behind a tick that has fired belongs to the
current tick.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftmark.operators.drift import STATE, AdaptiveParams, AdaptiveState

#: Groups of window keys of a stream (bits of a long).
BUCKETS = 32
#: Rows into the clock: events, in-stream markers, the end of the stream.
EVENT, MARKER, END = 0, 1, 2
#: Rows out of the clock: events, an end that fires, is flushed, is over.
COUNT, FIRE, FLUSH, OVER = 0, 1, 2, 3
NONE = -(1 << 62)  # no watermark yet, lower than any


def _alike(by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows equal in ``by`` are neighbours (the earlier first),
    and where each such group begins."""
    order = np.lexsort(by[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in by], axis=0)
    return order, np.flatnonzero(new)


class _Rows:
    """The rows of a stream in a micro-batch, taken frame by frame.  With ``period``
    events of one tick, window and key become one row: the last arrival, the
    greatest time and how many."""

    NAMES = ("arr", "seq", "kind", "t", "ref", "bucket", "wend", "key", "n")

    def __init__(self, width: int, period: int | None):
        self.width, self.period = width, period
        self.held: list[list[np.ndarray]] = []
        self.keys: dict[str, int] = {}
        self.fresh = 0  # rows since they were combined

    def take(self, pdf: pd.DataFrame) -> None:
        t, arr = pdf["t"].astype("int64").to_numpy(), pdf["arr"].astype("int64").to_numpy()
        num = lambda c: pdf[c].astype("int64").to_numpy()
        code, names = pd.factorize(pdf["wkey"])
        code = np.array([self.keys.setdefault(k, len(self.keys)) for k in names], dtype=np.int64)[code]
        self.held.append([arr, num("seq"), num("kind"), t, pdf["ref"].fillna(pdf["t"]).astype("int64").to_numpy(), num("bucket"),
                          t - t % self.width + self.width, code, np.ones(len(t), dtype=np.int64)])
        self.fresh += len(t)
        if self.period and self.fresh > 200_000:
            self._combine()

    def _combine(self) -> None:
        arr, seq, kind, t, ref, bucket, wend, key, n = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order, at = _alike([arr // self.period, wend, bucket, key])
        first, top = order[at], lambda c: np.maximum.reduceat(c[order], at)
        self.held = [[top(arr), seq[first], kind[first], top(t), ref[first], bucket[first], wend[first], key[first], np.add.reduceat(n[order], at)]]
        self.fresh = 0

    def sorted(self) -> dict[str, np.ndarray]:
        if self.period:
            self._combine()
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held = []
        order = np.lexsort(cols[2::-1])
        return dict(zip(self.NAMES, (c[order] for c in cols), strict=True))


class BoundedPolicy:
    """At every epoch-aligned arrival tick the watermark becomes
    ``max t seen so far - bound`` if that is higher.  Ticks without events
    change nothing, so a tick's timer fires with the first event of a later
    tick, or by the clock."""

    SCHEMA = "tick long, tick_max long, seen_max long, wm long, last long"

    def __init__(self, max_ooo: int, period: int):
        self.ooo, self.period = int(max_ooo), int(period)
        self.tick = self.tick_max = self.last = None
        self.seen_max = self.wm = 0

    def dump(self) -> tuple:
        return self.tick, self.tick_max, self.seen_max, self.wm, self.last

    def load(self, row: tuple) -> None:
        self.tick, self.tick_max, self.seen_max, self.wm, self.last = row

    def _close(self) -> None:
        if self.tick_max is not None:
            self.seen_max = max(self.seen_max, self.tick_max)
            self.wm = max(self.wm, self.seen_max - self.ooo)
            self.tick_max = None

    def before(self, t: int, arr: int) -> None:
        k = arr // self.period
        if self.tick is not None and k > self.tick:
            self._close()
        self.tick = k if self.tick is None else max(k, self.tick)
        self.last = arr if self.last is None else max(arr, self.last)
        self.tick_max = t if self.tick_max is None else max(self.tick_max, t)

    def after(self, t: np.ndarray, ref: np.ndarray) -> list[tuple[int, int]]:
        return []

    def fired(self, wend: int) -> int:
        """The watermark that fires ``wend``, of those since the last call."""
        return self.wm

    def wait(self, ends: list[int]) -> int | None:
        """Arrival time from the last event to the tick that may fire something."""
        return (self.tick + 1) * self.period - self.last if self.tick_max is not None else None

    def expire(self, ends: list[int]) -> None:
        self._close()
        self.tick += 1
        self.last = self.tick * self.period


class TimeLagPolicy:
    """At every tick the watermark is ``tick time - lag``."""

    SCHEMA = "tick long, last long"

    def __init__(self, lag: int, period: int):
        self.lag, self.period = int(lag), int(period)
        self.tick = self.last = None

    def dump(self) -> tuple:
        return self.tick, self.last

    def load(self, row: tuple) -> None:
        self.tick, self.last = row

    @property
    def wm(self) -> int:
        return NONE if self.tick is None else self.tick * self.period - self.lag

    def before(self, t: int, arr: int) -> None:
        self.tick = arr // self.period if self.tick is None else max(arr // self.period, self.tick)
        self.last = arr if self.last is None else max(arr, self.last)

    def after(self, t: np.ndarray, ref: np.ndarray) -> list[tuple[int, int]]:
        return []

    def _due(self, wend: int) -> int:
        return -((1 - wend - self.lag) // self.period)

    def fired(self, wend: int) -> int:
        # ticks without events fire too: the first that reaches the end
        return self._due(wend) * self.period - self.lag

    def wait(self, ends: list[int]) -> int | None:
        return max(self._due(min(ends)), self.tick + 1) * self.period - self.last if ends else None

    def expire(self, ends: list[int]) -> None:
        self.tick = max(self._due(min(ends)), self.tick + 1) if ends else self.tick
        self.last = self.tick * self.period


class MarkerPolicy:
    """The watermark is the highest time of the marker rows so far."""

    SCHEMA = "wm long"

    def __init__(self):
        self.wm = 0

    def dump(self) -> tuple:
        return (self.wm,)

    def load(self, row: tuple) -> None:
        self.wm, = row

    def before(self, t: int, arr: int) -> None:
        pass

    def mark(self, t: int) -> None:
        self.wm = max(self.wm, t)

    def after(self, t: np.ndarray, ref: np.ndarray) -> list[tuple[int, int]]:
        return []

    def fired(self, wend: int) -> int:
        return self.wm

    def wait(self, ends: list[int]) -> int | None:
        return None


class AdaptivePolicy:
    """The drift-driven estimator; the watermark may rise after an event."""

    SCHEMA = STATE

    def __init__(self, params: AdaptiveParams):
        self.st = AdaptiveState(params)

    def dump(self) -> tuple:
        return self.st.dump()

    def load(self, row: tuple) -> None:
        self.st = AdaptiveState.load(self.st.p, tuple(row))

    @property
    def wm(self) -> int:
        return self.st.wm

    def before(self, t: int, arr: int) -> None:
        pass

    def after(self, t: np.ndarray, ref: np.ndarray) -> list[tuple[int, int]]:
        """Positions of the events after which the watermark rose, and to what."""
        got = self.st.extend(t, ref)
        rose = np.flatnonzero(got.wm_after > got.wm_before)
        return list(zip(rose.tolist(), got.wm_after[rose].tolist(), strict=True))

    def fired(self, wend: int) -> int:
        return self.st.wm

    def wait(self, ends: list[int]) -> int | None:
        return None


class ClockProcessor(StatefulProcessor):
    """Stage one of live panes (see the module doc), grouped by ``skey``, the stream
    as one string.  In: ``seq, t, arr, ref, kind, bucket`` and ``wkey``, the rest of the
    window key as one string.  Out: ``skey, bucket, wend, kind, ord, wm, wkey, n``.
    ``period``: if given, the policy depends on an event's tick only and all rows are
    events."""

    def __init__(self, policy, width: int, allowed: int, idle: bool = False, speed: float = 1.0, period: int | None = None):
        self.policy, self.width, self.allowed = policy, int(width), int(allowed)
        self.idle, self.speed, self.period = idle, speed, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pol = handle.getValueState("policy", self.policy().SCHEMA)
        self.count = handle.getValueState("count", "ord long")
        # open window ends: which buckets hold keys, and whether it has fired
        self.ends = handle.getMapState("ends", "wend long", "buckets long, fired boolean")

    def _open(self):
        pol = self.policy()
        if self.pol.exists():
            pol.load(self.pol.get())
        ends = {k[0]: [v[0], v[1]] for k, v in self.ends.iterator()}
        return pol, ends, self.count.get()[0] if self.count.exists() else 0

    def _close(self, pol, before: dict, ends: dict, ord_: int) -> None:
        self.pol.update(pol.dump())
        self.count.update((ord_,))
        for w in before.keys() - ends.keys():
            self.ends.removeKey((w,))
        for w, v in ends.items():
            if before.get(w) != v:
                self.ends.updateValue((w,), tuple(v))

    def _controls(self, pol, wm: int, ends: dict, ord_: int, flush: bool = False) -> list[tuple]:
        """Control rows ``(bucket, wend, kind, ord, wm)`` for what ``wm`` fires or ends."""
        out = []
        for w in sorted(ends):
            if w - 1 > wm and not flush:
                break
            mask, fired = ends[w]
            kinds = [] if fired else [FLUSH if flush and w - 1 > wm else FIRE]
            over = flush or w - 1 + self.allowed <= wm
            kinds += [OVER] * over
            at = pol.fired(w)
            out += [(b, w, kind, ord_, at) for kind in kinds for b in range(BUCKETS) if mask >> b & 1]
            if over:
                del ends[w]
            else:
                ends[w] = [mask, True]
        return out

    def _frame(self, key, controls: list[tuple], events: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        parts = []
        if events is not None and len(events):
            parts.append(events)
        if controls:
            parts.append(pd.DataFrame(controls, columns=["bucket", "wend", "kind", "ord", "wm"]).assign(wkey="", n=0))
        for x in parts:
            for i in range(0, len(x), 10_000):
                yield x.iloc[i:i + 10_000].assign(skey=key[0])[["skey", "bucket", "wend", "kind", "ord", "wm", "wkey", "n"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = _Rows(self.width, self.period)
        for pdf in rows:
            held.take(pdf)
        x = held.sorted()
        pol, ends, ord_ = self._open()
        before = {w: list(v) for w, v in ends.items()}
        wms, segments = np.zeros(len(x["t"]), dtype=np.int64), np.full(len(x["t"]), -1, dtype=np.int64)
        controls, wm, begun = [], pol.wm, ord_ + 1
        # W1 looks at all events of the batch at once and says where it rises
        events = np.flatnonzero(x["kind"] == EVENT)
        rises = {int(events[i]): w for i, w in pol.after(x["t"][events], x["ref"][events])} if isinstance(pol, AdaptivePolicy) else None
        for lo in range(0, len(wms), 100_000):
            part = (x[c][lo:lo + 100_000].tolist() for c in ("kind", "t", "arr", "wend", "bucket"))
            for i, (kind, t, arr, wend, bucket) in enumerate(zip(*part, strict=True), lo):
                ord_ += 1
                if kind == EVENT:
                    if rises is None:
                        pol.before(t, arr)
                        if pol.wm > wm:
                            wm, begun = pol.wm, ord_
                            controls += self._controls(pol, wm, ends, ord_ * 2 - 1)
                    if wend - 1 + self.allowed > wm:
                        end = ends.get(wend)
                        if end is None:
                            end = ends[wend] = [0, wend - 1 <= wm]
                        end[0] |= 1 << bucket
                        wms[i], segments[i] = wm, begun
                    if rises is not None and i in rises:
                        wm, begun = rises[i], ord_ + 1
                        controls += self._controls(_Fixed(wm), wm, ends, ord_ * 2 + 1)
                elif kind == MARKER:
                    pol.mark(t)
                    if pol.wm > wm:
                        wm, begun = pol.wm, ord_
                        controls += self._controls(pol, wm, ends, ord_ * 2 - 1)
                else:
                    begun = ord_
                    controls += self._controls(pol, wm, ends, ord_ * 2 - 1, flush=True)
        self._close(pol, before, ends, ord_)
        self._set_timer(pol, ends, timerValues)
        yield from self._frame(key, controls, self._counts(x, wms, segments, list(held.keys)))

    @staticmethod
    def _counts(x: dict[str, np.ndarray], wms: np.ndarray, segments: np.ndarray, keys: list[str]) -> pd.DataFrame | None:
        """Events between two moves of the watermark, by window and key."""
        kept = np.flatnonzero(segments >= 0)
        if not len(kept):
            return None
        order, at = _alike([segments[kept], x["wend"][kept], x["bucket"][kept], x["key"][kept]])
        first = kept[order[at]]
        names = np.array(keys, dtype=object)
        return pd.DataFrame(dict(bucket=x["bucket"][first], wend=x["wend"][first], kind=COUNT, ord=segments[first] * 2, wm=wms[first],
                                 wkey=names[x["key"][first]], n=np.add.reduceat(x["n"][kept][order], at)))

    def _set_timer(self, pol, ends: dict, timer) -> None:
        if not self.idle:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wait = pol.wait([w for w, (_, fired) in ends.items() if not fired])
        if wait is not None:
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + max(1, int(wait / self.speed)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        pol, ends, ord_ = self._open()
        before, wm = {w: list(v) for w, v in ends.items()}, pol.wm
        pol.expire([w for w, (_, fired) in ends.items() if not fired])
        controls = self._controls(pol, pol.wm, ends, ord_ * 2 + 1) if pol.wm > wm else []
        self._close(pol, before, ends, ord_ + 1)
        self._set_timer(pol, ends, timerValues)
        yield from self._frame(key, controls, None)

    def close(self) -> None:
        pass


class _Fixed:
    """What fires a window where the watermark is known."""

    def __init__(self, wm: int):
        self.wm = wm

    def fired(self, wend: int) -> int:
        return self.wm


class WindowProcessor(StatefulProcessor):
    """Stage two of live panes, grouped by (``skey``, bucket, window end): the
    counts of its window keys.  Late events that came together are one row of ``n``
    panes with the counts ``cnt``, ``cnt + 1``, ..."""

    def __init__(self, width: int):
        self.width = int(width)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.win = handle.getMapState("win", "k string", "cnt long, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ord", "kind"], kind="stable", ignore_index=True)
        wend, wins, dirty, all_, out = int(key[-1]), {}, set(), False, []
        for kind, wm, k, n in zip(pdf["kind"].tolist(), pdf["wm"].tolist(), pdf["wkey"].tolist(), pdf["n"].tolist(), strict=True):
            if kind == COUNT:
                if k not in wins:
                    wins[k] = list(self.win.getValue((k,))) if not all_ and self.win.containsKey((k,)) else [0, False]
                w = wins[k]
                if wm >= wend - 1:  # kept late: each re-fires now
                    w[1] = True
                    out.append((k, w[0] + 1, wm - wend, False, True, n))
                w[0] += n
                dirty.add(k)
                continue
            if not all_:
                wins, all_ = {k_[0]: list(v) for k_, v in self.win.iterator()} | wins, True
            if kind == OVER:
                self.win.clear()
                wins, dirty = {}, set()
                continue
            for k_, w in wins.items():
                if not w[1]:
                    w[1] = True
                    dirty.add(k_)
                    out.append((k_, w[0], None if kind == FLUSH else wm - wend, kind == FLUSH, False, 1))
        for k in dirty:
            self.win.updateValue((k,), tuple(wins[k]))
        if out:
            df = pd.DataFrame(out, columns=["wkey", "cnt", "lag", "flushed", "late_fire", "n"])
            df["lag"] = df["lag"].astype("Int64")
            df["wstart"], df["wend"] = wend - self.width, wend
            yield df.assign(skey=key[0])[["skey", "wkey", "wstart", "wend", "cnt", "lag", "flushed", "late_fire", "n"]]

    def close(self) -> None:
        pass


class RunningAverageProcessor(StatefulProcessor):
    """Running mean of ``value`` per key in arrival order (exact sum when
    ``value`` arrives as DECIMAL)."""

    def __init__(self, key_cols: list[str], scale: int | None = None):
        self.key_cols, self.scale = list(key_cols), scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        total = f"decimal(38,{self.scale})" if self.scale is not None else "double"
        self.acc = handle.getValueState("acc", f"cnt long, total {total}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["arr", "seq"])
        if self.acc.exists():
            cnt, total = self.acc.get()
        else:
            cnt, total = 0, (Decimal(0) if self.scale is not None else 0.0)
        avgs = []
        for v in pdf["value"].tolist():
            if v is not None and not (isinstance(v, float) and v != v):
                cnt += 1
                total += v
            avgs.append(float(total) / cnt if cnt else None)
        self.acc.update((cnt, total))
        out = pd.DataFrame({"seq": pdf["seq"].to_numpy(), "running_avg": avgs})
        for i, c in enumerate(self.key_cols):
            out.insert(i, c, key[i])
        yield out

    def close(self) -> None:
        pass
