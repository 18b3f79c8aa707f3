"""What the live stages hold in memory, and how many slices a replay has."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF_SMALL
from driftmark.plans import catalog, replay
from driftmark.streaming import live
from driftmark.streaming import processors as P

H = 3_600_000


def test_native_windows_come_in_eight_slices(spark, monkeypatch):
    """F2: what the built-in windows drop depends on the micro-batches, and code
    and SQL have eight of them whatever the size of the table."""
    seen, feed = [], replay.feed
    monkeypatch.setattr(replay, "BATCH_ROWS", 10)
    monkeypatch.setattr(replay, "feed", lambda df, slices, run: (seen.append(slices), feed(df, slices, run)))
    assert catalog.QUERIES["stream_tumbling_native"](spark, SF_SMALL).count() > 0
    assert seen == [8] and "// 8 + 1" in catalog.ORACLES["stream_tumbling_native"]


def test_large_tables_come_in_more_slices(spark, monkeypatch):
    monkeypatch.setattr(replay, "BATCH_ROWS", 10)
    df = spark.range(101)
    assert (replay.enough(df, 4), replay.enough(df, 40)) == (11, 40)


class _State:
    """The states of a processor that are used, in memory."""

    def __init__(self):
        self.value, self.map = None, {}
        self.exists, self.get = (lambda: self.value is not None), (lambda: self.value)
        self.iterator = lambda: [(k, v) for k, v in self.map.items()]
        self.removeKey = lambda k: self.map.pop(k)

    def update(self, v):
        self.value = v

    def updateValue(self, k, v):  # noqa: N802
        self.map[k] = v


class _Handle:
    getValueState = getMapState = lambda self, name, *schemas: _State()  # noqa: E731, N815


@pytest.mark.parametrize("policy,period", [(lambda: P.BoundedPolicy(H, H), H), (P.MarkerPolicy, None)])
def test_rows_of_one_tick_travel_as_one(policy, period):
    """what a clock sends on grows with the windows and moves of
    the watermark, not with the events."""
    rng, n = np.random.default_rng(1), 400_000
    arr = np.sort(rng.integers(0, 10 * H, n))
    pdf = pd.DataFrame(dict(seq=np.arange(n), t=arr - rng.integers(0, 6 * H, n) + 6 * H, arr=arr, ref=arr, kind=P.EVENT, bucket=0, wkey=""))
    clock = P.ClockProcessor(policy, H, 3 * H, period=period)
    clock.init(_Handle())
    out = pd.concat(clock.handleInputRows(("a",), (pdf[i:i + 10_000] for i in range(0, n, 10_000)), None))
    assert len(out) < 1000
    if period is None:
        assert out["n"].sum() == n


class _Query:
    """A streaming query that has made these batches, as far as they are looked at."""

    def __init__(self, batches, ends=False):
        self.batches, self.ends, self.looks, self.stopped = batches, ends, 0, False
        self.stop, self.exception = (lambda: setattr(self, "stopped", True)), (lambda: None)

    @property
    def isActive(self):  # noqa: N802
        self.looks += 1
        return not (self.ends and self.looks > len(self.batches))

    @property
    def recentProgress(self):  # noqa: N802
        return [dict(batchId=i, numInputRows=n) for i, n in enumerate(self.batches[:self.looks])][-100:]


@pytest.fixture()
def _no_wait(monkeypatch):
    monkeypatch.setattr(live.time, "sleep", lambda s: None)


@pytest.mark.parametrize("batches,rows", [([5, 0, 0, 0], 5), ([5] + [0] * 9 + [7, 0, 0, 0], 12), ([0, 0, 0], 0)])
def test_idle_query_ends_when_all_rows_were_taken(_no_wait, batches, rows):
    q = _Query(batches)
    live.until_idle(q, rows)
    assert q.stopped and q.looks == len(batches)


@pytest.mark.parametrize("q", [_Query([5, 0], ends=True), _Query([], ends=True), _Query([5] + [0] * 1000), _Query([0] * 1000)])
def test_idle_query_without_all_rows_is_an_error(_no_wait, q):
    """a query that ended, or that did not take all rows, looked like a result."""
    with pytest.raises(RuntimeError, match="of 6 rows"):
        live.until_idle(q, 6)
    assert q.stopped


def test_idle_panes_take_the_time_they_need(spark, monkeypatch):
    """what had come after 900 seconds was returned as the result."""
    import time

    from oracle_compare import compare, duck
    start, calls = time.time(), []
    monkeypatch.setattr(time, "time", lambda: start + 1000 * len(calls) + (calls.append(1) or 0))
    r = compare(spark, duck(SF_SMALL), "stream_idle_panes", catalog.QUERIES["stream_idle_panes"], catalog.ORACLES["stream_idle_panes"], SF_SMALL)
    assert r["ok"] and r["rows"][0], r
