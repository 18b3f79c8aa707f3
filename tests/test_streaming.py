"""Batch = stream: live stateful processors against the batch operators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from driftmark.operators.adaptive import adaptive_panes
from driftmark.operators.drift import AdaptiveParams
from driftmark.plans.replay import feed, replayed
from driftmark.plans.runs import bounded_panes
from driftmark.session import scratch_dir
from driftmark.sources.fixtures import event_stream
from driftmark.sources.text import read_panes_text
from driftmark.streaming import processors as P
from driftmark.streaming.live import adaptive_panes_stream, bounded_panes_stream, finish, write_panes_stream

H = 3_600_000


def _rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("slices,allowed", [(1, 0), (3, 3 * H)])
def test_adaptive_stream_equals_batch(spark, slices, allowed):
    cols = ["event_type", "wstart", "wend", "cnt", "lag", "late_fire"]
    p = AdaptiveParams(warmup=200, max_lateness=0)
    ev = event_stream(spark, SF_MID, "event_type", drifting=True)
    batch = adaptive_panes(ev, ["event_type"], ["event_type"], H, allowed, p).where(~F.col("flushed"))
    live = replayed(ev, "test-adapt", lambda s: adaptive_panes_stream(s, ["event_type"], ["event_type"], H, allowed, p), slices)
    a = _rows(batch, cols)
    assert a and a == _rows(live, cols)


def test_null_and_wide_keys_finer_than_the_stream(spark):
    """Stream and window keys with NULLs and numbers beyond 2^53."""
    ev = event_stream(spark, SF_SMALL, "event_type").select(
        "seq", "t", "arr", F.when(F.col("seq") % 4 > 0, F.lit(2 ** 60) + F.col("seq") % 3).alias("s"),
        F.when(F.col("seq") % 5 > 0, F.lit(2 ** 61) + F.col("seq") % 2).alias("k"))
    cols = ["s", "k", "wstart", "wend", "cnt", "lag", "late_fire"]
    batch = bounded_panes(ev, ["s"], ["s", "k"], H, H, H, 3 * H).where(~F.col("flushed"))
    live = replayed(ev, "test-wide", lambda s: bounded_panes_stream(s, ["s"], ["s", "k"], H, H, H, 3 * H), 2)
    a = _rows(batch, cols)
    assert {r[0] for r in a} == {None, 2 ** 60, 2 ** 60 + 1, 2 ** 60 + 2} and a == _rows(live, cols)


def test_a_repeated_batch_of_the_text_sink_changes_nothing(spark):
    out, ckpt = scratch_dir(spark, "text"), scratch_dir(spark, "text-ckpt")
    kept = []

    def run(sdf):
        panes = bounded_panes_stream(sdf, ["event_type"], ["event_type"], H, H, H, 3 * H)
        finish(write_panes_stream(panes, out, ckpt))
        kept.append(read_panes_text(spark, out).count())

    feed(event_stream(spark, SF_SMALL, "event_type"), 2, run)
    before = _rows(read_panes_text(spark, out), ["wstart", "wend", "cnt", "lag"])
    assert 0 < kept[0] < kept[1] == len(before)
    # the sink is asked to write batch 1 again, as after a failure before its commit
    from driftmark.sources.text import write_panes
    parsed = read_panes_text(spark, f"{out}/batch=1").select("wstart", "wend", "cnt", "lag")
    rows = spark.createDataFrame(parsed.collect(), parsed.schema)
    write_panes(rows, f"{out}/batch=1", "text")
    assert rows.count() == kept[1] - kept[0] and _rows(read_panes_text(spark, out), ["wstart", "wend", "cnt", "lag"]) == before


def test_time_lag_policy_without_events():
    """Ticks that no event brings: the first that reaches an open end."""
    p = P.TimeLagPolicy(100, 200)
    p.before(0, 450)
    assert p.wm == 300 and p.wait([]) is None
    for wend in (301, 302, 500, 501, 700, 12_345):
        want = next(k * 200 - 100 for k in range(2, 200) if k * 200 - 100 >= wend - 1)
        assert p.fired(wend) == want
    assert p.wait([500, 900]) == 600 - 450  # the tick at 600 gives 500
    p.expire([500, 900])
    assert p.wm == 500 and p.wait([900]) == 1000 - 600


def test_state_does_not_name_classes():
    """What is kept between batches is numbers only, so a checkpoint outlives
    a renamed class."""
    for make in (lambda: P.BoundedPolicy(5, 10), lambda: P.TimeLagPolicy(5, 10), P.MarkerPolicy, lambda: P.AdaptivePolicy(AdaptiveParams())):
        a = make()
        a.before(3, 4)
        row = a.dump()
        assert len(row) == len(a.SCHEMA.split(", "))
        assert all(v is None or isinstance(v, (int, float, list)) for v in row)
        b = make()
        b.load(row)
        assert b.dump() == row and b.wm == a.wm
