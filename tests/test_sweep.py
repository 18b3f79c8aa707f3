"""The sweep against single runs, and what it leaves on disk."""

import pytest
from pyspark.sql import functions as F

RUNS = [dict(run=f"r{i}", period=p, max_ooo=o, width=w, allowed=a)
        for i, (p, o, w, a) in enumerate([(200, 0, 100, 5_000), (200, 900, 1000, 0), (10, 100, 100, 700), (10, 900, 1000, 5_000), (30, 100, 7, 50)])]


def _noisy(spark, n=3000):
    """Events out of order, of streams with a NULL key, some without an
    arrival time or an event time, some twice."""
    import random
    r = random.Random(5)
    rows = []
    for i in range(n):
        t = r.randrange(20_000)
        rows.append((i, t if r.random() > 0.02 else None, t + r.randrange(3_000) if r.random() > 0.02 else None, r.choice(["a", "b", None])))
    return spark.createDataFrame(rows + rows[:200], "seq long, t long, arr long, k string")


@pytest.mark.parametrize("keys,rows_a_block", [(["k"], 1 << 18), (["k"], 100), ([], 100)])
def test_sweep_equals_each_run_by_itself(spark, monkeypatch, keys, rows_a_block):
    """Runs of the sweep against one run at a time, in one block and in many."""
    from driftmark.functions import scan
    from driftmark.plans.runs import bounded_panes
    from driftmark.plans.sweep import sweep_periodic_panes
    monkeypatch.setattr(scan, "TARGET_ROWS", rows_a_block)
    ev = _noisy(spark)
    cols = [*keys, "wstart", "wend", "cnt", "lag", "flushed", "late_fire"]
    all_ = sweep_periodic_panes(ev, RUNS, keys, keys).collect()
    for i, c in enumerate(RUNS):
        one = bounded_panes(ev, keys, keys, c["max_ooo"], c["period"], c["width"], c["allowed"])
        want = sorted((tuple(r) for r in one.select(*cols).collect()), key=repr)
        assert want and sorted((tuple(r[x] for x in cols) for r in all_ if r.cfg == i), key=repr) == want


def test_sweep_keeps_less_than_the_panes(spark, tmp_dir):
    """what the sweep and its text leave on disk is a fraction of the lines,
    and nothing stays cached."""
    import os

    from driftmark.plans.sweep import finish_runs, sweep_periodic_panes, with_config
    from driftmark.session import checkpoint_root
    from driftmark.sources.text import read_panes_text
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
    root = checkpoint_root(spark).removeprefix("file:")
    ev = spark.range(60_000).select(F.col("id").alias("seq"), (F.col("id") * 7).alias("t"),
                                    (F.col("id") * 7 + F.col("id") * 7919 % 1009 * 40).alias("arr"))
    grid, before = [c | dict(allowed=10 ** 6) for c in RUNS], size(root)
    panes = with_config(sweep_periodic_panes(ev, grid, [], []), grid, ["run"])
    finish_runs(panes, grid, tmp_dir)
    got = read_panes_text(spark, tmp_dir)
    lines = got.count()
    assert lines > 200_000
    assert size(tmp_dir) < 20 * lines and size(root) - before < 20 * lines
    assert not spark.sparkContext._jsc.getPersistentRDDs()
