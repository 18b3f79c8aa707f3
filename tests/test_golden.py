"""Golden cases taken from the reference's own hand-made inputs (FIXTURES.md §2)."""

import os

from pyspark.sql import functions as F

from driftmark.operators.watermarks import marker_watermark
from driftmark.operators.windows import session_windows
from driftmark.plans.analysis import compare_runs
from driftmark.plans.sweep import (adaptive_grid, adaptive_run_name, parse_run_name,
                                   periodic_grid, periodic_run_name)
from driftmark.sources.text import (marked_stream, read_marked_events, read_panes_text,
                                    read_timed_values)


def _write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_session_gap_100(spark):
    # assigned event times in arrival order; payload times differ on purpose
    rows = [(0, 10), (1, 15), (2, 70), (3, 200), (4, 195)]
    df = spark.createDataFrame(rows, "seq long, t long").withColumn("arr", F.col("seq"))
    out = sorted(tuple(r) for r in session_windows(df, [], 100).collect())
    assert out == [(10, 170, 3), (195, 300, 2)]


def test_session_touching_events_merge(spark):
    df = spark.createDataFrame([(0, 0), (1, 100)], "seq long, t long")
    assert session_windows(df, [], 100).count() == 1


def test_marked_events(spark, tmp_dir):
    _write(tmp_dir, "m.txt", ["* comment", "10,a,1.5", "70,a,2.5", "70,W,0", "60,a,3.0",
                              "200,b,4.0", "150,W,0"])
    ev, mk, _ = marked_stream(read_marked_events(spark, tmp_dir))
    out = {(r.t, r.key): (r.wm_before, r.late)
           for r in marker_watermark(ev, mk).collect()}
    assert len(out) == 4
    assert out[(60, "a")] == (70, True)
    assert out[(200, "b")] == (70, False)
    assert out[(10, "a")] == (0, False)
    assert mk.agg(F.max("t")).first()[0] == 150


def test_marked_events_dummy_key_and_fill(spark, tmp_dir):
    _write(tmp_dir, "m.txt", ["5", "6,x,", "7,k,2.0"])
    rows = {r.line: r for r in read_marked_events(spark, tmp_dir).collect()}
    assert rows[1].key == "DUMMY" and rows[1].value == 20.0
    assert rows[2].key == "DUMMY"          # "6,x," splits to two fields in Java
    assert rows[3].key == "k" and rows[3].value == 2.0


def test_timed_values_two_fields_or_fill(spark, tmp_dir):
    _write(tmp_dir, "v.txt", ["100,1.5", "200", "300,2.5,9", "x,1", "400,"])
    rows = {r.line: r for r in read_timed_values(spark, tmp_dir).collect()}
    assert (rows[1].ts, rows[1].value, rows[1].bad) == (100, 1.5, False)
    assert (rows[2].ts, rows[2].value) == (200, 20.0)
    assert (rows[3].ts, rows[3].value) == (300, 20.0)
    assert rows[4].bad
    assert (rows[5].ts, rows[5].value) == (400, 20.0)


def test_seeded_noise_fill_is_deterministic(spark, tmp_dir):
    _write(tmp_dir, "v.txt", [str(i) for i in range(2000)])
    a = read_timed_values(spark, tmp_dir, noise=5.0, seed=3).orderBy("line").collect()
    b = read_timed_values(spark, tmp_dir, noise=5.0, seed=3).repartition(7).orderBy("line").collect()
    assert [r.value for r in a] == [r.value for r in b]
    vals = [r.value for r in a]
    mean = sum(vals) / len(vals)
    assert 19.5 < mean < 20.5
    assert all(round(v, 2) == v for v in vals)


def test_line_numbers_across_files(spark, tmp_dir):
    _write(tmp_dir, "a.txt", [f"{i},1.0" for i in range(0, 500)])
    _write(tmp_dir, "b.txt", [f"{i},1.0" for i in range(500, 900)])
    rows = read_timed_values(spark, tmp_dir).orderBy("line").collect()
    assert [r.line for r in rows] == list(range(1, 901))
    assert [r.ts for r in rows] == list(range(900))


def test_pane_text(spark, tmp_dir):
    _write(tmp_dir, "eventsPeriodicL-100P-10W-100.txt",
           ["(TimeWindow{start=0, end=100},3,4)", "(TimeWindow{start=0, end=100},4,50)",
            "(TimeWindow{start=100, end=200},2,9223372036854775607)"])
    panes = read_panes_text(spark, tmp_dir)
    assert panes.where("flushed").count() == 1
    rep = compare_runs(spark, tmp_dir).collect()
    assert len(rep) == 1
    r = rep[0]
    assert (r.windows, r.elements, r.mean_lag, r.not_processed) == (1, 4, 4.0, 2)
    assert (r.dataset, r.approach, r.lateness, r.period, r.width) == ("events", "Periodic", 100, 10, 100)


def test_run_names_round_trip(spark):
    grid = adaptive_grid("d") + periodic_grid("d")
    assert len(grid) == 26
    assert adaptive_run_name("d", 1000, 0.1, 1.0, 0.01, 100) == "dAdaptiveL-1000OOO-0.1S-1.0SCR-0.01W-100.txt"
    assert periodic_run_name("d", 100, 10, 1000) == "dPeriodicL-100P-10W-1000.txt"
    df = spark.createDataFrame([(c["run"],) for c in grid], "run string")
    parsed = {r.run: r for r in df.select("run", *parse_run_name("run")).collect()}
    for c in grid:
        p = parsed[c["run"]]
        assert p.width == c["width"] and p.dataset == "d"
        if "period" in c:
            assert (p.approach, p.period, p.lateness, p.threshold) == ("Periodic", c["period"], c["max_ooo"], None)
        else:
            assert (p.approach, p.threshold, p.sensitivity, p.change_rate) == (
                "Adaptive", c["threshold"], c["sensitivity"], c["change_rate"])


def test_skip_finished_runs(spark, tmp_dir):
    """A run without panes is finished too, and finished runs stay as they are."""
    from driftmark.plans.sweep import finish_runs, finished_runs, pending_configs, sweep_periodic
    grid, path = periodic_grid("ev"), tmp_dir + "/runs"
    assert len(pending_configs(spark, grid, path)) == 8
    rows = [(i, i * 10 + 5, i * 10 + 7) for i in range(50)]
    ev = spark.createDataFrame(rows, "seq long, t long, arr long")
    finish_runs(sweep_periodic(ev, grid[:2], [], []), grid[:2], path)
    assert [c["run"] for c in pending_configs(spark, grid, path)] == [c["run"] for c in grid[2:]]
    before = {r.run: r.panes for r in finished_runs(spark, path).collect()}
    finish_runs(sweep_periodic(ev.where("false"), grid[2:3], [], []), grid[2:3], path)
    after = {r.run: r.panes for r in finished_runs(spark, path).collect()}
    assert after == before | {grid[2]["run"]: 0} and min(before.values()) > 0
    assert [c["run"] for c in pending_configs(spark, grid, path)] == [c["run"] for c in grid[3:]]
    assert spark.read.text(path).count() == sum(before.values())


def test_session_blocked_equals_builtin(spark):
    import random
    from driftmark.operators.windows import session_windows_builtin
    rnd = random.Random(4)
    rows, t = [], 0
    for i in range(4000):
        t += rnd.choice([1, 5, 50, 99, 100, 101, 400])
        rows.append((i, t, rnd.choice(["a", "b", "c"])))
    df = spark.createDataFrame(rows, "seq long, t long, k string")
    a = sorted(tuple(r) for r in session_windows(df, ["k"], 100).collect())
    b = sorted(tuple(r) for r in session_windows_builtin(df, ["k"], 100).collect())
    assert a == b


def test_timed_values_streaming_equals_batch(spark, tmp_dir):
    from driftmark.streaming.live import run_available_now
    _write(tmp_dir + "/in", "a.txt", ["100,1.5", "200", "300,2.5,9", "x,1", "400,"])
    _write(tmp_dir + "/in", "b.txt", ["500,7.25", "600"])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    batch = sorted(((r.ts, r.value, r.bad) for r in
                    read_timed_values(spark, tmp_dir + "/in").collect()), key=key)
    live = run_available_now(read_timed_values(spark, tmp_dir + "/in", streaming=True), "tv")
    assert sorted(((r.ts, r.value, r.bad) for r in live.collect()), key=key) == batch
    assert set(live.columns) >= {"file", "ts", "value", "bad"}
