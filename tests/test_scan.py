"""The blocked (two-level) scan equals a plain whole-partition window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftmark.functions.scan import Scan, blocked_scan
from driftmark.functions.time import floor_div


def test_blocked_scan_equals_window(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.randint(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    scans = [Scan("fmax", "v", "max"), Scan("fmax_x", "v", "max", inclusive=False),
             Scan("bmin", "v", "min", backward=True), Scan("bmin_x", "v", "min", backward=True,
                                                           inclusive=False),
             Scan("fsum", "v", "sum"), Scan("bsum_x", "v", "sum", backward=True, inclusive=False)]
    got = blocked_scan(df, ["k"], floor_div(F.col("o"), F.lit(37)), ["o"], scans)
    w = Window.partitionBy("k").orderBy("o")
    ref = df.select(
        "k", "o",
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("fmax"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("fmax_x"),
        F.min("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("bmin"),
        F.min("v").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("bmin_x"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("fsum"),
        F.coalesce(F.sum("v").over(w.rowsBetween(1, Window.unboundedFollowing)),
                   F.lit(0)).alias("bsum_x"))
    cols = ["k", "o", "fmax", "fmax_x", "bmin", "bmin_x", "fsum", "bsum_x"]
    key = lambda r: (str(r[0]), r[1])
    a = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    b = sorted((tuple(r) for r in ref.select(*cols).collect()), key=key)
    assert a == b


def _dense_sparse_bursty():
    """A stream with a row a second, one with a row an hour, one whose rows
    nearly all come within a millisecond, a small one and one without a key."""
    rnd, rows = random.Random(3), []
    rows += [("dense", 1000 * i + rnd.randrange(900), i) for i in range(6000)]
    rows += [("sparse", 3_600_000 * i * i, i) for i in range(3000)]
    rows += [("bursty", 10 ** 12 if i % 50 else i, i) for i in range(6000)]
    rows += [("small", i, i) for i in range(40)] + [(None, None if i < 5 else -7 * i, i) for i in range(2500)]
    rnd.shuffle(rows)
    return rows


def test_blocks_hold_about_the_target(spark):
    from driftmark.functions.scan import depth_blocks
    df = spark.createDataFrame(_dense_sparse_bursty(), "k string, o long, s long").repartition(5)
    got = depth_blocks(df, ["k"], ["o", "s"], target=250).collect()
    per, order = {}, {}
    for r in got:
        per[r.k, tuple(r["__path"])] = per.get((r.k, tuple(r["__path"])), 0) + 1
        order.setdefault(r.k, []).append(((r.o is not None, r.o or 0, r.s), r["__path"]))
    assert len(got) == 17_540 and max(per.values()) <= 500
    # and not many small ones
    assert len(per) <= 3 * 17_540 / 250
    for rows in order.values():
        paths = [p for _, p in sorted(rows)]
        assert paths == sorted(paths)
    assert "__path" not in depth_blocks(df, ["k"], ["o", "s"]).columns  # nothing exceeds the default


def test_tasks_hold_at_most_twice_the_default(spark, monkeypatch):
    """At the defaults: rows a task sorts, for 40 million rows of three kinds
    of streams (sizes from the block table, the rows themselves not kept)."""
    from driftmark.functions import scan
    n = 2_000_000
    df = spark.range(n).selectExpr(
        "case when id % 10 < 6 then 'dense' when id % 10 < 9 then 'bursty' else 'sparse' end as k",
        "case when id % 10 < 6 then id * 10 when id % 10 < 9 then 5 + id div 1000000 else id * 100000 end as o", "id as s")
    cut = scan.depth_blocks(df, ["k"], ["o", "s"])
    sizes = {tuple(r)[:2]: r["count"] for r in cut.selectExpr("k", "cast(__path as string) as p").groupBy("k", "p").count().collect()}
    assert max(sizes.values()) <= 2 * scan.TARGET_ROWS and sum(sizes.values()) == n
    assert len(sizes) <= 2 + 2 * n / scan.TARGET_ROWS


def test_scan_in_found_blocks_equals_window(spark):
    df = spark.createDataFrame(_dense_sparse_bursty(), "k string, o long, s long").repartition(5)
    scans = [Scan("n", "one", "sum"), Scan("m", "s", "max", inclusive=False), Scan("b", "s", "min", backward=True, inclusive=False)]
    x = df.withColumn("one", F.lit(1).cast("long"))
    got = blocked_scan(x, ["k"], None, ["o", "s"], scans, target=250)
    one = blocked_scan(x, ["k"], None, ["o", "s"], scans)
    assert got.columns == one.columns == ["k", "o", "s", "one", "n", "m", "b"]
    key = lambda r: (str(r[0]), r[2])
    a, b = (sorted(map(tuple, d.collect()), key=key) for d in (got, one))
    assert a == b
    w = Window.partitionBy("k").orderBy("o", "s")
    want = x.select("*", F.row_number().over(w).cast("long").alias("n"), F.max("s").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
                    F.min("s").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("b"))
    assert a == sorted(map(tuple, want.collect()), key=key)


def test_floor_div_negative(spark):
    df = spark.range(-7, 8).select(F.col("id").alias("a"))
    out = [(r.a, r.q) for r in df.select("a", floor_div("a", F.lit(3)).alias("q")).collect()]
    assert all(q == a // 3 for a, q in out)


def test_epoch_ms_and_text_ignore_session_zone(spark):
    from driftmark.functions.time import epoch_ms, gmt_text_ss
    from driftmark.sources.fixtures import table
    ev = table(spark, "/root/testdata/sf0.001", "events").select("event_id", "ts")
    base = {r.event_id: (r.t, r.txt) for r in ev.select(
        "event_id", epoch_ms("ts").alias("t"), gmt_text_ss(epoch_ms("ts")).alias("txt")).collect()}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        other = {r.event_id: (r.t, r.txt) for r in ev.select(
            "event_id", epoch_ms("ts").alias("t"), gmt_text_ss(epoch_ms("ts")).alias("txt")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other
    import datetime
    r = ev.orderBy("event_id").first()
    want = (r.ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(milliseconds=1)
    assert base[r.event_id][0] == want


def test_single_hot_key_spreads_over_tasks(spark):
    """All rows in one key: the level-1 window still runs in many tasks."""
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"),
                                     (F.col("id") % 97).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = blocked_scan(df, ["k"], floor_div(F.col("o"), F.lit(5_000)), ["o"],
                           [Scan("s", "v", "sum")])
        parts = out.select(F.spark_partition_id().alias("p")).distinct().count()
        last = out.orderBy(F.col("o").desc()).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert parts >= 4
    assert last.s == sum(i % 97 for i in range(200_000))


def test_checkpoint_root_is_stable(spark):
    from driftmark.session import checkpoint_root, materialize
    a = checkpoint_root(spark)
    materialize(spark.range(10))
    materialize(spark.range(10))
    assert checkpoint_root(spark) == a == spark.sparkContext.getCheckpointDir()


def test_flagship_scan_is_pruned_and_combined_map_side(spark):
    from driftmark.functions.time import window_start
    from driftmark.operators.watermarks import with_tick
    from driftmark.sources.fixtures import event_stream
    ev = event_stream(spark, "/root/testdata/sf0.001", "event_type")
    fine = (with_tick(ev, 3_600_000).withColumn("wstart", window_start("t", F.lit(3_600_000)))
            .groupBy("event_type", "tick", "wstart").agg(F.count(F.lit(1)).alias("n")))
    plan = fine._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan
    assert "partial_count" in plan
