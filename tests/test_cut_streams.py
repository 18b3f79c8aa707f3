"""Sweep queries on streams that are cut into many blocks, against their oracles."""

import duckdb
import pytest
from pyspark.sql import functions as F

from driftmark.functions import scan
from driftmark.plans.catalog import ORACLES, QUERIES
from oracle_compare import compare


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """Events about four minutes apart, in three streams, so
    that a stream has as many spans of windows as events."""
    path = tmp_path_factory.mktemp("sparse")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(i * 240000 + i * 7919 % 1000) AS ts,
        i % 7 AS user_id, CASE i % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS event_type, i % 17 * 1.25 AS value
        FROM range(1200) r(i)) TO '{path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet')")
    return str(path), con


@pytest.mark.parametrize("name", ["compare_runs", "pending_runs", "run_report", "compare_all_runs", "sweep_adaptive", "sweep_periodic"])
def test_streams_of_many_blocks(spark, sparse, monkeypatch, name):
    """The names of columns inside ``depth_blocks`` met those of what it cuts."""
    path, con = sparse
    monkeypatch.setattr(scan, "TARGET_ROWS", 40)
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], path)
    assert r["ok"] and r["rows"][0], r


@pytest.mark.parametrize("order", ["__b", "__slot", "__n", "__c", "__lo0", "__before", "__dk"])
def test_any_order_column_can_be_cut_by(spark, order):
    """What is cut keeps its columns, whatever their names."""
    df = spark.range(500).select(F.lit("a").alias("k"), (F.col("id") * 3).alias(order))
    got = scan.depth_blocks(df, ["k"], [order], target=20)
    assert got.columns == ["k", order, "__path"]
    rows = sorted((r[order], r["__path"]) for r in got.collect())
    assert [r[0] for r in rows] == [i * 3 for i in range(500)]
    assert [r[1] for r in rows] == sorted(r[1] for r in rows) and len({tuple(r[1]) for r in rows}) > 10
