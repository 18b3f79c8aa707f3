import itertools
import random
import zlib

import pytest
from cases import ROWS, awkward, empty
from pyspark.sql import functions as F

from driftmark.llm import reshard
from driftmark.session import scratch_dir


def cheapest(supply, demand, cost):
    """Least cost by trying every split of small supplies, unit by unit."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    slots = [j for j, d in enumerate(demand) for _ in range(d)]
    return min(sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(slots)))


def test_flow_is_cheapest():
    r = random.Random(3)
    for _ in range(60):
        n, m = r.randint(1, 4), r.randint(1, 4)
        units = r.randint(1, 6)
        supply, demand = [0] * n, [0] * m
        for _ in range(units):
            supply[r.randrange(n)] += 1
            demand[r.randrange(m)] += 1
        cost = [[r.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = reshard.min_cost_flow(supply, demand, cost)
        assert [sum(f) for f in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == demand
        assert sum(f * c for a, b in zip(flow, cost, strict=True) for f, c in zip(a, b, strict=True)) == cheapest(supply, demand, cost)


def test_fewest_bytes_move():
    supply = [1000, 50, 700, 0, 9]
    flow = reshard.min_cost_flow(supply, reshard.even(sum(supply), 7), reshard.moving_cost(5, 7))
    want = reshard.even(sum(supply), 7)
    assert sum(flow[i][j] for i in range(5) for j in range(7) if i != j) == sum(max(0, s - w) for s, w in zip(supply, want, strict=False))


@pytest.mark.parametrize("block", [16, 16_384])
def test_assign_and_rewrite(spark, monkeypatch, block):
    monkeypatch.setattr(reshard, "BLOCK_ROWS", block)
    r = random.Random(4)
    docs = [(i, "x" * r.randint(0, 200)) for i in range(1500)] + [(7, "x"), (7, "x"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = F.coalesce(F.pmod("doc_id", F.lit(5)), F.lit(0))
    placed = reshard.assign(df, old, 5, 8).collect()
    assert sorted((p["doc_id"] is None, p["doc_id"], p["size"]) for p in placed) == sorted((d is None, d, len(t or "") + 1) for d, t in docs)
    by = {s: [p for p in placed if p["shard"] == s] for s in range(8)}
    mean = sum(p["size"] for p in placed) / 8
    for rows in by.values():
        assert sorted(p["slot"] for p in rows) == list(range(len(rows)))
        assert abs(sum(p["size"] for p in rows) - mean) <= 5 * 201
    moved = sum(p["size"] for p in placed if p["old"] != p["shard"])
    assert moved <= 3 * mean + 5 * 8 * 201  # only what the three new shards need
    got = reshard.reshard(df, old, 5, 8).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"], x["text"] or "", x["shard"], x["slot"]) for x in got) == sorted(
        (d, i, t, s, n) for (d, i, t), (s, n) in zip(
            sorted((p["doc_id"] is None, p["doc_id"], "x" * (p["size"] - 1)) for p in placed),
            [(p["shard"], p["slot"]) for p in sorted(placed, key=lambda p: (p["doc_id"] is None, p["doc_id"], p["size"], p["shard"], p["slot"]))],
            strict=True))
    assert all(p["text_crc32"] == zlib.crc32(b"x" * (p["size"] - 1)) for p in placed)


def test_unaffected_shards_are_left_alone(spark):
    df = spark.createDataFrame([(i, "y" * 9) for i in range(40)], "doc_id long, text string")
    placed = reshard.cut(reshard.assign(df, F.pmod("doc_id", F.lit(4)), 4, 5, capacities=[100, 100, 50, 100, 50]), "p")
    assert {r["shard"] for r in reshard.affected(placed).collect()} == {2, 4}
    folder = scratch_dir(spark, "aff")
    reshard.write_shards(df, placed, folder, only_affected=True)
    assert {r["shard"] for r in spark.read.parquet(folder).select("shard").distinct().collect()} == {2, 4}


def test_awkward(spark):
    got = reshard.reshard(awkward(spark), F.pmod("doc_id", F.lit(3)), 3, 2).collect()
    assert len(got) == len(ROWS) and {r["own"] for r in [{"own": x["size"]} for x in got]} == {"own size"}
    assert reshard.reshard(empty(spark), F.lit(0), 1, 3).collect() == []
    with pytest.raises(ValueError):
        reshard.assign(awkward(spark), F.lit(0), 1, 2, capacities=[1, 2])
    with pytest.raises(ValueError):
        reshard.assign(awkward(spark), F.lit(4), 2, 2)
