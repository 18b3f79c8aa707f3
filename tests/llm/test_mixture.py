import numpy as np
import pytest
from cases import ROWS, awkward, empty, rows

from driftmark.llm import mixture


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by repeated sharing of the excess; sources in order."""
    total, t = share * sum(sizes.values()), {}
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    t = dict.fromkeys(names, 0.0)
    open_ = set(names)
    left = total
    while open_ and left > 1e-9:
        sum_w = sum(w[s] for s in open_)
        give = {s: left * w[s] / sum_w for s in open_}
        for s, g in give.items():
            t[s] += g
        left = 0.0
        for s in list(open_):
            if t[s] >= cap * sizes[s]:
                left += t[s] - cap * sizes[s]
                t[s] = cap * sizes[s]
                open_.discard(s)
    return t


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 10, "d": 3, None: 77}, {"a": 0, "b": 0}, {"b": 10},
    {"\U0001f600": 50, "￮": 90, "z": 10, "Z": 400, "": 33, None: 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixture.targets(df).collect()}
    want = filled(sizes)
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def test_flight_keeps_totals_and_chances():
    r = np.random.default_rng(2)
    size = r.integers(0, 500, 41)
    p = r.random(41)
    mean = np.zeros(41)
    for k in range(2000):
        out = mixture.fly(p, size, np.random.default_rng(k))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)
        mean += out
    assert np.abs(mean / 2000 - p).max() < 0.06
    same = mixture.fly(np.full(10, 0.3), np.full(10, 7), np.random.default_rng(0))
    assert ((same > 0) & (same < 1)).sum() <= 1 and same.sum() == pytest.approx(3)


@pytest.mark.parametrize("block", [32, 2048])
def test_copies(spark, monkeypatch, block):
    monkeypatch.setattr(mixture, "BLOCK", block)
    r = np.random.default_rng(3)
    docs = [(i, " ".join(["w"] * int(r.integers(0, 60))), str(r.choice(["a", "b", "c", "d"], p=[.6, .2, .1, .1]))) for i in range(900)]
    docs += [(i, "x y z", None) for i in range(900, 960)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = rows(mixture.copies(df))
    again = rows(mixture.copies(df.repartition(7)))
    assert got == again and len(got) == len(docs)
    per = {}
    for _, s, size, total, target, n in got:
        assert 0 <= n <= 2
        a = per.setdefault(s, [0, 0, total, target])
        a[0], a[1] = a[0] + size, a[1] + n * size
    for size, taken, total, target in per.values():
        assert size == total and abs(taken - target) <= 2 * 60


def test_mix_repeats_rows(spark):
    df = awkward(spark).withColumnRenamed("copies", "times")
    took = {}
    for r in mixture.copies(df).collect():
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + r["copies"]
    got = mixture.mix(df)
    assert got.columns == df.columns
    count = {}
    for r in got.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {d: n for d, n in took.items() if n}
    assert len(mixture.copies(df).collect()) == len(ROWS)
    assert mixture.copies(empty(spark)).collect() == [] and mixture.mix(empty(spark)).collect() == []
