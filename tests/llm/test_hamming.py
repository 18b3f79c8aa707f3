import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import hamming


def brute(vecs, k, bits):
    code = {}
    for i, v in vecs:
        if v is not None:
            c = np.zeros(bits, bool)
            c[:len(v)] = [x is not None and x > 0 for x in v]
            code[i] = c
    out = []
    for q in code:
        if q is not None and q % 20 == 0:
            near = sorted(((int((code[q] != c).sum()), i is not None, i or 0, i) for i, c in code.items()))[:k]
            out += [(q, n + 1, x[3], x[0]) for n, x in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,n,k,block", [(64, 600, 10, 128), (20, 300, 3, 1 << 15), (8, 200, 7, 16), (64, 5, 10, 4)])
def test_equals_brute_force(spark, monkeypatch, bits, n, k, block):
    monkeypatch.setattr(hamming, "INDEX_BLOCK", block)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 8)
    monkeypatch.setattr(hamming, "PROBES", 1000)
    r = np.random.default_rng(bits)
    centres = r.normal(size=(5, bits))
    vecs = [(i, (centres[i % 5] + r.normal(size=bits) * r.choice([0, 0.5, 2])).tolist()) for i in range(n)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("id", F.lit("own"))
    got = hamming.top_k(df, F.col("id") % 20 == 0, k).collect()
    assert sorted(map(tuple, got), key=repr) == brute(vecs, k, bits)


def test_awkward(spark):
    vecs = [(0, [1.0, -1.0]), (20, None), (1, [float("nan"), None]), (2, []), (None, [1.0]), (3, [1.0, -2.0, 0.0]), (40, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([*vecs, vecs[0]], "vec_id long, embedding array<float>")
    got = hamming.top_k(df, F.col("id") % 20 == 0, 4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(vecs, 4, 8)
    assert hamming.top_k(df.where(F.lit(False)), F.col("id") % 20 == 0).collect() == []
