import random

import numpy as np
import pytest
from cases import ROWS, awkward, empty
from pyspark.sql import functions as F

from driftmark.llm import langid

ALPHABETS = {"aa": "abcdefg", "bb": "fghijkl", "cc": "мнопрст"}


def corpus(n=240, seed=9):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(ALPHABETS))
        t = " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(2, 8))) for _ in range(r.randint(3, 60)))
        out.append((i, t.upper() if r.random() < 0.3 else t, lang))
    return out


def test_held_out_accuracy(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = langid.identify(df, ["doc_id"]).select("*", langid.held_out(F.col("doc_id")).alias("out")).collect()
    want = {d: lang for d, _, lang in docs}
    out = [r for r in got if r["out"]]
    assert len(got) == len(docs) and 30 < len(out) < 90
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert all(0 < r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    df = spark.createDataFrame(corpus(120), "doc_id long, text string, lang string")
    other = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify(x, ["doc_id"]).collect())) for x in (df, other))
    assert a == b


def slow_counts(text):
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = " " + "".join(c for i, c in enumerate(s) if not (c == " " and (i == 0 or s[i - 1] == " "))) + " "
    return s


def test_counts_cover_whole_texts(monkeypatch):
    at, n = langid.counts("Ab1 çd!")
    assert n.sum() == 3 * len(slow_counts("Ab1 çd!")) - 3
    long = "héllo wörld " * 5000
    a, n = langid.counts(long)
    monkeypatch.setattr(langid, "PIECE", 1000)
    b, m = langid.counts(long)
    assert (a == b).all() and (n == m).all()
    assert langid.counts("123 !?") is None and langid.counts("") is None


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(300):
        y = int(r.integers(2))
        at = np.sort(r.choice(np.arange(10 + 40 * y, 50 + 40 * y), 5, replace=False))
        xs.append((at, np.full(5, 5 ** -0.5)))
        ys.append(y)
    w, b = langid.fit_ftrl(xs, ys, 2, 1000)
    assert (np.abs(w[200:]).sum() == 0) and np.mean([(x @ w[at] + b).argmax() == y for (at, x), y in zip(xs, ys, strict=True)]) > 0.98


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    p = r.uniform(0.5, 0.95, 4000)
    ys = (r.random(4000) > p).astype(int)
    z = np.log(p / (1 - p))[:, None] * np.array([[1.0, 0.0]]) * 4  # four times too sure
    assert langid.temperature(z, ys) == pytest.approx(4, rel=0.15)


def test_awkward(spark):
    df = awkward(spark)
    got = langid.identify(df, df.columns)
    assert got.columns == [*df.columns, "lang_pred", "score"]
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert got.count() == len(ROWS)
    for d in (2, 3, 4, 7, -4):
        assert by[d] == ("und", 0.0)
    assert by[1][0] in {"en", "de", "fr"}
    assert langid.identify(empty(spark), ["doc_id"]).collect() == []
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
