import hashlib
import random

import numpy as np
import pytest
from cases import ROWS, awkward, empty

from driftmark.llm import suffix


def brute(docs, length):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by a table of all windows."""
    first, out = {}, []
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = {b[i:i + length] for i in range(len(b) - length + 1)}
        for i in range(len(b) - length + 1):
            if b[i:i + length] in first:
                gone[i:i + length] = b"\1" * length
        for w in own:
            first.setdefault(w, d)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cover_has_every_difference():
    c = suffix.COVER
    assert {(a - b) % suffix.V for a in c for b in c} == set(range(suffix.V))


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    parts, docs = [text(r.randint(40, 200)) for _ in range(6)], []
    for i in range(60):
        t = text(r.randint(0, 120)) + r.choice(parts)[r.randint(0, 30):] + text(r.randint(0, 30)) + r.choice(parts)
        docs.append((i, r.choice([t, t, t + t, docs[-1][1] if docs else t, "ab" * 90, None])))
    return docs


@pytest.mark.parametrize("seed,block", [(0, 400), (1, 2000), (2, 1 << 23)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 64)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix.spans(df, 50).collect())) == brute(docs, 50)


def test_kept_text(spark):
    t = "x" * 30 + "a long shared passage of more than fifty bytes, seen twice"
    got = dict(map(tuple, suffix.kept_text(spark.createDataFrame([(1, t), (2, "new " + t[30:])], "doc_id long, text string"), 50).collect()))
    assert got == {1: t, 2: "new "}


def test_awkward(spark):
    got = suffix.spans(awkward(spark), 50).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert by[2] == by[3] == [(0, 0)] and by[4] == [(4, 0)]
    assert by[8][0][1] == 0 and by[-4] == [(5000, 0)]
    assert by[5] == [(45, 0)] * 2  # shorter than 50
    assert suffix.spans(empty(spark), 50).collect() == []


def test_length_must_exceed_two_periods():
    with pytest.raises(ValueError):
        suffix.Plan(10, 2 * suffix.V)


def test_repeated_ids_keep_one(spark):
    t = "some text that is long enough to be removed when it is seen again"
    got = suffix.spans(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string"), 50).collect()
    assert sorted(r["n_removed"] for r in got) == [0, len(t)]
    assert np.all([r["n_bytes"] == len(t) for r in got])
