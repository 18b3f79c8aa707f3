import random

import numpy as np
from cases import LONG, awkward, empty

from driftmark.llm import chunks
from driftmark.llm.common import letters

CODE = (letters() >> np.uint64(48)).astype(np.uint16)


def buf(b):
    return np.frombuffer(b, dtype=np.uint8)


def test_gear_is_the_rolling_hash():
    b, h = random.Random(5).randbytes(300), 0
    for i, x in enumerate(b):
        h = (2 * h + int(CODE[x])) % (1 << 16)
        assert chunks.gear(buf(b))[i] == h


def slow_ends(b, reach, longest):
    h, out, last = [], [], 0
    for i, x in enumerate(b):
        h.append((2 * (h[-1] if h else 0) + int(CODE[x])) % (1 << 16))
    cuts = [i + 1 for i in range(reach, len(b) - reach)
            if h[i] > max(h[i - reach:i]) and h[i] >= max(h[i + 1:i + 1 + reach])]
    for c in sorted({*cuts, len(b)}):
        while c - last > longest:
            last += longest
            out.append(last)
        out.append(c)
        last = c
    return out


def test_ends_equal_the_definition():
    r = random.Random(6)
    for n in (1, 2, 23, 24, 25, 48, 49, 50, 500, 3000):
        for b in (r.randbytes(n), b"\0" * n, bytes(r.choice(b"ab") for _ in range(n))):
            for reach in (24, 7, 16):
                assert chunks.ends(buf(b), reach, 100).tolist() == slow_ends(b, reach, 100)
    assert chunks.ends(buf(b"")).tolist() == []


def test_an_insertion_changes_few_chunks():
    b = LONG[:20_000].encode()
    parts = lambda x: {x[i:j] for i, j in zip([0, *chunks.ends(buf(x))[:-1].tolist()], chunks.ends(buf(x)).tolist(), strict=True)}
    a, c = parts(b), parts(b[:9000] + b"inserted" + b[9000:])
    assert len(a - c) <= 6


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


def test_planted_passages(spark):
    r = random.Random(7)
    passage = words(r, 55)
    docs = [(i, words(r, 200)) for i in range(40)]
    docs += [(100 + i, f"{words(r, 30 + i)} {passage} {words(r, 40)}") for i in range(10)]
    docs += [(200, docs[3][1]), (201, docs[4][1][:500] + "!" + docs[4][1][500:])]
    got = {x["doc_id"]: x for x in chunks.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {*range(101, 110), 200, 201}
    assert all(got[i]["first_docs"] == [100] and got[i]["n_spans"] == 1 for i in range(101, 110))
    assert got[200]["n_removed"] == len(docs[3][1]) and got[200]["first_docs"] == [3]
    assert got[201]["first_docs"] == [4] and got[201]["n_removed"] >= len(docs[4][1]) - 200
    shifts = chunks.repeats(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 201").count()
    assert shifts == 2


def test_removed_stretches_are_copies(spark):
    """Every stretch reported occurs, byte for byte, in the earlier document."""
    r = random.Random(8)
    pool = [words(r, 30) for _ in range(5)]
    docs = [(i, " ".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for i in range(50)]
    text = {d: t.encode() for d, t in docs}
    for x in chunks.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        edge = [0, *chunks.ends(buf(text[x["doc_id"]])).tolist()]
        own = text[x["doc_id"]][edge[x["first_chunk"]]:edge[x["first_chunk"] + x["n_chunks"]]]
        assert len(own) == x["n_bytes"] and own in text[x["first_doc"]] and x["first_doc"] < x["doc_id"]


def test_awkward(spark):
    assert {r["doc_id"] for r in chunks.deduplicate(awkward(spark)).collect()} == set()
    twice = awkward(spark).union(spark.createDataFrame([(50, LONG, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
                                 .select("*", *[awkward(spark)[c] for c in []]).selectExpr("*", *[f"'x' AS `{c}`" for c in awkward(spark).columns[5:]]))
    got = chunks.deduplicate(twice).collect()
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(50, len(LONG))]
    assert chunks.deduplicate(empty(spark)).collect() == []


def test_a_copy_of_recurring_lines_goes_whole(spark):
    """Every repetition of the line has its first place in the first one."""
    text = "the same short line of a list, ever so often\n" * 40
    got = chunks.deduplicate(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in got] == [(2, len(text), 1, [1])]


def test_first_places_in_different_documents(spark):
    """Chunks of the copy stood in other documents before: each in one of its
    own, alone or nearly so, but every one in document 100."""
    text = words(random.Random(9), 300)
    edge = [0, *chunks.ends(buf(text.encode())).tolist()]
    docs = [(i, f"{i:030d}{text[max(0, a - 60):b + 60]}{i:030d}") for i, (a, b) in enumerate(zip(edge[:-1:3], edge[1::3]))]
    docs += [(100, text), (101, text)]
    got = {x["doc_id"]: x for x in chunks.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[101]["n_removed"] == len(text) and got[101]["n_spans"] == 1
    assert 100 in got[101]["first_docs"]


def test_chunks_apart_do_not_add_up(spark):
    """Single short repeats between new text stay."""
    r = random.Random(10)
    text = words(r, 300)
    parts = [text[i:i + 40] for i in range(0, 400, 40)]
    docs = [(1, text), (2, "".join(words(r, 20) + p for p in parts))]
    assert chunks.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect() == []


def test_digests_have_two_words():
    b = b"one chunk and another chunk and"
    d = chunks.digests(b, np.array([10, 20, len(b)]))
    assert d.shape == (3, 2) and len({*d.ravel().tolist()}) == 6
