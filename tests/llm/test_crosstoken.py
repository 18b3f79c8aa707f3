"""Cross-tokenizer alignment against the tokenizers themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, empty, rows
from conftest import SF_SMALL
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from driftmark.llm import crosstoken as C
from driftmark.llm.common import table
from driftmark.llm.queries import QUERIES

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """``text -> (n_a, n_b, n_groups, linked pairs, hash)`` from whole texts."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B)
    ba, bb = C.token_bytes_a(A), C.token_bytes_b(sp)

    def ends(ids, table_):
        at, out = 0, {}
        for k, i in enumerate(ids):
            at += len(table_[i])
            out[at] = k
        return out

    def run(text):
        if not text:
            return 0, 0, 0, [], ""
        ia, ib = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        whole = (" " + text).encode()
        if b"".join(ba[i] for i in ia) != whole or b"".join(bb[i] for i in ib) != whole:
            return 0, 0, 0, [], ""
        ea, eb = ends(ia, ba), ends(ib, bb)
        groups, pairs, i, j = [], [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            groups.append(",".join(map(str, ia[i:ea[e] + 1])) + "|" + ",".join(map(str, ib[j:eb[e] + 1])))
            pairs.append((ib[eb[e]], ia[ea[e]]))
            i, j = ea[e] + 1, eb[e] + 1
        return len(ia), len(ib), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()
    return run


def brute(plain, docs):
    got = [(d, plain(t)) for d, t in docs]
    count = Counter(p for _, g in got for p in g[3])
    top = Counter()
    for (b, _), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((d, g[0], g[1], g[2], len(g[3]), sum(count[p] == top[p[0]] for p in g[3]), sum(count[p] for p in g[3]), g[4])
                   for d, g in got), key=repr), count, top


PARTS = ["a", "b", " ", " ", " ", "  ", "\n", "\t", "'s", "'", "é", "ü", "▁", "<s>", "<|endoftext|>", "<0x41>", "\x00", "\x85",
         "\xa0", " ", "​", "﻿", "\U0001f600", "é", "ﬁ", "1", "23", ".", "!!", "the", "ing", "\x1c", "\r\n",
         "ß", "中", "文", "İ", "<unk>", "</s>", "=", "    ", "_"]


def test_pieces_equal_whole_texts(plain):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    align = C.Aligner(A, B)
    for k in range(0, len(texts), 400):
        sizes, pairs, hashes = align(texts[k:k + 400])
        at = 0
        for t, size, h in zip(texts[k:k + 400], sizes.tolist(), hashes, strict=True):
            want = plain(t)
            own = [(p >> align.a_bits, p & ((1 << align.a_bits) - 1)) for p in pairs[at:at + size[2]].tolist()]
            assert (*size, own, h) == want, t
            at += size[2]


def test_query_equals_brute_force(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    assert rows(QUERIES["op11_cross_tokenizer"](spark, SF_SMALL)) == brute(plain, docs)[0]


def test_awkward_and_empty(spark, plain):
    df = awkward(spark)
    found, counts = C.align(df, A, B)
    want, count, top = brute(plain, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert rows(found) == want
    assert rows(C.pair_table(counts)) == sorted(((a, b, n, n == top[b]) for (b, a), n in count.items()), key=repr)
    assert rows(C.align(empty(spark), A, B)[0]) == []


def test_many_chunks_and_levels(spark, plain, monkeypatch):
    """Chunks of a few documents, three runs a merge: the workers' bounds
    change nothing.  (Chunk bounds are read in the workers.)"""
    docs = [(i, f"word{i % 7} the cat, said {i % 3}\n ok") for i in range(60)] + [(100, None), (100, "▁")]
    monkeypatch.setattr(C, "FAN", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert rows(C.align(df, A, B)[0]) == brute(plain, docs)[0]


def test_merge_and_maxima():
    rnd = np.random.default_rng(5)
    runs = []
    for _ in range(5):
        p = np.unique(rnd.integers(0, 1 << 20, 70_000))
        runs.append((p, rnd.integers(1, 9, len(p))))
    want = Counter()
    for p, c in runs:
        for x, y in zip(p.tolist(), c.tolist(), strict=True):
            want[x] += y
    top = Counter()
    for x, n in want.items():
        top[x >> 4] = max(top[x >> 4], n)
    got = [np.concatenate(c).tolist() for c in zip(*C.maxima(C.merge(runs), 4), strict=True)]
    assert list(zip(*got, strict=True)) == [(x, n, int(n == top[x >> 4])) for x, n in sorted(want.items())]
    assert list(C.merge([])) == []
