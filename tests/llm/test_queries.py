"""The registered queries against SQL, and the pipeline stage by stage."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from oracle_compare import compare, duck
from pyspark.sql import functions as F
from test_decontam import least
from test_neardup import brute
from test_suffix import brute as brute_spans
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as C
from driftmark.llm import decontam, mixture
from driftmark.llm.common import cut, table
from driftmark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLES[name], SF_SMALL)["ok"]


def test_all_are_registered():
    got = E.queries()
    assert {int(n[2:].split("_")[0]) for n in got if n.startswith("op")} == set(range(1, 14))
    assert got["pipeline"] is C.run and [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]


def test_op2_equals_the_tokenizer(spark):
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_token_files"](spark, SF_SMALL).collect()}
    for r in table(spark, SF_SMALL, "documents").orderBy("doc_id").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert got.pop(r["doc_id"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_op4_equals_edit_distances(spark):
    got = sorted(map(tuple, QUERIES["op4_benchmark_leaks"](spark, SF_SMALL).collect()))
    items = [(r["item_id"], decontam.normal(r["text"])) for r in table(spark, SF_SMALL, "benchmark").collect()]
    want = []
    for r in table(spark, SF_SMALL, "documents").collect():
        x = decontam.normal(r["text"])
        for i, t in items:
            # an item within its budget has one of its pieces in the text
            if any(p in x for _, p in decontam.pieces(t, decontam.budget(t))) and (k := least(t, x)) <= decontam.budget(t):
                want.append((r["doc_id"], i, k))
    assert got == sorted(want) and got


def test_op6_law(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, SF_SMALL, "documents").collect()}
    got = QUERIES["op6_flow_reshard"](spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]) + 1, zlib.crc32(docs[r["doc_id"]]), "bytes", None)
               for r in got)
    size = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(8)}
    assert max(size.values()) - min(size.values()) <= 7 * max(map(len, docs.values()))
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_op8_equals_brute_force(spark):
    got = sorted(map(tuple, QUERIES["op8_cover_suffixes"](spark, SF_SMALL).collect()))
    assert got == brute_spans([(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()], 50)


def test_op9_held_out_accuracy(spark):
    got = QUERIES["op9_language"](spark, SF_SMALL).join(table(spark, SF_SMALL, "documents").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert out and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in got)


def test_op10_totals(spark):
    got = QUERIES["op10_cube_mix"](spark, SF_SMALL).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        a = per.setdefault(r["source"], [0, 0, r["source_size"], r["target"], 0])
        a[0], a[1], a[4] = a[0] + r["size"], a[1] + r["taken"], max(a[4], r["size"])
    assert sum(a[3] for a in per.values()) == pytest.approx(1.5 * sum(a[0] for a in per.values()))
    assert all(a[0] == a[2] and abs(a[1] - a[3]) <= 2 * a[4] for a in per.values())


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF_SMALL, "documents")
    items = [(r["item_id"], decontam.normal(r["text"])) for r in table(spark, SF_SMALL, "benchmark").collect()]
    for name, stage in C.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = cut(stage(spark, docs, SF_SMALL), name)
        after = [r["doc_id"] for r in out.collect()]
        if name != "shard":
            assert out.columns == docs.columns
        if name == "language_id":
            assert set(after) == {d for d, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "near_dedup":
            assert sorted(after) == [d for d, _, c, _ in brute(sorted(before.items()), 80) if d == c]
        elif name == "decontaminate":
            bad = {d for d, t in before.items() for _, i in items
                   if any(p in decontam.normal(t) for _, p in decontam.pieces(i, decontam.budget(i)))
                   and least(i, decontam.normal(t)) <= decontam.budget(i)}
            assert bad and sorted(after) == sorted(set(before) - bad)
        elif name == "mix_sources":
            took = {r["doc_id"]: r["copies"] for r in mixture.copies(docs).collect()}
            assert sorted(after) == sorted(d for d, n in took.items() for _ in range(n))
        else:
            kept = sorted(r["doc_id"] for r in docs.collect())
            assert sorted(after) == kept
            per = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("k")).collect()
            assert all(r["n"] == r["k"] == r["m"] + 1 for r in per)
        docs = out
