"""Conversation repair against a plain dynamic program over the rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from cases import CLASHES, rows
from conftest import SF_SMALL
from pyspark.sql import functions as F

from driftmark.llm import convrepair as R
from driftmark.llm.common import table
from driftmark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(data):
    out = []
    for conv, turn, role, text in data:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(conv, own):
    """One conversation, by the shortest of all edit sequences."""
    own = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in own),
                 key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in own:
        body = text.strip(BLANK)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # state (role initials so far, folded) -> cost, edits, lines
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(to, state, cost, audit, lines):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = cost, audit, lines

    def inserts(at):
        for _ in range(3):
            for s, (c, a, ls) in list(at.items()):
                q = "a" if s == "u" else "u"
                put(at, q, c + 5, a + "I", (*ls, {"u": "user:", "a": "assistant:"}[q]))
        return at

    for (_, role, text), fault in zip(own, faults, strict=True):
        new = {}
        for s, (c, a, ls) in inserts(best).items():
            put(new, s, c + 2, a + "D", ls)
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                if role[:1] and role[:1] in follows[s]:
                    put(new, role[0], c + more, a + "K", (*ls, f"{role}:{text}"))
                q = "a" if s == "u" else "u"
                put(new, q, c + 1 + more, a + "R", (*ls, {"u": "user:", "a": "assistant:"}[q] + text))
        best = new
    cost, audit, lines = min(v for s, v in inserts(best).items() if s in ("", "a"))
    turns = {t for t, _, _ in own if t is not None}
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"),
            sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(own)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(data, convs=()):
    out = [plain(c, [r for r in data if r[0] == c]) for c in {r[0] for r in data}]
    none = hashlib.sha256(b"").hexdigest()
    return sorted(out + [(c, 0, 0, 0, 0, 0, 0, "", none) for c in set(convs) - {r[0] for r in data}], key=repr)


def noise(n, seed, convs, texts=("a.", "b!", "c", "", " \t", None, "a:b\nc?", "é.", "x . \n")):
    rnd = random.Random(seed)
    return [(rnd.choice(convs), rnd.choice([None, *range(12)]), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys"]),
             rnd.choice(texts)) for _ in range(n)]


def test_query_equals_brute_force(spark):
    data = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows(QUERIES["op13_conversation_repair"](spark, SF_SMALL)) == brute(damaged(data), [r[0] for r in data])


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_rows_with_clashing_columns(spark, seed):
    data = noise(400, seed, [None, *range(60)]) + [(99, None, None, None), (98, 2**62, "user", "x" * 40_000 + "."), (98, -2**60, "user", "y")]
    df = spark.createDataFrame(data, SCHEMA)
    for c in [*CLASHES, "digest", "seen", "kind", "symbols", "texts", "state", "audit"]:
        df = df.withColumn(c, F.lit(f"own {c}"))
    assert rows(R.repair(df)) == brute(data)
    assert rows(R.repair(R.damage(df), df)) == brute(damaged(data), [r[0] for r in data])


def test_long_conversation_over_many_blocks(spark):
    rnd = random.Random(4)
    data = [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["yes.", "no", f"w{t}.", f"v{t}", ""])) for t in range(2600)]
    data += [(7, 5, "user", "same.")] * 700 + [(8, 0, "user", "hi."), (8, 1, "assistant", "ho.")]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(R.repair(df)) == brute(data)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(R.repair(df)) == rows(R.repair(R.damage(df), df)) == []


def test_grammar_does_not_change_results():
    rnd = random.Random(6)
    rules, rounds = [(1, 3), (3, 5), (5, 3), (9, 10), (0, 0), (13, 11), (12, 14)], [3, 2, 1, 1]
    rules[4], rules[3] = (0, 0), (10, 11)
    m, base = R.Matrices(rules, rounds), R.Matrices([], [])
    for _ in range(300):
        blob = bytes(rnd.choice([0, 0, 1, 3, 3, 5, 5, 2, 4, 6, 7, 8]) for _ in range(rnd.randint(0, 30)))
        seq = R.rewrite(R.joined([blob]), rules, 9).tolist()
        got = []
        for mat, s in ((m, seq), (base, list(blob))):
            w = R.Walk(mat)
            w.block(s)
            got.append(w.result())
        assert got[0] == got[1]
        k = rnd.randint(0, len(blob))
        w = R.Walk(m)
        for part in (blob[:k], blob[k:]):
            w.block(R.rewrite(R.joined([part]), rules, 9).tolist())
        cost, parts, tail = w.result()
        assert (cost, "".join(a for _, a in parts) + tail) == (got[1][0], got[1][1][0][1] + got[1][2])


def test_rewrite_takes_every_other_of_a_run():
    assert R.rewrite(np.array([3, 3, 3, -1, 3, 3, 3, 3]), [(3, 3)], 9).tolist() == [9, 3, -1, 9, 9]
