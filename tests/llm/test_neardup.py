import random
import re

import pytest
from cases import ROWS, awkward, empty

from driftmark.llm import neardup


def brute(docs, percent):
    sets = {}
    for d, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {d: lo if c == hi else c for d, c in comp.items()}
    return sorted((d, len(sets[d]), comp[d], comp[d] == d) for d in ids)


def corpus(seed, n=90):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(3, 150))] for _ in range(6)]
    line, docs = [r.choice(words) for _ in range(30)], []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):  # similarities on both sides of the threshold
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.3:
            t = line + [r.choice(words) for _ in range(60)]
        docs.append((i, " ".join(t).upper() if r.random() < 0.2 else "\n".join(t)))
    return docs


@pytest.mark.parametrize("seed,small,depth", [(0, 512, 4), (1, 8, 4), (2, 8, 0)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small, depth):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "DEPTH", depth)
    docs = corpus(seed)
    got = neardup.components_of(spark.createDataFrame(docs, "doc_id long, text string"), 85).collect()
    assert sorted(map(tuple, got)) == brute(docs, 85)


def test_awkward(spark):
    got = neardup.components_of(awkward(spark), 85).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None}
    assert by[1] == (4, 1, True) and by[5] == (4, 1, False)
    assert by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[6] == (1, 6, True)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.components_of(empty(spark)).collect() == []


def test_drop_copies_keeps_columns(spark):
    df = awkward(spark)
    got = neardup.drop_copies(df)
    assert got.columns == df.columns
    assert got.count() == len(ROWS) - 2  # both rows of document 5 go


def test_drop_copies_keeps_one_row_of_a_group(spark):
    """Repeated ids and NULL ids: every row is a document."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, c + " end"), (4, a + " " + c),
            (5, "five"), (5, "other"), (None, None), (None, None), (6, "")]
    got = neardup.drop_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted(map(tuple, got), key=repr)
    assert sum(x[0] == 3 for x in got) == 1 and {x[1] for x in got if x[0] == 3} <= {c, c + " end"}
    assert [x for x in got if x[0] != 3] == sorted([(1, a), (None, b), (4, a + " " + c), (5, "five"), (5, "other"),
                                                    (None, None), (None, None), (6, "")], key=repr)


def test_large_nodes_branch_to_the_end(spark, monkeypatch):
    """A passage in all documents, none of them linked: nodes stay large."""
    r, levels, branch = random.Random(5), [], neardup._branch
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "TREES", 2)
    monkeypatch.setattr(neardup, "_branch", lambda rows, percent: levels.append(percent) or branch(rows, percent))
    passage = " ".join(f"p{i}" for i in range(100))
    docs = [(i, passage + "".join(f" d{r.random()}" for _ in range(12))) for i in range(24)]
    got = neardup.components_of(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(x["kept"] for x in got)
    assert levels == [85] * neardup.DEPTH


@pytest.mark.parametrize("percent", [85, 80])
def test_critical_branching(spark, percent):
    """A second child for 1/s - 1 of the nodes, by the path alone."""
    rows = spark.range(40_000).selectExpr("id as path", "id as doc_id", "9 as n", "0 as comp", "true as own", "cast(repeat('abcd', 64) as binary) as tokens")
    assert neardup._branch(rows, percent).count() == pytest.approx(40_000 * 100 / percent, rel=0.01)


@pytest.mark.parametrize("percent", [85, 80])
def test_recall_in_large_nodes(spark, monkeypatch, percent):
    """Pairs just above the threshold among documents that all share most of
    their text, so that nodes stay far above SMALL for several levels."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    r, docs, own = random.Random(percent), [], 150
    passage = " ".join(f"p{i}" for i in range(120))
    for k in range(80):
        tail = [f"t{k}x{i}" for i in range(own)]
        docs.append((2 * k, passage + " " + " ".join(tail)))
        # each changed word changes five shingles of either text
        for at in range(0, (4 if percent == 85 else 5) * 6, 6):
            tail[at] = f"c{r.random()}"
        docs.append((2 * k + 1, passage + " " + " ".join(tail)))
    want = {(d, c) for d, _, c, _ in brute(docs, percent)}
    assert sum(d != c for d, c in want) == 80
    got = neardup.components_of(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert len(want - {(x["doc_id"], x["component_id"]) for x in got}) <= 1


def test_bands_hold_pairs_at_the_ratio(spark):
    """Sizes whose ratio is the threshold exactly meet in a band."""
    sizes = [n for k in range(1, 60) for n in (17 * k, 20 * k)]
    base = spark.createDataFrame([(i, n, i) for i, n in enumerate(sizes)], "doc_id long, n long, comp long").selectExpr(
        "*", "cast(repeat('abcd', 64) as binary) as tokens")
    nodes = {}
    for x in neardup._roots(base, 0, 0, 85).collect():
        nodes.setdefault(x["path"], {})[x["doc_id"]] = x["own"]
    for i in range(0, len(sizes), 2):
        assert any(i in m and i + 1 in m and (m[i] or m[i + 1]) for m in nodes.values())


def test_buckets_are_one_file_each_and_late_levels_share_a_comparison(spark, monkeypatch):
    """Many tasks do not leave a file each in every bucket, and levels that only
    branch are compared together."""
    files, compared, bucketed, candidates = {}, [], neardup._bucketed, neardup._candidates

    def count(df, place, what):
        out = bucketed(df, place, what)
        files[what] = len(out.inputFiles())
        return out

    monkeypatch.setattr(neardup, "_bucketed", count)
    monkeypatch.setattr(neardup, "_candidates", lambda groups, percent: compared.append(1) or candidates(groups, percent))
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "TREES", 2)
    r, passage = random.Random(6), " ".join(f"p{i}" for i in range(100))
    docs = [(i, passage + "".join(f" d{r.random()}" for _ in range(12))) for i in range(24)]
    got = neardup.components_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()
    assert len(got) == 24 and all(x["kept"] for x in got)
    assert max(files.values()) <= 8 and len(compared) == 3
