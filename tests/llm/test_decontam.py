import random

from cases import ROWS, awkward, empty
from pyspark.sql import functions as F

from driftmark.llm import decontam

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of unusual strength"


def least(pattern, text):
    """Edit distance of the pattern to its best substring, by the table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i:i + 1] = r.choice([[], ["z"], [t[i], "q"]])
    return "".join(t)


def test_myers_is_the_table():
    r = random.Random(1)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 80)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        assert decontam.Myers(p).least(t) == least(p, t)


def test_find_equals_brute_force(spark):
    r = random.Random(2)
    items = [(i, edited(r, ITEM, 12)[:r.randint(20, 90)]) for i in range(8)]
    docs = []
    for d in range(60):
        noise = "".join(r.choice("abcdefgh ") for _ in range(60))
        t = r.choice(items)[1]
        docs.append((d, noise + edited(r, t, r.randint(0, 8)).upper() + "\n\n" + noise))
    got = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = []
    for d, x in docs:
        for i, t in items:
            k = least(decontam.normal(t), decontam.normal(x))
            if k <= decontam.budget(decontam.normal(t)):
                want.append((d, i, k))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "GROUP_BYTES", 100)
    items = spark.createDataFrame([(i, f"{ITEM} {i}{i}{i}") for i in range(6)] + [(None, ITEM), (9, None), (10, " \n")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"see {ITEM} 333 here"), (2, "nothing")], "doc_id long, text string")
    got = {r["item_id"]: r["distance"] for r in decontam.find(docs, items).collect()}
    assert got[3] == 0 and got[None] == 0 and len(got) == 7
    assert [r["doc_id"] for r in decontam.clean(docs, items).collect()] == [2]


def test_awkward(spark):
    items = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, "")], "item_id long, text string")
    df = awkward(spark)
    assert sorted(map(tuple, decontam.find(df, items).collect())) == [(1, 1, 0), (5, 1, 0), (5, 1, 0)]
    kept = decontam.clean(df, items)
    assert kept.schema == df.schema and kept.count() == len(ROWS) - 3
    assert decontam.find(empty(spark), items).collect() == []
    assert decontam.find(df, items.where(F.lit(False))).collect() == []
    assert decontam.clean(df, items.where(F.lit(False))).count() == len(ROWS)
