import tempfile
import time

import pytest
from pyspark.sql import functions as F

from driftmark.llm import common


@pytest.fixture()
def wide(spark):
    """A session whose joins are as on large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def attached(spark, docs, found):
    folder = tempfile.mkdtemp(prefix="dm-test-")
    spark.createDataFrame(docs, "doc_id long, `a.b` string, Slot string").write.parquet(f"{folder}/d")
    spark.createDataFrame(found, "doc_id long, slot long").write.parquet(f"{folder}/f")
    return common.attach(spark.read.parquet(f"{folder}/d"), spark.read.parquet(f"{folder}/f"), {"doc_id": F.col("doc_id")}, ["slot"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_moves_texts_once_if_keys_repeat(wide):
    """Equal keys (NULL is one) get a row of the other side each; those without
    a partner go."""
    docs = [(1, "x", "s"), (1, "x", "s"), (1, "y", "s"), (None, "z", None), (None, None, None), (2, "q", "s"), (3, "gone", "s")]
    wide.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = attached(wide, docs, [(1, 10), (1, 11), (None, 20), (None, 21), (2, None)])
    assert plan(out).count("Exchange") == 1
    got = out.collect()
    assert out.columns == ["doc_id", "a.b", "slot"]
    assert sorted(x["slot"] for x in got if x["doc_id"] == 1) == [10, 11]
    assert sorted(((x["a.b"] or "", x["slot"]) for x in got if x["doc_id"] is None), key=lambda x: x[1])[0][1] == 20
    assert {x["a.b"] for x in got if x["doc_id"] is None} == {"z", None}
    assert [(x["a.b"], x["slot"]) for x in got if x["doc_id"] == 2] == [("q", None)] and len(got) == 5


def test_attach_does_not_broadcast_a_row_of_each_document(wide):
    wide.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    out = attached(wide, [(1, "x", "s"), (None, "z", None)], [(1, 10), (None, 20)])
    assert "Broadcast" not in plan(out)
    assert sorted((x["a.b"], x["slot"]) for x in out.collect()) == [("x", 10), ("z", 20)]


def test_cut_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, blocks = spark.conf.get(key, None), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if "shuffle" in f.getName()}

    old = held()
    got = common.cut(spark.range(1000).repartition(4, "id"), "x")
    end = time.time() + 10
    while held() - old and time.time() < end:
        time.sleep(0.1)
    assert not held() - old
    assert got.count() == 1000 and spark.conf.get(key, None) == before
