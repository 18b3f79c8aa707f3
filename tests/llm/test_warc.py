"""WARC files: round trips, predicates, foreign files, awkward pages."""

import contextlib
import gzip
import hashlib
import io
import itertools
import json

import pytest
from cases import CLASHES, rows
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from driftmark.llm import warc as W

LONG = "<p>" + "x é " * 600
PAGES = [
    (1, "http://a.example/1", LONG), (7, "http://a.example/7", LONG), (3, None, LONG), (None, "http://b/\r\nWARC-Type: revisit", LONG),
    (4, "http://c", "short"), (5, "http://c", "short"), (6, "http://d", None), (8, "http://d", ""), (8, "http://d", ""),
    (9, "http://e", "y" * 1000), (9, "http://e", "y" * 1000), (2, "http://e", "y" * 1000), (10, "http://f", "y" * 999),
    (11, "http://f", "y" * 999), (None, None, "z" * 2000), (None, None, "z" * 2000),
    (12, "http://g", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (13, "http://h", "\r\n\r\n" + "w" * 300_000),
]
SCHEMA = "page_id long, url string, html string"


def want(pages):
    data = [(i, (h or "").encode()) for i, _, h in pages]
    out = []
    for i, p in data:
        ids = [j for j, q in data if q == p and j is not None]
        owner = max(ids) if len(p) >= 1000 and ids else None
        again = owner is not None and i != owner
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=repr)


def write(spark, tmp_dir, pages=PAGES, **options):
    W.register(spark)
    df = W.page_records(spark.createDataFrame(pages, SCHEMA), "2024-01-01T00:00:00Z")
    df.write.format("warc").mode("append").options(**options).save(f"{tmp_dir}/w")
    return f"{tmp_dir}/w"


def test_round_trip_with_clashing_columns(spark, tmp_dir):
    df = spark.createDataFrame(PAGES, SCHEMA)
    for c in [*(c for c in CLASHES if c not in ("url", "html")), "payload", "owner", "record_type", "headers"]:
        df = df.withColumn(c, F.lit(f"own {c}"))
    W.write_pages(df, f"{tmp_dir}/w")
    assert rows(W.read_pages(spark, f"{tmp_dir}/w")) == want(PAGES)


def test_empty(spark, tmp_dir):
    W.write_pages(spark.createDataFrame([], SCHEMA), f"{tmp_dir}/w")
    assert rows(W.read_pages(spark, f"{tmp_dir}/w")) == []


def test_predicates_reach_the_scan(spark, tmp_dir):
    path = write(spark, tmp_dir)
    all_ = [r.asDict() for r in W.archive(spark, path).drop("headers").collect()]
    for cond, keep in [
        ("record_type = 'revisit'", lambda r: r["record_type"] == "revisit"),
        ("payload_length >= 1000 and record_type <> 'revisit'", lambda r: r["payload_length"] >= 1000 and r["record_type"] != "revisit"),
        ("refers_to is null and target_uri like 'http://c%'", lambda r: r["refers_to"] is None and (r["target_uri"] or "").startswith("http://c")),
        ("target_uri <> 'http://c'", lambda r: r["target_uri"] not in (None, "http://c")),
        ("record_id in ('<urn:page:9>', '<urn:page:>')", lambda r: r["record_id"] in ("<urn:page:9>", "<urn:page:>")),
        ("target_uri like '%e' or payload_length = 5", lambda r: (r["target_uri"] or "").endswith("e") or r["payload_length"] == 5),
    ]:
        got = W.archive(spark, path, cond)
        assert rows(got.drop("headers").select(sorted(all_[0]))) == sorted((tuple(r[c] for c in sorted(r)) for r in all_ if keep(r)), key=repr)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        W.archive(spark, path, "record_type = 'revisit' and payload_length >= 1000").explain()
    assert "BatchScan warc" in plan.getvalue() and "Filter" not in plan.getvalue().replace("RuntimeFilters", "")
    bare = W.archive(spark, path, payload=False)
    assert bare.count() == len(PAGES) and bare.where("payload is not null").count() == 0


def test_headers_only_inflates_little(spark, tmp_dir):
    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.seen += len(got)
            return got

    import random
    rnd = random.Random(2)
    payload = bytes(rnd.randrange(256) for _ in range(400_000))
    r = {"record_type": "response", "record_id": "<urn:x>", "date": "d", "target_uri": "u", "refers_to": None,
         "payload_length": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest(), "payload": payload}
    data = W.member(W.render(r)) * 3
    f = Counted(data)
    got = list(W.records(f, len(data), lambda row, keys: row["record_type"] == "revisit"))
    assert got == [] and Counted.seen < 3 * 3 * W.FIRST < len(data) // 10
    assert [x[-1] for x in W.records(io.BytesIO(data), len(data))] == [payload] * 3


def test_foreign_files(spark, tmp_dir):
    """Members without their length, several records as plain text, folded and
    odd header names, records that are no HTTP message."""
    def rec(kind, block, extra=b""):
        return (b"WARC/1.0\r\nwarc-type: " + kind + b"\r\nWARC-Record-ID:<urn:" + kind + b">\r\n" + extra
                + b"CONTENT-LENGTH: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")

    parts = [rec(b"warcinfo", b"software: x\r\n", b"Content-Type: application/warc-fields\r\nX-Note: a\r\n  b\r\n"),
             rec(b"response", b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore", b"Content-Type: application/http; msgtype=response\r\n"),
             rec(b"resource", b"", b""), rec(b"response", b"no blank line", b"Content-Type: application/http\r\n")]
    import os
    os.makedirs(f"{tmp_dir}/f/sub")
    with open(f"{tmp_dir}/f/a.warc", "wb") as f:
        f.write(b"".join(parts))
    with open(f"{tmp_dir}/f/sub/b.warc.gz", "wb") as f:
        f.write(b"".join(map(gzip.compress, parts)))
    W.register(spark)
    one = [("warcinfo", b"software: x\r\n", 13), ("response", b"body\r\n\r\nmore", 12), ("resource", b"", 0), ("response", b"", 0)]
    df = W.archive(spark, f"{tmp_dir}/f")
    assert sorted((r.record_type, bytes(r.payload), r.payload_length) for r in df.collect()) == sorted(one * 2)
    assert W.archive(spark, f"{tmp_dir}/f", "record_type = 'warcinfo'").select(F.col("headers")["x-note"]).first()[0] == "a b"
    for bad in (b"junk", parts[1][:-9], gzip.compress(parts[1])[:-20]):
        with pytest.raises(ValueError):
            list(W.records(io.BytesIO(bad), len(bad)))


def test_files_roll_and_only_committed_ones_are_read(spark, tmp_dir):
    path = write(spark, tmp_dir, file_bytes="300")
    with open(f"{path}/{W.MANIFEST}") as f:
        files = [json.loads(x) for x in f]
    assert sum(n for *_, n in files) == len(PAGES) and len(files) > 4
    with open(f"{path}/{files[0][0]}", "rb") as f, open(f"{path}/left-by-a-failed-attempt.warc.gz", "wb") as g:
        g.write(f.read())
    assert rows(W.read_pages(spark, path)) == want(PAGES)
    reader = W.WarcReader({"path": path, "split_bytes": "1000"})
    parts = reader.partitions()
    assert sorted(itertools.chain(*(p.files for p in parts))) == sorted(reader.files()) and len(parts) > 1


def test_predicates_that_stay_with_spark():
    r = W.WarcReader({"path": "/x"})
    mine, other = [ds.EqualTo(("record_type",), "a"), ds.Not(ds.IsNull(("date",)))], \
        [ds.EqualTo(("headers",), "a"), ds.EqualTo(("payload", "x"), 1), ds.In(("date",), ("a", None))]
    assert list(r.pushFilters(mine + other)) == other and r.filters == mine
    assert W.holds(ds.Not(ds.EqualTo(("date",), "a")), {"date": None}) is None
