"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a position is ``h = 2 * h + code(byte)`` modulo 2**16, so it
depends on the last 16 bytes only.  A chunk ends where the hash is the
greatest within ``REACH`` positions on either side: ends are at least
``REACH`` apart, 2 * REACH + 1 on average, and depend on nearby bytes only, so
an insertion shifts chunks but changes just those around it.  Without such a
place (a long run of one byte) a chunk ends after ``LONGEST`` bytes.

Chunks are known by a 128-bit digest, so that no two different chunks are
taken for one.  The first place of a digest is the least (document, ordinal)
that has it.  A chunk is a repeat if its first place is in an earlier document,
and a repeat is removed if it belongs to a stretch of repeats, one after the
other, of at least ``min_span`` bytes.  The chunks of a stretch may have first
places anywhere in any earlier documents: a copy goes whole even if its lines
recur or some already stood elsewhere.  Shorter stretches stay, so a document
below ``min_span`` bytes loses nothing.

A map-side-combined minimum finds the first places and an equi-join (split by
AQE where a passage is hot) hands them to the chunks; only repeated chunks
then travel by document.  NULL and empty texts have no chunks; rows with
equal ids are one document for the comparison, and those with equal texts
also give one result; NULL ids sort first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.common import cut, letters, ready

REACH = 24
LONGEST = 1024
NO_ID = -(1 << 63)


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash at every position, by doubling the window."""
    h = (letters() >> np.uint64(48)).astype(np.uint16)[buf]
    for w in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[w:] = h[:-w] if w < len(h) else h[:0]
        h = h + (older << np.uint16(w))
    return h


def _greatest_before(h: np.ndarray, reach: int) -> np.ndarray:
    """For each position the greatest of the ``reach`` values before it (-1
    where there is none)."""
    m = np.concatenate([np.full(reach, -1, dtype=np.int32), h[:-1].astype(np.int32)]) if len(h) else h.astype(np.int32)
    w = 1
    while 2 * w <= reach:  # m[i] covers w values from i on
        m = np.maximum(m[:-w], m[w:])
        w *= 2
    if w < reach:
        m = np.maximum(m[:len(m) - (reach - w)], m[reach - w:])
    return m


def ends(buf: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Where the chunks of a text end (exclusive, ascending, last its end)."""
    if not len(buf):
        return np.zeros(0, dtype=np.int64)
    h = gear(buf)
    before = _greatest_before(h, reach)
    after = _greatest_before(h[::-1], reach)[::-1]
    top = (h > before) & (h >= after)
    top[:reach] = top[len(top) - reach:] = False
    cuts = np.flatnonzero(top) + 1
    cuts = np.unique(np.append(cuts, len(buf)))
    begin = np.concatenate([[0], cuts[:-1]])
    if (cuts - begin > longest).any():
        cuts = np.unique(np.concatenate([cuts, *[np.arange(b + longest, c, longest) for b, c in
                                                 zip(begin.tolist(), cuts.tolist(), strict=True) if c - b > longest]]))
    return cuts


def digests(text: bytes, cuts: np.ndarray) -> np.ndarray:
    """The two words of each chunk's digest."""
    cuts_ = cuts.tolist()
    raw = b"".join([hashlib.blake2b(text[i:j], digest_size=16).digest()
                    for i, j in zip([0, *cuts_[:-1]], cuts_, strict=True)])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, nth, n, digest, more)``: the chunks of every row; ``row``
    tells rows of one id apart, ``more`` is the second word of the digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, nth, size, digest, more, held = [], [], [], [], [], [], 0
            for d, r, t in zip(*[c.to_pylist() for c in (*b.columns[:2], b.column(2).cast(pa.binary()))], strict=True):
                if not t:
                    continue
                buf = np.frombuffer(t, dtype=np.uint8)
                cuts = ends(buf)
                n = len(cuts)
                ids.append(np.full(n, NO_ID if d is None else d))
                rows.append(np.full(n, r))
                nth.append(np.arange(n))
                size.append(np.diff(cuts, prepend=0))
                words = digests(t, cuts)
                digest.append(words[:, 0])
                more.append(words[:, 1])
                held += n
                if held > 100_000:
                    yield _batch(ids, rows, nth, size, digest, more)
                    ids, rows, nth, size, digest, more, held = [], [], [], [], [], [], 0
            if held:
                yield _batch(ids, rows, nth, size, digest, more)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, row long, nth int, n int, digest long, more long"))


def _batch(*cols: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)],
                                      names=["doc_id", "row", "nth", "n", "digest", "more"])


def repeats(docs: DataFrame, min_span: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, first_chunk, n_chunks, n_bytes, first_doc, first_nth,
    stretch)``: the stretches of chunks that earlier documents have, in pieces
    whose first places follow each other in one of them; ``stretch`` is the
    first chunk of the whole stretch."""
    ready(docs.sparkSession)
    parts = cut(chunk(docs, id_col, text_col), "chunks")
    first = (parts.groupBy("digest", "more").agg(F.min(F.struct("doc_id", "nth")).alias("f"), F.count("*").alias("k"))
             .where("k > 1").select("digest", "more", F.col("f.doc_id").alias("first_doc"), F.col("f.nth").alias("first_nth")))
    later = parts.join(first, ["digest", "more"]).where("first_doc < doc_id").drop("digest", "more")
    step = Window.partitionBy("doc_id", "row").orderBy("nth")
    again = F.coalesce(F.lag("nth").over(step) == F.col("nth"), F.lit(False))  # a repeated row
    later = later.withColumn("again", again).where("not again")
    goes_on = ((F.lag("nth").over(step) == F.col("nth") - 1) & (F.lag("first_doc").over(step) == F.col("first_doc"))
               & (F.lag("first_nth").over(step) == F.col("first_nth") - 1))
    runs = (later.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
            .withColumn("run", F.sum("new").over(step))
            .withColumn("gaps", F.col("nth") - F.row_number().over(step)))  # the same throughout a stretch
    whole = Window.partitionBy("doc_id", "row", "gaps")
    return (runs.groupBy("doc_id", "row", "gaps", "run")
            .agg(F.min("nth").alias("first_chunk"), F.count("*").alias("n_chunks"), F.sum("n").alias("n_bytes"),
                 F.min("first_doc").alias("first_doc"), F.min("first_nth").alias("first_nth"))
            .withColumn("span", F.sum("n_bytes").over(whole)).withColumn("stretch", F.min("first_chunk").over(whole))
            .where(F.col("span") >= min_span).drop("run", "gaps", "span"))


def deduplicate(docs: DataFrame, min_span: int = 64) -> DataFrame:
    """``(doc_id, n_removed, n_spans, first_docs)`` of the documents that lose
    something: bytes removed, stretches, and the earlier documents (ascending)
    that keep pieces of at least ``min_span`` bytes; of a stretch without such
    a piece, all that keep some of it (``repeats`` has every piece)."""
    whole = Window.partitionBy("doc_id", "row", "stretch")
    named = (F.col("n_bytes") >= min_span) | (F.max("n_bytes").over(whole) < min_span)
    return (repeats(docs, min_span).withColumn("named", named).groupBy("doc_id", "row")
            .agg(F.sum("n_bytes").alias("n_removed"),
                 F.count_if(F.col("first_chunk") == F.col("stretch")).alias("n_spans"),
                 F.array_sort(F.collect_set(F.when(F.col("named"), F.col("first_doc")))).alias("first_docs"))
            .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_removed", "n_spans", "first_docs"))
