"""Removal of repeated substrings by blockwise suffix sorting with a
difference cover.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id.  So the suffixes of all documents are to be
sorted by their first ``length`` bytes, and of each group of equal ones the
smallest document is wanted.  As in blockwise suffix sorting, the suffixes
are dealt into buckets and one bucket is sorted at a time, and a difference
cover of period ``V`` (a set D of residues such that every difference mod V
is one between two members) settles long ties without comparing the
suffixes themselves.  Two suffixes i, j that agree on ``length`` bytes have
an offset s < V with both i + s and j + s in the cover sample, so

1. *sample words* - the ``length - V + 1`` bytes at sample positions are
   sorted; a suffix none of whose sample words repeats is alone and leaves;
2. *long ties* - the ``length + V - 1`` bytes at the sample positions that
   remain are ranked; where one repeats a smaller document's, the V suffixes
   starting there are settled at once (all of a long copy but its ends);
3. *the rest* - what is left (first occurrences and the ends of copies) is
   sorted by its own ``length`` bytes.

The order within a bucket is that of 64-bit fingerprints of the compared
bytes (the order of unequal suffixes is not asked for); the first sort, a
mere filter, uses only as many bits as the input's size needs.

The documents are packed once into blocks of about ``BLOCK_BYTES``, written
as a table bucketed by block.  A sort's map side sends each block's sorted
distinct fingerprints, as differences, to the buckets; a bucket answers with
one bit per fingerprint (an earlier document elsewhere has it, or not), and
the next step joins those bits to the blocks, whose texts never move again.
Bounds: a task holds a block, or a bucket of about ``BUCKET_ROWS``
fingerprints; copies within a block count once, so a hot passage brings a
bucket one entry a block.  A text longer than a block is a block of its own.

NULL texts are empty; a NULL id is smaller than all others; rows with equal
ids are documents of their own and one of them counts as the smaller; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import cut, letters, mix64, pack_ints, partitions, powers, ready, unpack_ints
from driftmark.session import scratch_dir

V = 21
COVER = (0, 1, 4, 14, 16)  # a perfect difference set modulo 21
BLOCK_BYTES = 4 << 20
BUCKET_ROWS = 1 << 20
NO_ID = -(1 << 63)
KEPT = -1  # the bucket number of the masks that a step keeps for the next


class Block:
    """The documents of one block, in id order, and the suffixes in play."""

    def __init__(self, ids: bytes, lens: bytes, body: bytes, length: int):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.lens = np.frombuffer(lens, dtype="<i8")
        self.n, self.length = int(self.lens.sum()), length
        self.buf = np.frombuffer(pa.decompress(body, decompressed_size=self.n, codec="zstd", asbytes=True)
                                 if self.n else b"", dtype=np.uint8)
        self.ends = np.cumsum(self.lens)
        self.room_for = max(22, self.n.bit_length())
        up, _ = powers(1 << self.room_for)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(letters()[self.buf] * up[:self.n], out=self.sums[1:])

    def fits(self, at: np.ndarray, w: int) -> np.ndarray:
        """Those of the ascending positions whose document has ``w`` bytes from there."""
        return at[self.ends[self.docs(at)] - at >= w]

    def words(self, at: np.ndarray, w: int, bits: int) -> np.ndarray:
        """Fingerprints of the ``w`` bytes at each position."""
        _, down = powers(1 << self.room_for)
        h = mix64((self.sums[at + w] - self.sums[at]) * down[at])
        return h >> np.uint64(64 - bits)

    def sample(self, w: int) -> np.ndarray:
        at = (np.arange(0, self.n, V)[:, None] + np.array(COVER)).ravel()
        return self.fits(at[at < self.n], w)

    def starts(self, w: int) -> np.ndarray:
        """Mask of the positions whose document has ``w`` bytes from there."""
        ok = np.ones(self.n, dtype=bool)
        for e, size in zip(self.ends.tolist(), self.lens.tolist(), strict=True):
            ok[e - min(size, w - 1):e] = False
        return ok

    def cover(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """Mask of the positions from ``p - before`` to ``p + after - 1`` for
        distinct positions p; at most 127 of them overlap."""
        if before + after > 127:
            return self.cover(at, before, 127 - before) | self.cover(at + 127 - before, 0, after + before - 127)
        d = np.zeros(self.n + 2 * (before + after) + 1, dtype=np.int8)
        d[at] += 1  # shifted by ``before``
        d[at + before + after] -= 1
        return np.cumsum(d, dtype=np.int8)[before:before + self.n] > 0

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _mask_bytes(*masks: np.ndarray) -> bytes:
    return pa.compress(np.packbits(np.concatenate(masks)).tobytes(), codec="zstd", asbytes=True)


def _masks(b: bytes, n: int, k: int) -> list[np.ndarray]:
    raw = pa.decompress(b, decompressed_size=-(-n * k // 8), codec="zstd", asbytes=True) if n else b""
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * k).astype(bool)
    return [bits[i * n:(i + 1) * n] for i in range(k)]


class Sorted:
    """Distinct fingerprints of a block's positions and what they say."""

    def __init__(self, block: Block, at: np.ndarray, w: int, bits: int):
        self.block, self.at = block, at
        f = block.words(at, w, bits)
        order = np.argsort(f)
        g = f[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        edge = np.flatnonzero(new)
        self.keys, self.bits = g[new], bits
        self.group = np.empty(len(f), dtype=np.int32)
        self.group[order] = np.cumsum(new, dtype=np.int32) - 1
        self.twice = np.diff(np.append(edge, len(g))) > 1
        # the first position of each: positions ascend with the documents' ids
        self.first = np.minimum.reduceat(at[order], edge) if len(edge) else at

    def least(self) -> np.ndarray:
        """The smallest document of each key."""
        return self.block.docs(self.first)

    def parts(self, buckets: int) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, last) of the runs of keys by their top bits."""
        k = buckets.bit_length() - 1
        edge = np.searchsorted(self.keys >> np.uint64(self.bits - k), np.arange(buckets + 1))
        return ((b, int(i), int(j)) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i)

    def bit_of(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        out = np.zeros(len(self.keys), dtype=bool)
        for b, i, j in self.parts(buckets):
            out[i:j] = np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8), count=j - i).astype(bool)
        return out

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """Positions whose word a smaller document has, here or elsewhere."""
        own = self.block.docs(self.at) > self.least()[self.group]
        return self.at[elsewhere[self.group] | own]


class Plan:
    """Sizes of the three sorts: bits and buckets (powers of two)."""

    def __init__(self, n_bytes: int, length: int):
        if length <= 2 * V:
            raise ValueError(f"length must be above {2 * V}")
        self.length = length
        n = max(1, n_bytes)
        self.bits = (min(64, max(32, math.ceil(math.log2(n * len(COVER) / V + 1)) + 7)), 64, 64)
        # the share of suffixes that stay in play is not known beforehand: an eighth is assumed for the size of buckets
        self.buckets = tuple(1 << max(0, math.ceil(math.log2(max(1, x / BUCKET_ROWS))))
                             for x in (n * len(COVER) / V, n * len(COVER) / V / 4, n / 8))

    def words_of(self, block: Block) -> Sorted:
        w = self.length - V + 1
        return Sorted(block, block.sample(w), w, self.bits[0])

    def ties_of(self, block: Block, play: np.ndarray) -> Sorted:
        w = self.length + V - 1
        at = block.sample(w)
        return Sorted(block, at[play[at] & play[at + V - 1]], w, self.bits[1])

    def rest_of(self, block: Block, left: np.ndarray) -> Sorted:
        return Sorted(block, np.flatnonzero(left), self.length, self.bits[2])

    def sort(self, block: Block, step: int, answers: list[dict[int, bytes]]) -> tuple[Sorted, bytes | None]:
        """The sort of a step, given the answers to the one before and the
        masks kept with it; and the masks that the next step needs."""
        if step == 0:
            return self.words_of(block), None
        if step == 1:
            first = self.words_of(block)
            again = first.bit_of(answers[0], self.buckets[0]) | first.twice
            play = block.cover(first.at[again[first.group]], V - 1, 1) & block.starts(self.length)
            return self.ties_of(block, play), _mask_bytes(play)
        play, = _masks(answers[1][KEPT], block.n, 1)
        ties = self.ties_of(block, play)
        gone = block.cover(ties.removed(ties.bit_of(answers[1], self.buckets[1])), 0, V)
        left = play & ~gone
        return self.rest_of(block, left), _mask_bytes(gone, left)

    def removed(self, block: Block, answers: list[dict[int, bytes]]) -> np.ndarray:
        """Mask of the removed bytes, given the answers to the last sort."""
        gone, left = _masks(answers[2][KEPT], block.n, 2)
        rest = self.rest_of(block, left)
        gone[rest.removed(rest.bit_of(answers[2], self.buckets[2]))] = True
        return block.cover(np.flatnonzero(gone), 0, self.length)


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents, as a table bucketed by block in the shared folder."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            body = b"".join([t for _, t in held])
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()),
                "ids": [np.array([d for d, _ in held], dtype="<i8").tobytes()],
                "lens": [np.array([len(t) for _, t in held], dtype="<i8").tobytes()],
                "body": [pa.compress(body, codec="zstd", asbytes=True)],
                "n_bytes": pa.array([len(body)], pa.int64())})

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for d, t in zip(ids, texts, strict=True):
                held.append((NO_ID if d is None else d, t or b""))
                size += len(held[-1][1]) + 1  # a bound for empty texts too
                if size >= BLOCK_BYTES:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    name = f"blocks_{uuid.uuid4().hex}"
    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .mapInArrow(run, "block long, ids binary, lens binary, body binary, n_bytes long")
     .write.bucketBy(partitions(spark), "block").option("path", scratch_dir(spark, "blocks")).saveAsTable(name))
    return spark.table(name)


def _with_answers(blocks: DataFrame, answers: DataFrame | None) -> DataFrame:
    if answers is None:
        return blocks.withColumn("answers", F.lit(None).cast("array<struct<step:int,bucket:int,bits:binary>>"))
    per = answers.groupBy("block").agg(F.collect_list(F.struct("step", "bucket", "bits")).alias("answers"))
    return blocks.join(per, "block", "left")


def _each_block(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, Block, list[dict]]]:
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            answers: list[dict[int, bytes]] = [{}, {}, {}]
            for a in r["answers"] or ():
                answers[a["step"]][a["bucket"]] = a["bits"]
            yield r["block"], Block(r["ids"], r["lens"], r["body"], length), answers


def _ask(blocks: DataFrame, plan: Plan, step: int) -> DataFrame:
    """The blocks' sorted fingerprints, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, answers in _each_block(batches, plan.length):
            s, kept = plan.sort(block, step, answers)
            ids = block.ids[s.least()] if step else np.zeros(len(s.keys), dtype=np.int64)
            rows = [] if kept is None else [(-1 - number, KEPT, number, 0, kept, 0, b"")]
            for b, i, j in s.parts(plan.buckets[step]):
                low = int(ids[i:j].min())
                rows.append((b, b, number, j - i, pack_ints(np.diff(s.keys[i:j], prepend=np.uint64(0))), low,
                             pack_ints((ids[i:j] - low).view(np.uint64)) if step else b""))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7,
                                                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()),
                                                strict=True)],
                names=["pile", "bucket", "block", "n", "keys", "low", "ids"])

    return blocks.mapInArrow(run, "pile long, bucket int, block long, n long, keys binary, low long, ids binary")


def _answer(asked: DataFrame, step: int) -> DataFrame:
    """One bit a fingerprint: another block has it (step 0), or has it in a
    smaller document (ties between equal ids: the smaller block number)."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("block")
        out = pd.DataFrame({"block": df["block"].to_numpy(), "step": np.int32(step), "bucket": df["bucket"].to_numpy()})
        if out["bucket"].iloc[0] == KEPT:
            return out.assign(bits=df["keys"].to_numpy())
        sizes = df["n"].to_numpy()
        keys = np.concatenate([np.cumsum(unpack_ints(b, n), dtype=np.uint64) for b, n in zip(df["keys"], sizes, strict=True)])
        order = np.argsort(keys)
        k = keys[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(k)))
        if step == 0:
            bit = np.repeat(size > 1, size)
        else:
            ids = np.concatenate([unpack_ints(b, n).view(np.int64) + low
                                  for b, n, low in zip(df["ids"], sizes, df["low"], strict=True)])[order]
            from_ = np.repeat(np.arange(len(sizes)), sizes)[order]
            least = ids == np.repeat(np.minimum.reduceat(ids, start), size)
            owner = np.repeat(np.minimum.reduceat(np.where(least, from_, len(sizes)), start), size)
            bit = ~(least & (from_ == owner))
        back = np.empty(len(k), dtype=bool)
        back[order] = bit
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return out.assign(bits=[np.packbits(back[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)])

    return asked.groupBy("pile").applyInPandas(run, "block long, step int, bucket int, bits binary")


def _apply(blocks: DataFrame, plan: Plan, make: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, answers in _each_block(batches, plan.length):
            gone = plan.removed(block, answers)
            rows = []
            for d, i, j in zip(block.ids.tolist(), (block.ends - block.lens).tolist(), block.ends.tolist(), strict=True):
                rows.append((None if d == NO_ID else d, *make(block.buf[i:j], gone[i:j])))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=kind, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    struct = StructType.fromDDL(schema)
    names, kind = struct.names, to_arrow_schema(struct)
    return blocks.mapInArrow(run, schema)


def _digest(buf: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
    edge = np.diff(gone.astype(np.int8), prepend=0)
    return len(buf), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(buf[~gone].tobytes()).hexdigest()


def _text(buf: np.ndarray, gone: np.ndarray) -> tuple[str]:
    return (buf[~gone].tobytes().decode("utf-8", "replace"),)


def _settled(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, Plan]:
    ready(docs.sparkSession)
    blocks = pack(docs, id_col, text_col)
    plan = Plan(blocks.agg(F.sum("n_bytes")).first()[0] or 0, length)
    answers = None
    for step in range(3):
        answers = cut(_answer(_ask(_with_answers(blocks, answers), plan, step), step), "answers")
    return _with_answers(blocks, answers), plan


def spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    blocks, plan = _settled(docs, length, id_col, text_col)
    return _apply(blocks, plan, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``: what is left of every text.  A character that a
    removed span cuts in two becomes U+FFFD."""
    blocks, plan = _settled(docs, length, id_col, text_col)
    return _apply(blocks, plan, _text, "doc_id long, text string")
