"""Cross-tokenizer alignment with external spill counting.

Two tokenizers A and B cut the same bytes (a space and the text).  Where a
token of A and a token of B end at the same byte, they are *linked*, and these
ends cut both sequences into groups.  How often an id pair is linked in the
whole corpus says how good a translation it is: each link gets its pair's
count, and whether no other A id is linked to its B id more often.

**Alignment.**  A space between two characters that are not white space starts
a token in both tokenizers and no token of either spans it, so a text falls
into pieces that are aligned on their own.  A piece that a worker has seen is
looked up (a bounded table), new ones are encoded together.

**Counting.**  A worker gathers pair-document records up to a bound (a
*chunk*), sorts them by (radix, B id, A id, document), the radix being a part of
the B id, and spills one zstd run a radix.  Runs of one radix are merged by a
heap, ``FAN`` at a time, level by level, into the counts of all its pairs.  The
order is B-major, so the last merge sees all A ids of a B id in succession and
knows the maximum when it leaves it.  A second pass streams the runs of a radix
past its counts and sends each chunk what its documents get.  All steps are
Spark shuffles of runs by (radix, group of chunks): a B id that occurs in every
document is spread over groups of chunks, and counts are combined before they
meet.

A text that is NULL or empty, or that either tokenizer does not give back byte
for byte, has no tokens: all its numbers are 0 and its hash is ''.  Rows with
equal or NULL ids are documents of their own.  An empty table gives no rows.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import cut, pack_ints, partitions, ready, unpack_ints
from driftmark.llm.tokenbin import BYTE_CHARS

#: Radix partitions (of the B ids), runs that one merge reads, records and
#: documents of a chunk, keys of a run that a merge holds decoded.
RADIX, FAN = 32, 128
CHUNK_RECORDS, CHUNK_DOCS = 1 << 20, 1 << 15
BLOCK = 1 << 15
#: Pieces that a worker keeps, bytes of their groups, text encoded at once.
KEPT_PIECES, KEPT_BYTES, TOGETHER = 700_000, 1 << 27, 1 << 20
#: Pieces that are encoded as one string by B (longer ones take it longer).
STRUNG = 64
# Fixed value: how a byte-level vocabulary splits a text before it merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPILL = ("chunk long, radix int, seat int, heads binary, tails binary, pairs long, doc_id long, n_a long, "
         "n_b long, n_groups long, groups_sha256 string")


def token_bytes_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {BYTE_CHARS.get(b, chr(b)): b for b in range(256)}
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    return out


def token_bytes_b(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    return out


def ranks_a(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, if its ids are in the order of
    its merges (then merging by least id is merging by first rule)."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre, vocab = j["pre_tokenizer"], j["model"]["vocab"]
    if pre["type"] != "ByteLevel" or not pre.get("use_regex") or pre["add_prefix_space"] or j["normalizer"]:
        return None
    special = {t["content"] for t in j["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in j["model"]["merges"]]
    if made != sorted(made):
        return None
    bytes_ = token_bytes_a(path)
    return {bytes_[i]: i for t, i in vocab.items() if t not in special}


class Table(dict):
    """Entry numbers of pieces; a new clean piece gets the next one and is
    noted, others get -1."""

    def __init__(self):
        self.new: list[str] = []
        self.size = 0

    def __missing__(self, p: str) -> int:
        if not p or p[0].isspace() or p[-1].isspace():
            self[p] = -1
            return -1
        e = self[p] = self.size
        self.size += 1
        self.new.append(p)
        return e


class Aligner:
    """Alignments of texts, piece by piece.  Entry ``e`` of the table: numbers
    of A ids, B ids and groups (no group: cannot be aligned), where its linked
    pairs (``b << a_bits | a``) begin, and its groups as text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        ranks = ranks_a(a_path)
        if ranks:
            self.encode_a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            tok = Tokenizer.from_file(a_path)
            tok.encode_special_tokens = True
            self.encode_a = lambda text: tok.encode(text, add_special_tokens=False).ids
        self.b = SentencePieceProcessor(model_file=b_path)
        self.bytes_a, self.bytes_b = token_bytes_a(a_path), token_bytes_b(self.b)
        self.len_a, self.len_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.a_bits, self.b_bits = (max(1, (len(t) - 1).bit_length()) for t in (self.bytes_a, self.bytes_b))
        if self.a_bits + self.b_bits > 32:
            raise ValueError("ids of a pair need more than 32 bits")
        na, nb = len(self.bytes_a), len(self.bytes_b)
        self.text = [b"%d," % i for i in range(na)] + [b"%d|" % i for i in range(na)] \
            + [b"%d," % i for i in range(nb)] + [b"%d;" % i for i in range(nb)]
        self.text_len = np.array([len(x) for x in self.text])
        self._clear()

    def _clear(self) -> None:
        self.table = Table()
        self.groups: list[bytes] = []
        self.sizes = np.zeros((1 << 12, 4), dtype=np.int64)
        self.pairs, self.n_pairs, self.n_bytes = np.zeros(1 << 14, dtype=np.uint32), 0, 0

    def _put(self, pairs: np.ndarray, groups: list[bytes], sizes: np.ndarray) -> None:
        at, n = len(self.groups), self.n_pairs + len(pairs)
        self.groups += groups
        while len(self.groups) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while n > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        own = self.sizes[at:at + len(groups)]
        own[:, :3], own[:, 3] = sizes, self.n_pairs + np.cumsum(sizes[:, 2]) - sizes[:, 2]
        self.pairs[self.n_pairs:n] = pairs
        self.n_pairs = n

    def _cut(self, pieces: list[str]) -> None:
        """Entries for ``pieces``, encoded together; halved until what cannot
        be aligned stands alone."""
        raw = [(" " + p).encode() for p in pieces]
        data = b"".join(raw)
        ia = np.array(self.encode_a(data.decode()), dtype=np.int64)
        some = self.b.encode([" ".join(pieces[k:k + STRUNG]) for k in range(0, len(pieces), STRUNG)], num_threads=1)
        ib = np.fromiter(itertools.chain.from_iterable(some), dtype=np.int64)
        ea, eb = np.cumsum(self.len_a[ia]), np.cumsum(self.len_b[ib])
        ends = np.cumsum(list(map(len, raw)))
        marks = np.zeros(len(data) + 1, dtype=np.int8)
        ok = (len(ia) and len(ib) and ea[-1] == eb[-1] == len(data)
              and b"".join(map(self.bytes_a.__getitem__, ia.tolist())) == data
              and b"".join(map(self.bytes_b.__getitem__, ib.tolist())) == data)
        if ok:
            marks[ea] = 1
            marks[eb] += 1
            ok = (marks[ends] == 2).all()
        if not ok:
            if len(pieces) > 1:
                self._cut(pieces[:len(pieces) // 2])
                self._cut(pieces[len(pieces) // 2:])
            else:
                self._put(np.zeros(0, dtype=np.uint32), [b""], np.zeros((1, 3), dtype=np.int64))
            return
        na, nb = len(self.bytes_a), len(self.bytes_b)
        last_a, last_b = marks[ea] == 2, marks[eb] == 2
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        # group by group the A ids, then the B ids
        code = np.empty(len(ia) + len(ib), dtype=np.int64)
        code[np.arange(len(ia)) + np.concatenate([[0], at_b + 1])[np.cumsum(last_a) - last_a]] = ia + na * last_a
        code[np.arange(len(ib)) + (at_a + 1)[np.cumsum(last_b) - last_b]] = 2 * na + ib + nb * last_b
        whole = b"".join(map(self.text.__getitem__, code.tolist()))
        upto = np.concatenate([[0], np.cumsum(self.text_len[code])])
        x, y = (np.concatenate([[0], np.searchsorted(e, ends, side="right")]) for e in (ea, eb))
        z = np.searchsorted(at_a, x)
        self.n_bytes += len(whole)
        self._put((ib[at_b] << self.a_bits) | ia[at_a], [whole[i:j - 1] for i, j in itertools.pairwise(upto[x + y].tolist())],
                  np.stack([np.diff(x), np.diff(y), np.diff(z)], axis=1))

    def _joined(self, pieces: list[str], found: list[int]) -> list[int]:
        """White space beside a space: such neighbours belong together."""
        out, k, n = [], 0, len(pieces)
        while k < n:
            j = k + 1
            while j < n and not (pieces[j - 1] and not pieces[j - 1][-1].isspace()
                                 and pieces[j] and not pieces[j][0].isspace()):
                j += 1
            if j == k + 1 and found[k] >= 0:
                out.append(found[k])
            else:
                out.append(self.table.size)
                self.table.size += 1
                self._cut([" ".join(pieces[k:j])])
            k = j
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """``(sizes, pairs, hashes)``: a row (A ids, B ids, groups) a text, the
        linked pairs of all texts in order, and a hash a text."""
        if len(self.groups) > KEPT_PIECES or self.n_pairs > 8 * KEPT_PIECES or self.n_bytes > KEPT_BYTES:
            self._clear()
        table = self.table
        split = [t.split(" ") if t else [] for t in texts]
        found = [list(map(table.__getitem__, p)) for p in split]
        if table.new:
            self._cut(table.new)
            table.new = []
        found = [self._joined(p, at) if -1 in at else at for p, at in zip(split, found, strict=True)]
        lens = list(map(len, found))
        at = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=sum(lens))
        sizes = self.sizes[at]
        text = np.repeat(np.arange(len(texts)), lens)
        bad = np.zeros(len(texts), dtype=bool)
        bad[text[sizes[:, 2] == 0]] = True
        good = ~bad[text]
        total = np.stack([np.bincount(text[good], weights=sizes[good, k], minlength=len(texts)) for k in range(3)], axis=1).astype(np.int64)
        n, first = sizes[good, 2], sizes[good, 3]
        pairs = self.pairs[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        hashes = ["" if b or not f else hashlib.sha256(b";".join(map(self.groups.__getitem__, f))).hexdigest()
                  for b, f in zip(bad.tolist(), found, strict=True)]
        return total, pairs, hashes


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker and pair of tokenizers."""
    return Aligner(a_path, b_path)


# --- runs ---------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, all arrays of one length, as one zstd run."""
    return pack_ints(np.concatenate([a.astype(np.uint64) for a in arrays]))


def _unpack(blob: bytes, n: int, k: int) -> list[np.ndarray]:
    return list(unpack_ints(blob, n * k).astype(np.int64).reshape(k, n))


def pack_pairs(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return _pack(np.diff(pairs, prepend=0), counts)


def unpack_pairs(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unpack(blob, n, 2)
    return np.cumsum(steps), counts


def spill(pairs: np.ndarray, docs: np.ndarray, a_bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Runs ``(radix, pairs, heads, tails)`` of the records of a chunk: heads
    hold the distinct pairs in order and their counts, tails the documents
    of each and how often they hold it."""
    radix = (pairs >> a_bits) % RADIX
    rec, n = np.unique((radix << 52) | (pairs << 20) | docs, return_counts=True)
    radix, pair, doc = rec >> 52, (rec >> 20) & 0xFFFFFFFF, rec & 0xFFFFF
    edge = np.searchsorted(radix, np.arange(RADIX + 1))
    for r in range(RADIX):
        i, j = edge[r], edge[r + 1]
        if i < j:
            own, first = np.unique(pair[i:j], return_index=True)
            tails = _pack(np.diff(doc[i:j], prepend=0).view(np.uint64) & np.uint64(0xFFFFF), n[i:j])
            held = np.diff(first, append=j - i)
            yield r, len(own), pack_pairs(own, np.add.reduceat(n[i:j], first)), _tails(held, tails, int(j - i))


def _tails(held: np.ndarray, tails: bytes, n: int) -> bytes:
    head = _pack(held)
    return n.to_bytes(8, "little") + len(head).to_bytes(8, "little") + head + tails


def read_tails(blob: bytes, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each record: which pair of the run, which document, how often."""
    n, k = (int.from_bytes(blob[i:i + 8], "little") for i in (0, 8))
    held, = _unpack(blob[16:16 + k], pairs, 1)
    doc, times = _unpack(blob[16 + k:], n, 2)
    return np.repeat(np.arange(pairs), held), np.cumsum(doc) & 0xFFFFF, times


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of sorted runs ``(pairs, counts)`` into sorted blocks with
    the counts of equal pairs added.  The heap holds each run's block by its
    last pair; all that is not above the least of them is done."""
    def blocks(pairs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(pairs), BLOCK):
            yield pairs[i:i + BLOCK], counts[i:i + BLOCK]

    its = [blocks(*r) for r in runs]
    now = {k: b for k, it in enumerate(its) if (b := next(it, None)) is not None}
    heap = [(int(p[-1]), k) for k, (p, _) in now.items()]
    heapq.heapify(heap)
    while heap:
        least = heap[0][0]
        parts = []
        for k, (p, c) in list(now.items()):
            i = int(np.searchsorted(p, least, side="right"))
            if i:
                parts.append((p[:i], c[:i]))
                now[k] = (p[i:], c[i:])
        while heap and heap[0][0] == least:
            _, k = heapq.heappop(heap)
            if (b := next(its[k], None)) is None:
                del now[k]
            else:
                now[k] = b
                heapq.heappush(heap, (int(b[0][-1]), k))
        pairs = np.concatenate([p for p, _ in parts])
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[first], np.add.reduceat(np.concatenate([c for _, c in parts])[order], first)


def maxima(blocks: Iterator[tuple[np.ndarray, np.ndarray]], a_bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks with a third column: whether no pair of the same B id has a
    higher count.  A B id is complete when the next one begins."""
    held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def done(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.flatnonzero(np.diff(pairs >> a_bits, prepend=-1))
        top = np.maximum.reduceat(counts, first)
        return pairs, counts, (counts == np.repeat(top, np.diff(first, append=len(pairs)))).astype(np.int64)

    for block in blocks:
        p, c = (np.concatenate(x) for x in zip(held, block, strict=True))
        i = int(np.searchsorted(p >> a_bits, p[-1] >> a_bits))
        if i:
            yield done(p[:i], c[:i])
        held = p[i:], c[i:]
    if len(held[0]):
        yield done(*held)


# --- Spark --------------------------------------------------------------------


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The rows ``(id, text)`` of a batch, some TOGETHER characters at a time."""
    ids, texts, size = [], [], 0
    for d, t in zip(b.column(0), b.column(1), strict=True):
        ids.append(d.as_py())
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER or len(ids) >= CHUNK_DOCS // 2:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _spill_all(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A table of runs (``radix`` set) and documents (``radix`` NULL) by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        pairs: list[np.ndarray] = []
        records = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, pairs, records, chunk
            all_ = np.concatenate(pairs).astype(np.int64)
            seat = np.repeat(np.arange(len(held)), [h[3] for h in held])
            rows = [(chunk, r, None, heads, tails, n, None, None, None, None, None)
                    for r, n, heads, tails in (spill(all_, seat, align.a_bits) if len(all_) else ())]
            rows += [(chunk, None, k, None, None, None, *h) for k, h in enumerate(held)]
            held, pairs, records, chunk = [], [], 0, chunk + 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(),
                     pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              names=[c.split(" ")[0] for c in SPILL.split(", ")])

        for b in batches:
            for ids, texts in _pieces(b):
                sizes, own, hashes = align(texts)
                pairs.append(own)
                records += len(own)
                held += zip(ids, *sizes.T.tolist(), hashes, strict=True)
                if records >= CHUNK_RECORDS or len(held) >= CHUNK_DOCS:
                    yield flush()
        if held:
            yield flush()

    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .mapInArrow(run, SPILL), "spill")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows by the first ``keys`` columns, from batches sorted by them."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    yield from itertools.groupby(rows, key=lambda r: r[:keys])


def _count(runs: DataFrame, a_bits: int) -> DataFrame:
    """``(radix, pairs, heads, best)``: all pairs of a radix in order, their
    counts, and which are the highest of their B id."""
    spark = runs.sparkSession
    now = runs.select("radix", "chunk", "pairs", "heads")
    left = runs.select("chunk").distinct().count()
    while True:
        groups = max(1, math.ceil(left / FAN))
        last = groups == 1

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            for (radix, group), rows in _runs(batches, 2):
                blocks = merge([unpack_pairs(r[4], r[3]) for r in rows])
                got = list(maxima(blocks, a_bits) if last else blocks)
                pairs, counts, *best = (np.concatenate(c) for c in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((radix, pa.int32()), (group, pa.int64()), (len(pairs), pa.int64()),
                                                   (pack_pairs(pairs, counts), pa.binary()),
                                                   (_pack(*best) if best else None, pa.binary()))],
                    names=["radix", "chunk", "pairs", "heads", "best"])

        group = F.pmod(F.xxhash64("chunk"), F.lit(groups))
        now = cut(now.select("radix", group.alias("group"), "chunk", "pairs", "heads")
                  .repartition(max(1, min(partitions(spark), RADIX * groups)), "radix", "group").sortWithinPartitions("radix", "group", "chunk")
                  .mapInArrow(run, "radix int, chunk long, pairs long, heads binary, best binary"), "counts")
        if last:
            return now
        left = groups


def _shares(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``(chunk, radix, share)``: for each document of the chunk, the links
    whose pair is the best of its B id and the sum of the counts."""
    spark = runs.sparkSession
    chunks = runs.select("chunk").distinct().count()
    salts = max(1, chunks // FAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, _), rows in _runs(batches, 2):
            pairs = total = best = None
            for _, _, chunk, n, heads, tails in rows:
                if chunk < 0:
                    pairs, total = unpack_pairs(heads, n)
                    best, = _unpack(tails, n, 1)
                    continue
                own, _ = unpack_pairs(heads, n)
                at = np.searchsorted(pairs, own)
                pair, doc, times = read_tails(tails, n)
                at = at[pair]
                size = int(doc.max()) + 1
                out = np.zeros((2, size), dtype=np.int64)
                np.add.at(out[0], doc, times * best[at])
                np.add.at(out[1], doc, times * total[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([radix], pa.int32()), pa.array([size], pa.int64()),
                     pa.array([_pack(*out)], pa.binary())], names=["chunk", "radix", "size", "share"])

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    both = (counts.select("radix", every.alias("salt"), F.lit(-1).cast("long").alias("chunk"), "pairs", "heads", F.col("best").alias("tails"))
            .unionByName(runs.select("radix", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt"), "chunk", "pairs", "heads", "tails")))
    return (both.repartition(max(1, min(partitions(spark), RADIX * salts)), "radix", "salt")
            .sortWithinPartitions("radix", "salt", "chunk")
            .mapInArrow(run, "chunk long, radix int, size long, share binary"))


OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
       "groups_sha256 string")


def _gather(found: DataFrame, shares: DataFrame) -> DataFrame:
    """The documents with what they get from all radixes, chunk by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in OUT.split(", ")]
        for _, rows in _runs(batches, 1):
            docs, parts = [], []
            for _, _, seat, size, share, *doc in rows:
                if share is None:
                    docs.append((seat, doc))
                else:
                    parts.append(_unpack(share, size, 2))
            total = np.zeros((2, max(s for s, _ in docs) + 1), dtype=np.int64)
            for b, c in parts:
                total[0, :len(b)] += b
                total[1, :len(c)] += c
            cols = [[d[k] for _, d in docs] for k in range(5)]
            at = [s for s, _ in docs]
            arrays = [pa.array(c, pa.int64()) for c in (*cols[:4], cols[3], total[0, at], total[1, at])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cols[4], pa.string())], names=names)

    none = F.lit(None)
    doc = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    both = found.select("chunk", F.lit(-1).alias("radix"), "seat", none.cast("long").alias("size"), none.cast("binary").alias("share"), *doc) \
        .unionByName(shares.select("chunk", "radix", none.cast("int").alias("seat"), "size", "share",
                                   *[none.cast("string" if c == doc[-1] else "long").alias(c) for c in doc]))
    return (both.repartition(partitions(found.sparkSession), "chunk").sortWithinPartitions("chunk", "radix", "seat")
            .mapInArrow(run, OUT))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Alignments of every row of ``docs``, and the pair counts as
    ``(radix, pairs, heads, best)`` (see ``pair_table``).  ``a_path``: a byte-level
    vocabulary; ``b_path``: a sentencepiece model that adds a space."""
    ready(docs.sparkSession)
    spilt = _spill_all(docs, a_path, b_path, id_col, text_col)
    runs, found = spilt.where("radix is not null"), spilt.where("radix is null")
    counts = _count(runs, aligner(a_path, b_path).a_bits)
    return _gather(found, _shares(runs, counts)), counts


def pair_table(counts: DataFrame, a_bits: int = 16) -> DataFrame:
    """``(a_id, b_id, links, best)`` of the counts of ``align``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, heads, best in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pairs, links = unpack_pairs(heads, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (pairs & ((1 << a_bits) - 1), pairs >> a_bits, links, _unpack(best, n, 1)[0] > 0)],
                    names=["a_id", "b_id", "links", "best"])

    return counts.select("pairs", "heads", "best").mapInArrow(run, "a_id long, b_id long, links long, best boolean")
