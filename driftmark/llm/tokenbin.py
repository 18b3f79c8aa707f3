"""Token ids as Arrow stream files of fixed-size lists.

``write_tokens`` encodes documents and lays their ids back to back, in
ascending document order, as rows of ``seq_len`` ids with a mask of the same
length.  A file is one Arrow IPC stream whose record batches all hold
``batch_rows`` rows (the last may hold fewer), so the row ``i`` of a file is
row ``i % batch_rows`` of batch ``i // batch_rows``, and a memory map gives
ids and mask of any sequence without a copy.  Only the last row of a file is
padded (mask 0).  ``doc_ids`` and ``doc_ends`` name the documents that end in
a row and where, which makes the files self-contained.

Every document ends with ``end_id``; a NULL or empty text is just that id.
Repeated doc_ids are separate documents; a NULL doc_id sorts first.  An empty
table gives no files and no rows.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.common import cut, partitions, ready
from driftmark.session import scratch_dir

MANIFEST = "path string, first_doc long, n_docs long, n_tokens long"
#: Pieces kept by a Python worker, the longest one kept, pieces encoded at
#: once, and bytes of text whose new pieces are looked for at once.
CACHE_WORDS = 600_000
CACHE_BYTES = 64
JOINED = 4096
TOGETHER = 1 << 20
#: Marks that may end a piece: neither letters, digits nor white space.
MARKS = b".,;:!?%&#$*"


def _byte_chars() -> dict[int, str]:
    """Byte-level spelling: a visible Latin-1 byte is its own character, the
    others are the characters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def file_schema(seq_len: int, small: bool) -> pa.Schema:
    """``small``: the vocabulary's ids fit 16 bits."""
    return pa.schema([
        ("ids", pa.list_(pa.uint16() if small else pa.uint32(), seq_len)),
        ("mask", pa.list_(pa.bool_(), seq_len)),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int32())),
    ])


def _fs(path: str):
    """File system and path of a URI or plain path."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class Encoder:
    """Ids of a text, as little-endian uint32 bytes.

    A tokenizer that drops white space and never lets a token span it gives a
    text the ids of its white-space-separated pieces; a piece that was seen
    before is looked up (a bounded table, kept from task to task by
    ``encoder``), and new ones are encoded together, a special token between
    them.  Any other tokenizer encodes whole texts."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer)
        special = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.sep_id, self.sep = next(iter(special.items()), (None, ""))
        self.odd = [t.encode() for t in special.values()]
        self.small = self.tok.get_vocab_size() <= 1 << 16
        self.direct = self._lower_case_words()
        self.seen: dict[bytes, bytes] = {}

    def _lower_case_words(self) -> bool:
        """Whether the tokenizer lower-cases, splits letters from the rest and
        spells bytes as ``BYTE_CHARS``: then the model alone encodes a word."""
        j = json.loads(self.tok.to_str())
        norm = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        pre = [p for p in (j["pre_tokenizer"] or {}).get("pretokenizers", [])]
        return (norm == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"]
                and pre[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
                and not pre[1]["add_prefix_space"])

    def _each(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        got = self.tok.encode_batch([p.decode("utf-8", "replace") for p in pieces],
                                    add_special_tokens=False)
        return {p: np.array(e.ids, dtype="<u4").tobytes() for p, e in zip(pieces, got, strict=True)}

    def _joined(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        odd = pieces if self.sep_id is None else [p for p in pieces if any(o in p for o in self.odd)]
        out = self._each(odd) if odd else {}
        plain = [p for p in pieces if p not in out]
        for k in range(0, len(plain), JOINED):
            part = plain[k:k + JOINED]
            text = f" {self.sep} ".join([p.decode("utf-8", "replace") for p in part])
            ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
            at = [-1, *np.flatnonzero(ids == self.sep_id).tolist(), len(ids)]
            for p, i, j in zip(part, at[:-1], at[1:], strict=True):
                out[p] = ids[i + 1:j].tobytes()
        return out

    def _ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """A piece that is one lower-case word, with or without marks at its
        end, needs no normaliser or splitter, only the model."""
        seen, new, rest, tokenize = self.seen, {}, [], self.tok.model.tokenize
        marked = []
        marks = set()
        for p in pieces:
            word = p.rstrip(MARKS)
            if not word.isalpha():  # not plain ASCII letters
                text = word.decode("utf-8", "replace")
                if not (text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)):
                    rest.append(p)
                    continue
            elif not word.islower():
                rest.append(p)
                continue
            if word not in seen and word not in new:
                spelt = word.decode("latin-1").translate(BYTE_CHARS)
                new[word] = struct.pack(f"<{len(t := tokenize(spelt))}I", *[x.id for x in t])
            if len(word) < len(p):
                marks.add(p[len(word):])
                marked.append((p, word))
        new |= self._joined([*rest, *(marks - new.keys())])
        for p, w in marked:
            new[p] = (new.get(w) or seen[w]) + new[p[len(w):]]
        return new

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.direct:  # white space may count: whole texts, nothing looked up
            for text in texts:
                got = self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
                yield np.array(got.ids, dtype="<u4").tobytes()
            return
        seen, held, size = self.seen, [], 0
        for k, text in enumerate(texts):
            # ASCII lower case first, unless that could make a special token
            held.append((text.lower() if b"<|" not in text else text).split())
            size += len(text)
            if size < TOGETHER and k + 1 < len(texts):
                continue
            new = list(set().union(*held).difference(seen))
            now = self._ids(new) if new else {}
            if len(seen) + len(now) > CACHE_WORDS:
                now = {p: seen[p] for pieces in held for p in pieces if p in seen} | now
                seen.clear()
            seen.update(now)
            for pieces in held:
                yield b"".join(map(seen.__getitem__, pieces))
            for p in now:
                if len(p) > CACHE_BYTES:
                    seen.pop(p, None)
            held, size = [], 0


@functools.cache
def encoder(tokenizer: str) -> Encoder:
    """One per Python worker and tokenizer file."""
    return Encoder(tokenizer)


class _Writer:
    """Rows of seq_len ids, buffered up to one batch, into one stream file."""

    def __init__(self, path: str, seq_len: int, batch_rows: int, small: bool):
        fs, p = _fs(path)
        fs.create_dir(os.path.dirname(p))
        self.out = fs.open_output_stream(p)
        self.schema, self.kind = file_schema(seq_len, small), np.uint16 if small else np.uint32
        self.ipc = pa.ipc.new_stream(self.out, self.schema)
        self.seq_len, self.room = seq_len, seq_len * batch_rows
        self.buf, self.held, self.ends = [], 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        while len(ids) > self.room - self.held:
            k = self.room - self.held
            self.buf.append(ids[:k])
            ids, self.held = ids[k:], self.room
            self.flush()
        self.buf.append(ids)
        self.held += len(ids)
        self.ends.append((doc_id, self.held - 1))

    def flush(self) -> None:
        if not self.held:
            return
        rows = -(-self.held // self.seq_len)
        ids = np.zeros(rows * self.seq_len, dtype=self.kind)
        ids[:self.held] = np.concatenate(self.buf)
        mask = np.arange(len(ids)) < self.held
        in_row: list[list] = [[] for _ in range(rows)]
        for d, e in self.ends:
            in_row[e // self.seq_len].append((d, e % self.seq_len))
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.ipc.write_batch(pa.record_batch([
            *fixed,
            pa.array([[d for d, _ in r] for r in in_row], pa.list_(pa.int64())),
            pa.array([[e for _, e in r] for r in in_row], pa.list_(pa.int32())),
        ], schema=self.schema))
        self.buf, self.held, self.ends = [], 0, []

    def close(self) -> None:
        self.flush()
        self.ipc.close()
        self.out.close()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1,
                 seq_len: int = 1024, batch_rows: int = 256,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into stream files below ``folder``; returns the
    manifest ``(path, first_doc, n_docs, n_tokens, start)``, one row a file,
    ``start`` being the number of ids in all files before it.

    One shuffle of the texts by id range.  A repeated attempt of a task
    writes a file of its own; the manifest is a committed table and names
    each range's file once."""
    spark = docs.sparkSession
    ready(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, first = encoder(tokenizer), None, None
        n_docs = n_tokens = 0
        path = f"{folder}/{uuid.uuid4().hex}.arrows"
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for d, t in zip(ids, encode([t or b"" for t in texts]), strict=True):
                if out is None:
                    out, first = _Writer(path, seq_len, batch_rows, encode.small and end_id < 1 << 16), d
                x = np.frombuffer(t + end, dtype="<u4")
                out.add(d, x)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(x)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "first_doc": [first], "n_docs": [n_docs], "n_tokens": [n_tokens]},
                schema=pa.schema([("path", pa.string()), ("first_doc", pa.int64()),
                                  ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ranged = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
              .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    files = cut(ranged.mapInArrow(write, MANIFEST), "token-files")
    # one row a file; equal doc_ids share a range, so first_doc orders the files
    before = Window.orderBy(F.asc_nulls_first("first_doc")).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def open_file(path: str) -> pa.RecordBatchReader:
    """The stream of one file; a local file is memory-mapped."""
    from pyarrow import fs as pafs
    fs, p = _fs(path)
    src = pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)
    return pa.ipc.open_stream(src)


def sequence(batches: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``i`` of a file: views, not copies."""
    rows = batches[0].num_rows
    b, r = batches[i // rows], i % rows
    n = b.schema.field("ids").type.list_size
    ids, mask = (b.column(c).values.slice((b.column(c).offset + r) * n, n) for c in ("ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    ready(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, crc, held = start, 0, 0
                for rec in open_file(path):
                    n = rec.schema.field("ids").type.list_size
                    ids = rec.column("ids").values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
                    used = rec.column("mask").values.true_count
                    own = rec.column("doc_ids").flatten().to_pylist()
                    row = np.repeat(np.arange(rec.num_rows), rec.column("doc_ids").value_lengths().to_numpy())
                    ends = row * n + rec.column("doc_ends").flatten().to_numpy()
                    begin, done = 0, []
                    for e in ends.tolist():
                        crc = zlib.crc32(ids[begin:e + 1], crc)
                        held += e + 1 - begin
                        done.append((at, held, crc))
                        at, crc, held, begin = at + held, 0, 0, e + 1
                    crc, held = zlib.crc32(ids[begin:used], crc), held + used - begin
                    cols = list(zip(*done, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write and read back: the documents as the files have them."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_documents(cut(write_tokens(docs, tokenizer, folder), "token-manifest"))
