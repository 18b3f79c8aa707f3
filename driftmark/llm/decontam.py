"""Benchmark decontamination by pigeonhole edit matching.

A text contains a test item if some substring of it is within the item's
error budget (``len // RATE`` edits) of the item, both lower-cased and with
white space runs as one blank.  An item with budget k is cut into k + 1
pieces; k edits leave at least one piece intact, so every match has an exact
hit of a piece at about its place.  All pieces of all items are searched for
at once (Aho-Corasick), hits of an item that may belong to one place are
joined, and Myers' bit-parallel algorithm gives the least edit distance of
the item to a substring of that stretch.  Documents never move: one pass over
the texts, no shuffle.

Items are handed to the tasks in groups of at most ``GROUP_BYTES``; a
larger benchmark takes one pass a group.  NULL and empty texts contain nothing and
NULL or blank items are contained in nothing; equal items and repeated rows
each get their own rows; an empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import ready, release

RATE = 16
GROUP_BYTES = 16 << 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str) -> int:
    return len(item) // RATE


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length, with their offsets."""
    edge = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


class Myers:
    """Least edit distance of a pattern to any substring of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def least(self, text: str) -> int:
        ones, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score = ones, 0, self.m
        best, eq = score, self.eq
        for c in text:
            x = eq.get(c, 0)
            diag = ((((x & up) + up) ^ up) | x | down) & ones
            plus = (down | ~(diag | up)) & ones
            minus = up & diag
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = (plus << 1) & ones
            minus = (minus << 1) & ones
            up = (minus | ~(diag | plus)) & ones
            down = plus & diag
            if score < best:
                best = score
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick
        self.items = [(i, t, budget(t), Myers(t)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, at))
        self.auto = ahocorasick.Automaton()
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        if where:
            self.auto.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """``(item_id, distance)`` of the items that the text contains."""
        x = normal(text)
        if not x or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, at) in self.auto.iter(x):
            for n, off in at:
                starts.setdefault(n, set()).add(end + 1 - size - off)
        out = []
        for n, found in starts.items():
            item, t, k, myers = self.items[n]
            best, run = k + 1, []
            for s in [*sorted(found), None]:
                if run and (s is None or s - run[-1] > 2 * k + 1):
                    part = x[max(0, run[0] - k):run[-1] + len(t) + k]
                    best = min(best, 0 if t in part else myers.least(part))
                    run = []
                run.append(s)
            if best <= k:
                out.append((item, best))
        return out


def _groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size, one at a time on the driver."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // GROUP_BYTES))
    for g in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g).collect()
        yield sorted(((r["item_id"], t) for r in part if (t := normal(r["text"]))), key=lambda x: (x[0] is not None, x))


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, distance)`` for every item that a document contains."""
    ready(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for group in _groups(items, item_id, item_text):
        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            m = Matcher(group)
            for b in batches:
                rows = [(d, i, k) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                        for i, k in m.matches(t)]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "item_id", "distance"])

        now = src.mapInArrow(run, "doc_id long, item_id long, distance long")
        out = now if out is None else out.unionAll(now)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are."""
    ready(docs.sparkSession)
    at, names, schema = docs.columns.index(text_col), docs.columns, docs.schema
    plain = [f"c{i}" for i in range(len(names))]  # mapInArrow looks its columns up by name, which a dot would break
    for group in _groups(items, item_id, item_text):
        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            m = Matcher(group)
            for b in batches:
                yield b.filter(pa.array([not m.matches(t) for t in b.column(at).to_pylist()], pa.bool_())).rename_columns(names)
            release()

        docs = docs.toDF(*plain).mapInArrow(run, schema)
    return docs
