"""Conversation repair as a shortest path over a grammar.

Each row of a conversation has a fault (blank, duplicate, truncated) or none,
and a role.  A repaired conversation has roles ``(s?(ua)+)?``.  Edits, by their
initials: **K**eep a row (its role must fit; free), **R**erole it to user or
assistant (1), **D**elete it (2; blank and duplicate rows must go), **I**nsert a
row with an empty text (5, anywhere); a truncated row that stays adds 5.  The
cheapest sequence of edits is wanted, among equals the least as text.

**One matrix a symbol.**  A row is one of nine symbols (role by fault).  What a
symbol can do is a min-plus transfer matrix over the four states of the role
grammar (start, after the system row, after a user, after an assistant): the
least cost from state p to q, by inserts and then one edit of the row.  The
edits of one row from one state determine where they lead, and end with a
letter of the row, so among the edit sequences from one state none is the
beginning of another: where costs tie, sequences with different middle states
differ, and it suffices to know their *order*.  A matrix therefore holds cost,
order and middle state, and the text itself is a rope that is only read at
the end.

**Shared by a grammar.**  Re-Pair: the pairs of adjacent symbols that occur most
often in all conversations become rules, ``RULES`` a round, ``ROUNDS`` rounds
(both bound the grammar, not the result: what no rule covers is taken symbol by
symbol).  The matrix of a rule is the product of those of its halves, computed
bottom-up once and used wherever the rule occurs.

**Long conversations.**  Rows are sorted by range, so that a conversation may
lie in many partitions, and packed into blocks of up to ``BLOCK_ROWS`` rows.  Only
symbols travel to the step that walks a conversation from block to block;
its audit comes back block by block and meets the packed texts, which pass
once, block by block, through the hash.

Rows are ordered by turn (NULL first), then by role and a digest of role and
text.  A NULL role or text
is one space.  Rows that are equal in all columns are the first of them and its
duplicates; they are counted before they are sorted.  A NULL conv_id is a
conversation like any other.  A conversation without rows has zeros, an empty
audit and the hash of an empty text.  Only the four named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import cut, partitions, ready

BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 17
RULES, ROUNDS = 64, 8
# Fixed values of the task: what an edit costs, and the faults.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK_CHARS = r"[\x20\x09-\x0D]"
NO = 1 << 40  # more than any cost: not possible
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled row leads, and the role it gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Symbols: 0 must be deleted; else 1 + 2 * class of the role + truncated.
CLASSES = {"s": 0, "u": 1, "a": 2}
FITS = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})


# --- matrices -----------------------------------------------------------------


class Matrices:
    """Of symbols and rules: ``cost[x, p, q]``, ``order[x, p, q]`` (of the edit
    texts from p) and, for rules, the middle state ``mid[x, p, q]``."""

    def __init__(self, rules: list[tuple[int, int]], rounds: list[int]):
        """``rules``: the halves of symbol 9, 10, ...; ``rounds``: how many rules
        each round has (they only use symbols of earlier ones)."""
        self.rules = rules
        self.leaf: dict[tuple[int, int, int], str] = {}
        cost, order = np.full((9, 4, 4), NO), np.zeros((9, 4, 4), dtype=np.int64)
        for x in range(9):
            for p in range(4):
                best: dict[int, tuple[int, str]] = {}
                at = p
                for k in range(3):
                    ways = [(DELETE, "D", at)]
                    if x:
                        more = TRUNCATED * ((x - 1) % 2)
                        ways.append((REROLE + more, "R", NEXT[at]))
                        to = FITS[(x - 1) // 2].get(at)
                        if to is not None:
                            ways.append((KEEP + more, "K", to))
                    for c, letter, q in ways:
                        best[q] = min(best.get(q, (NO, "")), (k * INSERT + c, "I" * k + letter))
                    at = NEXT[at]
                for q, (c, text) in best.items():
                    cost[x, p, q] = c
                    self.leaf[x, p, q] = text
                texts = [best[q][1] if q in best else "~" for q in range(4)]
                order[x, p] = np.argsort(np.argsort(texts, kind="stable"), kind="stable")
        self.cost, self.order = cost, order
        self.mid = np.zeros((9, 4, 4), dtype=np.int64)
        at = 0
        for n in rounds:
            left, right = (np.array(h, dtype=np.int64).reshape(-1) for h in zip(*rules[at:at + n], strict=True))
            at += n
            # [rule, p, middle, q]
            total = self.cost[left][:, :, :, None] + self.cost[right][:, None, :, :]
            lead = self.order[left][:, :, :, None]
            mid = np.argmin(total * 4 + lead, axis=2)
            c = np.minimum(np.take_along_axis(total, mid[:, :, None, :], axis=2)[:, :, 0, :], NO)
            r, p, q = np.indices(mid.shape)
            key = np.where(c < NO, self.order[left][r, p, mid] * 4 + self.order[right][r, mid, q], 99)
            o = np.argsort(np.argsort(key, axis=2, kind="stable"), axis=2, kind="stable")
            self.cost, self.order, self.mid = (np.concatenate(x) for x in ((self.cost, c), (self.order, o), (self.mid, mid)))
        # plain lists: the walk reads single entries
        self.way = [[[(int(self.cost[x, p, q]), int(self.order[x, p, q])) for q in range(4)] for p in range(4)]
                    for x in range(len(self.cost))]
        self.steps: dict[tuple, tuple[tuple, int, bytes]] = {}  # of walks

    def text(self, x: int, p: int, q: int) -> str:
        """The edits of a rule: its rope, read from the left."""
        got = self.leaf.get((x, p, q))
        if got is None:
            a, b = self.rules[x - 9]
            m = int(self.mid[x, p, q])
            got = self.leaf[x, p, q] = self.text(a, p, m) + self.text(b, m, q)
        return got


class Walk:
    """The best way through a conversation, symbol by symbol.  What a symbol
    does depends only on how the four states' costs differ and on the order of
    their edits; such steps are few and are kept with the matrices."""

    def __init__(self, m: Matrices):
        self.m, self.base = m, 0
        self.now = ((0, NO, NO, NO), (0, 1, 2, 3))
        self.back: list[tuple[bytes, list[int]]] = []

    def _step(self, x: int) -> tuple[tuple, int, bytes]:
        (cost, order), way = self.now, self.m.way[x]
        new, keys, back = [], [], bytearray()
        for q in range(4):
            c, o, p = min((cost[p] + way[p][q][0], order[p], p) for p in range(4))
            new.append(min(c, NO))
            keys.append((c >= NO, o, way[p][q][1], q))
            back.append(p)
        rank = [0] * 4
        for k, key in enumerate(sorted(keys)):
            rank[key[3]] = k
        least = min(new)
        return (tuple(c if c >= NO else c - least for c in new), tuple(rank)), least, bytes(back)

    def block(self, symbols: list[int]) -> None:
        steps, back = self.m.steps, []
        for x in symbols:
            got = steps.get((x, self.now))
            if got is None:
                if len(steps) > 200_000:
                    steps.clear()
                got = steps[x, self.now] = self._step(x)
            self.now, more, b = got
            self.base += more
            back.append(b)
        self.back.append((b"".join(back), symbols))

    def result(self) -> tuple[int, list[tuple[int, str]], str]:
        """Cost, per block the state before it and its edits, and the inserts
        at the end."""
        ends = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
        cost, _, q = min((self.now[0][s] + n * INSERT, self.now[1][s], s) for s, n in ends.items())
        tail, blocks = "I" * ends[q], []
        for back, symbols in reversed(self.back):
            parts = []
            for k in range(len(symbols) - 1, -1, -1):
                p = back[4 * k + q]
                parts.append(self.m.text(symbols[k], p, q))
                q = p
            blocks.append((q, "".join(reversed(parts))))
        return self.base + cost, blocks[::-1], tail


# --- grammar ------------------------------------------------------------------


def rewrite(seqs: np.ndarray, rules: list[tuple[int, int]], first: int) -> np.ndarray:
    """``seqs`` (symbols, -1 between sequences) with the rules applied in
    order; ``first``: the symbol of the first rule."""
    for k, (a, b) in enumerate(rules):
        hit = np.flatnonzero((seqs[:-1] == a) & (seqs[1:] == b))
        if a == b and len(hit):  # of a run, every other place
            run = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            hit = hit[nth % 2 == 0]
        if len(hit):
            seqs = seqs.copy()
            seqs[hit] = first + k
            seqs = np.delete(seqs, hit + 1)
    return seqs


def joined(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\xff".join(blobs), dtype=np.int8).astype(np.int64)


def grammar(seqs: DataFrame) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules and rounds for the symbol strings ``seqs(symbols, n)``.  The driver
    sees ``RULES`` pairs a round."""
    rules: list[tuple[int, int]] = []
    rounds: list[int] = []
    for _ in range(ROUNDS):
        def count(batches: Iterator[pa.RecordBatch], rules: list = list(rules)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = rewrite(joined(b.column(0).to_pylist()), rules, 9)
                weight = np.repeat(b.column(1).to_numpy(), np.diff(np.flatnonzero(np.concatenate([[True], x == -1, [True]]))))
                i = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
                pair, at = np.unique((x[i] << 16) | x[i + 1], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair), pa.array(np.bincount(at, weights=weight[:len(x)][i], minlength=len(pair)).astype(np.int64))],
                    names=["pair", "n"])

        top = (seqs.select("symbols", "n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
               .where("n > 1").orderBy(F.desc("n"), "pair").limit(RULES).collect())
        if not top:
            break
        rules += [(r["pair"] >> 16, r["pair"] & 0xFFFF) for r in top]
        rounds.append(len(top))
    return rules, rounds


@functools.lru_cache(maxsize=4)
def matrices(rules: tuple[tuple[int, int], ...], rounds: tuple[int, ...]) -> Matrices:
    """Once a worker and grammar."""
    return Matrices(list(rules), list(rounds))


# --- Spark --------------------------------------------------------------------

BLOCK = ("conv_id long, turn long, role string, digest binary, last_turn long, low long, high long, turns long, rows long, blank long, "
         "duplicate long, truncated long, illegal long, first string, last string, symbols binary, texts binary")


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"),
                                  role.cast("binary"), text.cast("binary"))))


def prepared(rows: DataFrame) -> DataFrame:
    """Distinct rows with how often they occur and whether their role and text
    are seen in an earlier turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    one = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                      role.alias("role"), text.alias("text"))
    one = one.withColumn("digest", _digest(F.col("role"), F.col("text")))
    one = one.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    # texts that occur in several turns: the first of them; NULL is before all
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (one.select(F.struct("conv_id", "digest").alias("key"), turn.alias("at")).groupBy("key")
             .agg(F.min("at").alias("from"), F.count("*").alias("turns")).where("turns > 1").drop("turns"))
    return (one.withColumn("key", F.struct("conv_id", "digest")).join(again, "key", "left").drop("key")
            .withColumn("seen", F.coalesce(F.col("from") < turn, F.lit(False))).drop("from"))


def _fault(text: str, seen: bool) -> str:
    last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
    return "b" if not last else "d" if seen else "" if last in ".!?" else "t"


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows by range, packed into blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in BLOCK.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[c.split(" ")[1]] for c in BLOCK.split(", ")]
        out: list[tuple] = []
        held: list[tuple] = []
        size = 0

        def pack() -> None:
            nonlocal held, size
            conv, turn, role, digest = held[0][:4]
            turns = [r[1] for r in held if r[1] is not None]
            symbols, counts, illegal, before = bytearray(), {"b": 0, "d": 0, "t": 0}, 0, None
            kept = []
            for _, _, role_, _, n, text, seen in held:
                fault = _fault(text, seen)
                cls = CLASSES.get(role_[:1], 3)
                symbols.append(0 if fault in ("b", "d") else 1 + 2 * cls + (fault == "t"))
                symbols += bytes(n - 1)
                if fault:
                    counts[fault] += 1
                counts["b" if fault == "b" else "d"] += n - 1
                initial = role_[:1]
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                illegal += (n - 1) * (initial + initial not in ("su", "ua", "au"))
                before = initial
                kept += ["" if fault in ("b", "d") else f"{role_}:{text}"] + [""] * (n - 1)
            lines = [k.encode() for k in kept]
            packed = struct.pack(f"<{len(lines)}I", *map(len, lines)) + b"".join(lines)
            blob = len(packed).to_bytes(8, "little") + pa.compress(packed, codec="zstd", asbytes=True)
            out.append((conv, turn, role, digest, held[-1][1], min(turns, default=None), max(turns, default=None),
                        len(set(turns)), len(symbols), counts["b"], counts["d"], counts["t"], illegal, held[0][2][:1], before,
                        bytes(symbols), blob))
            held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
            return b

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (r[0] != held[0][0] or len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                    pack()
                    if len(out) >= 256:
                        yield flush()
                held.append(r)
                size += len(r[5])
        if held:
            pack()
        if out:
            yield flush()

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "role", "digest", "n", "text", "seen").mapInArrow(run, BLOCK))


PIECE = ("conv_id long, kind int, turn long, role string, digest binary, state int, audit string, gaps long, blank long, duplicate long, "
         "truncated long, illegal long, cost long, texts binary")


def _by(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    yield from itertools.groupby(rows, key=lambda r: r[0])


def _walked(blocks: DataFrame, rules: list, rounds: list) -> DataFrame:
    """Per conversation its totals (kind 0), and per block the state before it
    and its edits (kind 1)."""
    rules_, rounds_ = tuple(rules), tuple(rounds)
    names = [c.split(" ")[0] for c in PIECE.split(", ")[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = matrices(rules_, rounds_), {}
        out: list[tuple] = []
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string(), *[pa.int64()] * 6]

        def flush() -> pa.RecordBatch:
            nonlocal out
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
            return b

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The batches; the symbols of each are encoded together before it."""
            for b in batches:
                if len(known) > 50_000:
                    known.clear()
                new = sorted(set(b.column(b.num_columns - 1).to_pylist()).difference(known))
                if new:
                    x = rewrite(joined(new), rules, 9)
                    edge = np.flatnonzero(x == -1).tolist()
                    known.update((s, x[i:j].tolist()) for s, i, j in
                                 zip(new, [0, *(e + 1 for e in edge)], [*edge, len(x)], strict=True))
                yield b

        for conv, rows in _by(encoded(batches)):
            walk, keys, total = Walk(m), [], [0] * 4
            low = high = end = None
            turns, before = 0, ""
            for _, turn, role, digest, last_turn, lo, hi, k, _, b, d, t, i, first, last, symbols in rows:
                total = [x + y for x, y in zip(total, (b, d, t, i), strict=True)]
                total[3] += bool(keys) and before + first not in ("su", "ua", "au")
                low, high = (x if y is None else y if x is None else f(x, y) for x, y, f in ((low, lo, min), (high, hi, max)))
                turns += k - (turn is not None and bool(keys) and turn == end)
                end, before = last_turn, last
                keys.append((turn, role, digest))
                walk.block(known[symbols])
            cost, pieces, tail = walk.result()
            gaps = high - low + 1 - turns if low is not None else 0
            out.append((conv, 0, None, None, None, None, tail, gaps, *total, cost))
            out += [(conv, 1, *key, state, audit, *[None] * 6) for key, (state, audit) in zip(keys, pieces, strict=True)]
            if len(out) >= 512:
                yield flush()
        if out:
            yield flush()

    key = ["conv_id", "turn", "role", "digest"]
    cols = [c.split(" ")[0] for c in BLOCK.split(", ")][:-1]
    return (blocks.select(*cols).repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions(*key)
            .mapInArrow(run, PIECE.rsplit(", ", 1)[0]))


OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
       "repaired_sha256 string")


def repaired(audit: str, state: int, lines: list[bytes]) -> tuple[list[bytes], int]:
    """The lines of a block after its edits, and the state after them."""
    out, at = [], 0
    for e in audit:
        if e == "I":
            out.append(f"{ROLE[state]}:".encode())
            state = NEXT[state]
            continue
        line = lines[at]
        at += 1
        if e == "D":
            continue
        role, _, text = line.partition(b":")
        if e == "R":
            out.append(ROLE[state].encode() + b":" + text)
            state = NEXT[state]
        else:
            out.append(line)
            state = FITS[CLASSES[role[:1].decode()]][state]
    return out, state


def unpack(blob: bytes, n: int) -> list[bytes]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    ends = np.cumsum([4 * n, *struct.unpack(f"<{n}I", raw[:4 * n])]).tolist()
    return [raw[i:j] for i, j in itertools.pairwise(ends)]


def repair(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and the repaired conversation's hash, one row a
    conversation of ``rows`` (conv_id, turn, role, text), and of ``convs``
    (conv_id), whose conversations may have no rows."""
    spark = rows.sparkSession
    ready(spark)
    blocks = cut(_blocks(prepared(rows)), "blocks")
    seqs = cut(blocks.groupBy("symbols").agg(F.count("*").alias("n")), "symbols")
    pieces = _walked(blocks, *grammar(seqs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in OUT.split(", ")]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 7 else pa.string())
                                            for k, c in enumerate(zip(*out, strict=True))], names=names)
            out = []
            return b

        for conv, part in _by(batches):
            total, tail, state, audit, sha, begun = [0] * 6, "", START, [], hashlib.sha256(), False
            own = None
            for _, kind, state_, edits, *counts, texts in part:
                if kind == 0:
                    total, tail = counts, edits
                elif kind == 1:
                    own = edits, state_
                elif kind == 2:
                    lines, state = repaired(*own, unpack(texts, len(own[0]) - own[0].count("I")))
                    audit.append(own[0])
                    if lines:
                        sha.update((b"\n" if begun else b"") + b"\n".join(lines))
                        begun = True
            for _ in tail:
                sha.update((b"\n" if begun else b"") + ROLE[state].encode() + b":")
                state, begun = NEXT[state], True
            out.append((conv, *total, "".join(audit) + tail, sha.hexdigest()))
            if len(out) >= 1024:
                yield flush()
        if out:
            yield flush()

    null = F.lit(None)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = [null.cast("long").alias(c) for c in numbers]
    key = ["turn", "role", "digest"]
    both = (pieces.select("conv_id", "kind", *key, "state", "audit", *numbers, null.cast("binary").alias("texts"))
            .unionByName(blocks.select("conv_id", F.lit(2).alias("kind"), *key, null.cast("int").alias("state"), null.cast("string").alias("audit"),
                                       *empty, "texts")))
    if convs is not None:
        both = both.unionByName(convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
            "conv_id", F.lit(-1).alias("kind"), null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("binary").alias("digest"),
            null.cast("int").alias("state"), null.cast("string").alias("audit"), *empty, null.cast("binary").alias("texts")))
    # the totals first, then each block's edits and texts
    return (both.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, *key, "kind")
            .select("conv_id", "kind", "state", "audit", *numbers, "texts").mapInArrow(run, OUT))


def damage(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn: 0
    drops the row, 1 empties its text, 2 takes its end marks away, 3 repeats
    it, 4 makes it the user's.  NULLs count as one space."""
    one = (lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    return (rows.select("conv_id", "turn", "role", "text", kind.alias("__kind")).where("__kind <> 0")
            .select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"),
                    F.explode(F.array_repeat(F.lit(1), F.when(F.col("__kind") == 3, 2).otherwise(1))).alias("__copy"))
            .drop("__copy"))
