"""Near-duplicates by chosen-path set similarity join.

A document's set is that of its distinct word shingles (``WIDTH`` words; a
shorter text is one shingle).  Two documents are linked if the Jaccard
similarity of their sets reaches ``percent``; the result is the connected
components of the links.

Rows with equal sets are one class with one representative.  Of each set
``TOKENS`` minwise tokens are kept.  Documents that are linked have sizes within
the factor ``percent``, so all are dealt into bands of that ratio, each document
into its own and the next, which loses no pair.  A tree branches the documents of a band by tokens: its root and every
node choose a position by a hash of their path, and the documents that have the
same token there go to the same child.  A node of at most ``SMALL`` documents is
compared exhaustively; a larger one branches again.  Before it does, its
documents are dealt into groups of ``SMALL``, each with the node's smallest
document (the hub), and compared in those: a large group of near copies
becomes one component through its hub without all its pairs.  Nodes within one
component hold nothing to find and are dropped, so each round starts from what
is still apart.  ``TREES`` independent trees bring the probability to miss a
pair of similarity s in small nodes to ``(1 - s)**TREES`` (6e-9 at 0.85, 1e-7 at
0.8).

A large node branches by one position, and by a second one with probability
``1/s - 1`` (a hash of its path decides): so a pair of similarity s is on average
together in as many nodes of each level as of the one before, and the number
of nodes that a document is in grows by 1/s a level at most.  A node that has
branched ``DEPTH`` times and is still large (many texts all about as similar as
the threshold, and of one size) is compared exhaustively in pairs of groups.
By the recursion ``q' = 1 - (1 - s * q)**k`` a pair in large nodes all the way down
is missed by all trees with less than 1e-3 at 0.85 and 4e-3 at 0.8, chance
meetings in a group left aside.

A comparison first estimates the similarity from the tokens (far below the
threshold: left out, about 1e-7 of true links at 0.85 and 1e-6 at 0.8) and then confirms on the full
sets, whose members are 64-bit hashes of the shingles; a pair already in one
component is not compared, nor is a set of documents that the same tree or an
earlier one has brought together already.

NULL and empty texts have no shingles and are linked with nothing; a row with
a NULL id has a NULL component and is kept; rows with equal ids count as one
document; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import cut, few, free, letters, mix64, pack_ints, partitions, powers, quoted, ready, release, tidy, unpack_ints
from driftmark.llm.components import components, labels, merged
from driftmark.session import scratch_dir

WIDTH = 5
TOKENS = 64
TREES = 10
SMALL = 512
DEPTH = 4
PIECE = 1 << 20  # bytes of text hashed at once
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of lower-cased bytes, which bytes are white space, multipliers."""
    low = np.arange(256)
    low[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True
    return letters()[low], space, mix64(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashed shingles of each text."""
    code, space, _ = _tables()
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    up, down = powers(1 << max(21, len(buf).bit_length()))
    blank = space[buf]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(code[buf] * up[:len(buf)], out=sums[1:])
    word = mix64((sums[end] - sums[start]) * down[start])
    first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))  # first word of each text
    c = np.uint64(0xD6E8FEB86659FD93)
    full = np.zeros(max(0, len(word) - WIDTH + 1), dtype=np.uint64)
    for k in range(WIDTH):
        full = full * c + word[k:k + len(full)]
    full = mix64(full)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= WIDTH:
            out.append(np.unique(full[i:j - WIDTH + 1]))
        elif j > i:
            h = np.array([j - i], dtype=np.uint64)
            for k in range(i, j):
                h = h * c + word[k:k + 1]
            out.append(mix64(h))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= PIECE:
            yield from _sets(held)
            held, size = [], 0
    if held:
        yield from _sets(held)


def tokens(s: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set: for each function the least hash."""
    x, (_, _, mult) = mix64(s), _tables()
    if len(s) <= 1024:
        return ((x[:, None] * mult).min(axis=0) >> np.uint64(32)).astype("<u4")
    return np.array([(x * m).min() >> np.uint64(32) for m in mult], dtype="<u4")


def _bucketed(df: DataFrame, place: str, what: str) -> DataFrame:
    """``df``, dealt out by id, as a table of the database ``place``, bucketed by
    id: a join by id then moves only the other side."""
    with tidy(df.sparkSession):
        df.write.bucketBy(partitions(df.sparkSession), "doc_id").saveAsTable(f"{place}.{what}")
    return df.sparkSession.table(f"{place}.{what}")


def _describe(docs: DataFrame, place: str, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, digest, tokens, sig, members)`` of every row; ``sig`` is a byte
    of each token, enough for an estimate.  Texts are dealt out by id first, so
    that a bucket is one file and not one of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols: list[list] = [[], [], [], [], []]
            for s in shingle_sets(texts):
                cols[0].append(len(s))
                t = tokens(s) if len(s) else None
                for c, v in zip(cols[1:], (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), t.tobytes(), t.astype(np.uint8).tobytes(),
                                           pack_ints(np.diff(s, prepend=np.uint64(0)))) if len(s) else [None] * 4, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])],
                                             names=["doc_id", "n", "digest", "tokens", "sig", "members"])
        release()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by = F.coalesce("doc_id", F.xxhash64("text"))  # rows without an id are not one task's
    return _bucketed(texts.repartition(partitions(docs.sparkSession), by)
                     .mapInArrow(run, "doc_id long, n long, digest binary, tokens binary, sig binary, members binary"), place, "sets")


class Union:
    """Disjoint sets over 0..n-1, the least member as root."""

    def __init__(self, same: np.ndarray):
        """``same``: a label of each; equal labels are together already."""
        _, first, back = np.unique(same, return_index=True, return_inverse=True)
        self.root = first[back]

    def join(self, i: int, js: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[js], self.root[i]))
        self.root[np.isin(self.root, roots)] = roots[0]


def plausible(n: np.ndarray, sigs: np.ndarray, comp: np.ndarray, percent: int) -> np.ndarray:
    """A label for each document of a group: those that chains of pairs with
    a high enough estimate connect share one.  Pairs of different sizes or
    of one component count as no pair."""
    # one byte of each token: an estimate too high by 1/256 at most, on average
    sig = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(-1, TOKENS)
    least = int(TOKENS * (percent / 100 - 0.25))
    label = np.arange(len(n))
    for i in range(len(n) - 1):
        rest = np.arange(i + 1, len(n))
        ok = (comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
        rest = rest[ok]
        if len(rest):
            rest = rest[(sig[rest] == sig[i]).sum(axis=1) >= least]
            if len(rest):
                seen = np.unique(np.append(label[rest], label[i]))
                label[np.isin(label, seen)] = seen[0]
    return label


def links(ids: np.ndarray, n: np.ndarray, members: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the full sets say is connected."""
    sets = [np.cumsum(unpack_ints(b, k), dtype=np.uint64) for b, k in zip(members, n.tolist(), strict=True)]
    u, out = Union(comp), []
    for i in range(len(ids) - 1):
        js = np.arange(i + 1, len(ids))
        js = js[(u.root[js] != u.root[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
        if not len(js):
            continue
        all_ = np.concatenate([sets[j] for j in js])
        at = np.minimum(np.searchsorted(sets[i], all_), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][at] == all_).astype(np.int64), np.concatenate([[0], np.cumsum(n[js])[:-1]]))
        js = js[100 * both >= percent * (n[js] + n[i] - both)]
        if len(js):
            out += [(int(ids[i]), int(ids[j])) for j in js]
            u.join(i, js)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each group of rows that are equal in the first ``keys``
    columns (whole numbers), from batches sorted by them.  Groups are small,
    so many share a task without a call of Spark's for each."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), dtype=bool)
        for k in cols[:keys]:
            new[1:] |= k[1:] != k[:-1]
        edge = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            yield [c[i:j] for c in cols]
        held = [c[edge[-1]:] for c in cols]
    if held is not None:
        yield held


def _candidates(groups: DataFrame, percent: int) -> DataFrame:
    """Plausible sets of documents within groups ``(path, part, doc_id, n, sig,
    comp)``: ``(lead, name, doc_id, comp)``, named by their least member and a hash
    of all, so that a set found in several trees has one name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        flush = (lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                    names=["lead", "name", "doc_id", "comp"]))
        held = 0
        for _, _, ids, n, sig, comp in _groups(batches, 2):
            if (comp == comp[0]).all():
                continue
            label = plausible(n, sig, comp, percent)
            many = np.bincount(label, minlength=len(label))[label] > 1
            if many.any():
                label, ids, comp = label[many], ids[many], comp[many]
                _, at = np.unique(label, return_inverse=True)
                lead, name = np.full(at.max() + 1, np.iinfo(np.int64).max), np.zeros(at.max() + 1, dtype=np.uint64)
                np.minimum.at(lead, at, ids)
                np.add.at(name, at, mix64(ids.astype(np.uint64) + np.uint64(1)))
                out.append([lead[at], name.view(np.int64)[at], ids, comp])
                held += len(ids)
            if held > 50_000:
                yield flush()
                out, held = [], 0
        if out:
            yield flush()

    # a number of partitions of its own: the work goes with pairs, not bytes
    return (few(groups.repartition(partitions(groups.sparkSession), "path", "part").sortWithinPartitions("path", "part", "doc_id")
                .select("path", "part", "doc_id", "n", "sig", "comp"))
            .mapInArrow(run, "lead long, name long, doc_id long, comp long"))


def _confirmed(near: DataFrame, seen: list[DataFrame], sets: DataFrame, percent: int) -> DataFrame:
    """Links within candidate sets.  A set is compared once: those of earlier
    rounds (``seen``) have given all links that they hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, n, members, comp in _groups(batches, 2):
            got = links(ids, n, members, comp, percent)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "b"])
        release()

    n = partitions(near.sparkSession)
    once = near.repartition(n, "lead", "name").groupBy("lead", "name", "doc_id").agg(F.min("comp").alias("comp"))
    if seen:
        old = functools.reduce(DataFrame.union, [s.select("lead", "name") for s in seen])
        once = once.join(old, ["lead", "name"], "left_anti")
    return (few(once.join(sets.select("doc_id", "n", "members"), "doc_id").repartition(n, "lead", "name")
                .sortWithinPartitions("lead", "name", "doc_id")
                .select("lead", "name", "doc_id", "n", "members", "comp")).mapInArrow(run, "a long, b long"))


def _child(path: Column, at: Column) -> Column:
    return F.xxhash64(path, at, F.substring("tokens", at * 4 + 1, F.lit(4)))


def _position(path: Column, k: Column) -> Column:
    return F.pmod(F.xxhash64(path, k), F.lit(TOKENS)).cast("int")


def _roots(base: DataFrame, first: int, last: int, percent: int) -> DataFrame:
    """Nodes ``(path, own)`` of the trees ``first`` to ``last``: by band of the
    set's size, then by token.  ``own``: not from the band before."""
    # a hair less than the ratio, so that rounding never puts a pair two bands apart
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("long")
    tree = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
    rows = base.select("*", band.alias("band"), tree.alias("tree"))
    rows = rows.withColumn("path", _child(F.col("tree"), _position(F.col("tree"), F.lit(1))))
    both = F.explode(F.array(F.struct(F.col("band").alias("b"), F.lit(True).alias("own")),
                             F.struct((F.col("band") + 1).alias("b"), F.lit(False).alias("own"))))
    return rows.select("doc_id", "n", "comp", "path", both.alias("in")).select(
        F.xxhash64("path", "in.b").alias("path"), "doc_id", "n", "comp", "in.own")


def _branch(rows: DataFrame, percent: int) -> DataFrame:
    """Children of the nodes ``(path, doc_id, tokens)``: one position a node, and
    with probability ``1/s - 1`` a second, by a hash of its path."""
    second = F.pmod(F.xxhash64("path", F.lit("second")), F.lit(1 << 20)) < F.lit(int((100 / percent - 1) * (1 << 20)))
    k = F.explode(F.when(second, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("*", k.alias("k")).select(
        _child(F.col("path"), _position(F.col("path"), F.col("k"))).alias("path"), "doc_id", "n", "comp", "own")


def components_of(docs: DataFrame, percent: int = 85, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    ready(docs.sparkSession)
    spark = docs.sparkSession
    # a database below the shared folder: dropping it gives the space back
    place = f"near_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {place} LOCATION '{scratch_dir(spark, 'near-tables')}'")
    sets = _describe(docs, place, id_col, text_col)
    info = cut(few(sets.select("doc_id", "n", "digest")), "info")  # all but the sets, in few files
    owner = info.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    same = cut(few(info.where("doc_id is not null").select("doc_id", "digest").join(owner, "digest")
                   .select("doc_id", "rep")), "classes")
    ids = same.where("doc_id = rep").select("doc_id").distinct()
    sets = sets.where("digest is not null")
    heads = _bucketed(sets.join(ids, "doc_id", "left_semi").select("doc_id", "n", "tokens", "sig")
                      .repartition(partitions(spark), "doc_id"), place, "heads")
    # rows of one id with different sets, or a class and its members: together from the start
    found = cut(same.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "links")
    comp = cut(few(heads.select("doc_id", F.col("doc_id").alias("comp")).distinct()), "comp")
    late = None  # nodes to branch further
    level, trees, seen, waiting = 0, [(0, 0), (1, TREES - 1)], [], []

    def label(nodes: DataFrame) -> DataFrame:
        return cut(few(heads.select("doc_id").distinct().join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                       .select("doc_id", F.coalesce("component", "doc_id").alias("comp"))), "comp")

    while True:
        base = heads.join(comp, "doc_id")
        new = []
        if late is not None:
            new.append(_branch(late.join(base, "doc_id"), percent))
        if level < len(trees):
            new.append(_roots(base, *trees[level], percent))
        # only ids travel to the nodes; signatures follow to those that hold something
        rows = new[0] if len(new) == 1 else new[0].unionByName(new[1])
        rows = cut(few(rows.select("path", "doc_id", "n", "comp", "own")), "paths")
        per = (rows.groupBy("path").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                        F.min("doc_id").alias("hub"), F.max("own").alias("any")).where("lo < hi and any"))
        rows = cut(few(rows.join(per.select("path", "size", "hub"), "path")), "nodes")
        parts = F.ceil(F.col("size") / SMALL)
        own = F.when(F.col("doc_id") == F.col("hub"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("doc_id"), parts)))
        last = level >= DEPTH
        if last:
            # every pair of parts of a node, so that all its documents meet
            p, every = F.pmod(F.xxhash64("doc_id"), parts), F.sequence(F.lit(0).cast("long"), parts - 1)
            own = F.transform(every, lambda q: F.least(p, q) * parts + F.greatest(p, q))
        waiting.append(rows.select("path", own.alias("parts"), "doc_id", "n", "comp"))
        late = rows.where(F.col("size") > SMALL).select("path", "doc_id", "own")
        level += 1
        done = level >= len(trees) and (last or late.isEmpty())
        # labels are for the levels that start trees; those below are few nodes, not
        # worth new ones, so they need not wait for each other's links
        if level <= len(trees) or done:
            groups = (functools.reduce(DataFrame.union, waiting).join(heads.select("doc_id", "sig"), "doc_id")
                      .withColumn("part", F.explode("parts")))
            near = cut(_candidates(groups, percent), "near")
            now = cut(_confirmed(near, seen, sets, percent), "links")
            seen.append(near)
            waiting = []
            if not now.isEmpty():
                found = found.union(now)
                if not done:
                    found = merged(found, "a", "b")
                    comp = label(labels(found, "a", "b"))
        if done:
            break
    comp = label(components(found, "a", "b"))
    spark.sql(f"DROP DATABASE {place} CASCADE")
    at = same.join(comp.withColumnRenamed("doc_id", "rep"), "rep").groupBy("doc_id").agg(F.min("comp").alias("comp"))
    return (info.select("doc_id", "n").join(at, "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component, that of the least id (NULL ids
    come last).  If ids repeat or are NULL, rows are told apart by a number of
    their own, so that each is a document whatever its id."""
    own = list(map(quoted, docs.columns))
    slim = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        copies = components_of(slim, percent).where(~F.col("kept")).select("doc_id").distinct()
        return docs.join(cut(copies, "copies"), "doc_id", "left_anti").select(*own)
    row = free(docs.columns, "__row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    comp = components_of(rows.select(row, "text"), percent, row).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = (rows.select(row, "doc_id").join(comp, row).groupBy("component_id").agg(first.alias("f"))
            .select(F.col(f"f.{row}").alias(row)))
    return rows.join(cut(kept, "kept"), row, "left_semi").select(*own)
