"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, fitted with FTRL-proximal (elastic net), calibrated by a
temperature.

A text is lower-cased, every run of non-letters becomes one space, and its
1- to 3-grams are hashed into ``2**BITS`` features with weight
``(1 + log tf) * idf``, scaled to length 1.  Document frequencies come from
all labelled rows; the classifier is fitted on at most ``SAMPLE_DOCS`` rows
(documented bound: an equal share for each label, chosen by a hash of the
id), of which one in ten only sets the temperature.  Every whole text is
scored.

Only text and label are learned from, and only the text is read in
prediction.  A NULL text or one without a letter is ``und`` with score 0, as
is everything when there is nothing to learn from.  Rows with a NULL label or
id are not learned from; ties go to the label that sorts first; rows with
equal ids are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from driftmark.llm.common import cut, ready, release

BITS = 16
SAMPLE_DOCS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
PIECE = 1 << 20  # characters hashed at once


@functools.cache
def _letters() -> np.ndarray:
    """By code point: the code point if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features (ascending) and how often the text has each; None if it has
    no letter.  Long texts are hashed in pieces that overlap by two."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
    blank = c == 32
    if blank.all():
        return None
    c = np.concatenate([[np.uint32(32)], c[~(blank & np.concatenate([[True], blank[:-1]]))], [np.uint32(32)]])
    total = np.zeros(1 << BITS, dtype=np.int64)
    shift = np.uint32(32 - BITS)
    for k in range(0, len(c), PIECE):
        part = c[k:k + PIECE + 2]
        own = min(PIECE, len(part))
        h = part * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        for n in (1, 2, 3):
            if n > 1:
                h = (h[:len(part) - n + 1] ^ (h[:len(part) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) \
                    + part[n - 1:] * np.uint32(0xC2B2AE35)
            total += np.bincount((h[:own] ^ (h[:own] >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> shift,
                                 minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x labels
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def score(self, text: str | None) -> tuple[str, float]:
        f = counts(text) if text and self.labels else None
        if f is None:
            return "und", 0.0
        z = (self.vector(*f) @ self.weights[f[0]] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def fit_ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: Sequence[int], labels: int, features: int,
             epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels, mostly 0) and biases; one example a step."""
    z, n = np.zeros((features + 1, labels)), np.zeros((features + 1, labels))
    onehot = np.eye(labels)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(xs)):
            at, x = xs[i]
            at, x = np.append(at, features), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            g = x[:, None] * (p / p.sum() - onehot[ys[i]])
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of least negative log-likelihood (golden section), one
    further row spread over all labels, so that rows told apart without an
    error still give a finite confidence."""
    e = 1 / (len(ys) + 1)

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        s = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return -float((1 - e) * s[np.arange(len(ys)), ys].mean() + e * s.mean())

    lo, hi, g = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each feature, and of documents, over all rows
    of column ``text``: one partial vector a task, summed by feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                if t and (f := counts(t)) is not None:
                    df[f[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))],
                                         names=["feature", "n"])

    got = (rows.select("text").mapInArrow(run, "feature long, n long")
           .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())  # at most 2**BITS + 1 rows
    at, n = got["feature"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << BITS, dtype=np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def sample(rows: DataFrame, labels: dict[str, int]) -> DataFrame:
    """``(label, part, at, n)``: the features of at most about ``SAMPLE_DOCS``
    of the rows ``(doc_id, label, text)``, an equal share for each label."""
    share = max(1, SAMPLE_DOCS // max(1, len(labels)))
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, min(1.0, share / v))])
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, lab, p, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if t and (f := counts(t)) is not None:
                    out.append((d, lab, p, f[0].astype("<u4").tobytes(), f[1].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=kind.names), schema=kind, preserve_index=False)

    kind = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("part", pa.int32()),
                      ("at", pa.binary()), ("n", pa.binary())])
    return (rows.where(u < rate[F.col("label")]).select("doc_id", "label", part.alias("part"), "text")
            .mapInArrow(run, "doc_id long, label string, part int, at binary, n binary"))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang") -> Model:
    """Fit on the rows where ``learn`` holds and the label is known."""
    ready(docs.sparkSession)
    rows = (docs.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"),
                    F.col(text_col).alias("text")))
    labels = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    names = list(labels)
    if not names:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    df, n = frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model(names, idf, np.zeros((1 << BITS, len(names))), np.zeros(len(names)))
    epochs = EPOCHS

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "label"], kind="stable")
        xs = []
        for a, c in zip(part["at"], part["n"], strict=True):
            at = np.frombuffer(a, dtype="<u4").astype(np.int64)
            xs.append((at, model.vector(at, np.frombuffer(c, dtype="<u4"))))
        ys = np.array([names.index(v) for v in part["label"]])
        held = (part["part"] == 0).to_numpy()
        if held.all() or not held.any():
            held = np.zeros(len(ys), dtype=bool)
        w, bias = fit_ftrl([x for x, h in zip(xs, held, strict=True) if not h], ys[~held], len(names), 1 << BITS, epochs)
        logits = np.array([x @ w[at] + bias for (at, x), h in zip(xs, held, strict=True) if h])
        t = temperature(logits, ys[held]) if held.any() and len(names) > 1 else 1.0
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame({"at": [at.astype("<i8").tobytes()], "w": [w[at].astype("<f8").tobytes()],
                             "bias": [bias.astype("<f8").tobytes()], "t": [t]})

    # the sample is bounded, so one task fits it
    got = (cut(sample(rows, labels), "lang-sample").groupBy()
           .applyInPandas(fit, "at binary, w binary, bias binary, t double").collect())
    if got:
        r = got[0]
        model.weights[np.frombuffer(r["at"], dtype="<i8")] = np.frombuffer(r["w"], dtype="<f8").reshape(-1, len(names))
        model.bias, model.temperature = np.frombuffer(r["bias"], dtype="<f8"), r["t"]
    return model


def predict(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str = "text",
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of every row with the predicted label and its
    calibrated probability."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS x labels numbers
    keep = list(keep)
    struct = StructType([*[docs.schema[c] for c in keep], StructField(out[0], StringType()),
                         StructField(out[1], DoubleType())])
    names, n = struct.names, len(keep)
    at = keep.index(text_col) if text_col in keep else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=names)
        release()

    # mapInArrow looks its columns up by name, which a dot would break
    read = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)] + ([] if at < n else [F.col(text_col).alias("__text")])
    return docs.select(*read).mapInArrow(run, struct)


def held_out(id_col: Column) -> Column:
    """Whether a checksum of the id keeps the row from being learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, keep: Sequence[str], out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Learn from the rows that are not held out and score every row."""
    return predict(docs, train(docs, ~held_out(F.col("doc_id"))), keep, out=out)
