"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters and digits and of any other characters above x7F, lower-cased
(A-Z).  A document's features are the *distinct* hashed slots of its words, word pairs, pairs
with one word between, and words cut to their first ``stems`` bytes, as inflected words share those.
FTRL-proximal gives each coordinate its own rate and drives the weights of features that do not
matter to exactly 0 (L1), so the model is a list of slots and weights to broadcast.  It has at most
2^``bits`` of them, and no more than the bounded sample has features, whatever the input.

The fit takes at most ``max_train`` labelled rows and ``train_bytes`` of their text (see
``_sample``); one task goes over them in the order of a hash.  Scoring has no shuffle.  Settings were
chosen inside the training fold (rows whose crc32 / 5 leaves 0 modulo 4 against the others).

Defined results: null and empty texts have no features and get the score of the bias alone; an
empty table gives no rows; repeated rows are scored alike; a label that is null is not learned
from; if a doc_id has several labels the largest counts; with no labels at all the model is the
bias 0 and every score is 0.5; a text of any length is scored whole, by one task; columns named
``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns
from ._sample import labelled_sample
from ._text import LOWER, Slice, mix, span_hashes, spans, text_slices
from ._work import Work

#: Words end at ASCII characters other than letters and digits.
WORD_ENDS = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


@dataclass(frozen=True)
class Ftrl:
    """``max_train`` and ``train_bytes`` bound the labelled rows that a model is fitted on.

    ``l1`` is for one training row; noise in a weight's gradient sum grows as the square root of
    the rows, and so does the penalty.
    """

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.18
    l2: float = 0.5
    epochs: int = 2
    positive_weight: float = 2.0
    stems: tuple[int, ...] = (4, 6, 8)
    max_train: int = 12_000
    train_bytes: int = 24 << 20
    threshold: float = 0.5


@dataclass(frozen=True)
class Weights:
    """Slots with a weight other than 0, in order, and the bias."""

    bias: float = 0.0
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def empty(self) -> bool:
        """Nothing was learned: there were no labels."""
        return not len(self.slots) and self.bias == 0


def feature_slots(part: Slice, bits: int, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The document (within the slice) and slot of each occurrence of a feature."""
    low = LOWER[part.data]
    w = spans(Slice(part.first, low, part.offsets), WORD_ENDS)
    h = span_hashes(low, w.start, w.end)
    docs = w.docs()
    d, g = [docs], [h]
    for gap, salt in ((1, 0x9E37), (2, 0x79B9)):
        if len(h) > gap:
            same = docs[gap:] == docs[:-gap]
            d.append(docs[gap:][same])
            g.append(mix(h[:-gap][same] * np.uint64(3) + h[gap:][same] * np.uint64(2 * salt + 1)))
    for k in stems:
        long = np.flatnonzero(w.end - w.start >= k)
        d.append(docs[long])
        g.append(mix(span_hashes(low, w.start[long], w.start[long] + k) + np.uint64(k)))
    return np.concatenate(d), (np.concatenate(g) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_slots(part: Slice, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """The sorted slots of each document, one after the other, and their bounds."""
    d, s = feature_slots(part, p.bits, p.stems)
    key = np.unique(d * (1 << p.bits) + s)
    return (key & ((1 << p.bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(part) + 1) * (1 << p.bits))


def _fit(docs: list[np.ndarray], y: np.ndarray, p: Ftrl) -> Weights:
    """Sequential FTRL-proximal over documents in the given order."""
    size, l1 = 1 << p.bits, p.l1 * np.sqrt(len(docs))
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(p.epochs):
        for slots, label in zip(docs, y, strict=True):
            idx = np.append(slots, size)  # the last slot is the bias, which is not shrunk
            zi, ni = z[idx], n[idx]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            w[-1] = -zi[-1] / ((p.beta + np.sqrt(ni[-1])) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            if label:
                g *= p.positive_weight
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[idx] = zi + g - s * w
            n[idx] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))[:size]
    bias = float(-z[size] / ((p.beta + np.sqrt(n[size])) / p.alpha))
    slots = np.flatnonzero(w)
    return Weights(bias, slots, w[slots])


def fit(documents: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> Weights:
    """Fit on at most ``max_train`` rows of ``labels(doc_id, label)``: those of the least hashes.

    Executors hash the texts; one task then sees their slot lists, which the sample's bytes bound.
    """
    p = params
    work = Work(documents.sparkSession, "toxicity")
    rows = labelled_sample(work, documents, labels, p.max_train, p.train_bytes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b.column("text")):
                slots, at = distinct_slots(part, p)
                own = b.slice(part.first, len(part))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slots))
                yield pa.RecordBatch.from_arrays([own.column("o"), own.column("label").cast(pa.float64()), lists], names=["o", "y", "slots"])

    def train(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table.column("o").to_numpy(), kind="stable")
        lists = table.column("slots").chunk(0)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        w = _fit([flat[at[i] : at[i + 1]] for i in order], table.column("y").to_numpy()[order], p)
        return pa.table({"slot": np.append(w.slots, -1), "weight": np.append(w.values, w.bias)})

    slots = rows.select("o", "label", "text").mapInArrow(hashed, "o long, y double, slots array<int>")
    got = slots.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(train, "slot long, weight double").toPandas().sort_values("slot")
    work.keep()
    if got.empty:
        return Weights()
    return Weights(float(got["weight"].iloc[0]), got["slot"].to_numpy(np.int64)[1:], got["weight"].to_numpy(float)[1:])


def score(documents: DataFrame, weights: Weights, params: Ftrl = Ftrl(), text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted``; no shuffle, every other column is kept."""
    p = params
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def make():
        m = sent.value
        table = np.zeros(1 << p.bits, np.float32)
        table[m.slots] = m.values

        def batch(texts: pa.Array) -> list:
            total = np.full(len(texts), m.bias)
            for part in text_slices(texts):
                d, s = feature_slots(part, p.bits, p.stems)
                hit = np.flatnonzero(table[s])
                key = np.unique(d[hit] * (1 << p.bits) + s[hit])
                total[part.first : part.first + len(part)] += np.bincount(key >> p.bits, table[key & ((1 << p.bits) - 1)], len(part))
            prob = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            return [prob, (prob >= p.threshold).astype(np.int32)]

        return batch

    return append_columns(documents, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, drop_text)


def held_out(mod: int = 5, rest: int = 0):
    """The fold that is never learned from: crc32 of the decimal doc_id modulo ``mod``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def trained(spark: SparkSession, documents: DataFrame, sf_dir: str, params: Ftrl = Ftrl()) -> Weights:
    """The model from ``labels.toxic`` of the rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return fit(documents, labels, params)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir), drop_text=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
