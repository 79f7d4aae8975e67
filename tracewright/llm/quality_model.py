"""Quality classifier by compression.

Good and bad labelled texts make one zstandard dictionary each: cuts of many texts, as raw
content.  A text is compressed whole with either; the difference of the sizes, divided by the
text's bytes, says which kind it is like, and an isotonic curve fitted on labelled texts that the
dictionaries have not seen turns the difference into a probability.

The fit takes at most ``per_class`` labelled rows of each class (those of the least hashes) and
``train_bytes`` of text of each (see ``_sample``), so one task can hold it.  Scoring has no shuffle.
Settings were chosen inside the training fold (rows whose crc32 / 5 leaves 0 modulo 4 against the
others): raw cuts against trained dictionaries, their length, level and size, by the bad texts found.

Defined results: null counts as the empty text; an empty text scores as the curve says for no
difference; an empty table gives no rows; repeated rows score alike; several labels of one id count
as the largest; null labels are not learned from; if one class has no rows, every score is the
share of label 1 (0.5 without labels); a text of any length is compressed whole, by one task;
columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns
from ._sample import labelled_sample
from ._text import text_slices
from ._work import Work
from .toxicity import held_out


@dataclass(frozen=True)
class CompressionParams:
    dict_bytes: int = 1 << 20
    piece_bytes: int = 500
    level: int = 6
    per_class: int = 5_000
    train_bytes: int = 32 << 20
    bin_rows: int = 5
    threshold: float = 0.3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of good and bad text, and the curve from difference to probability."""

    good: bytes
    bad: bytes
    x: tuple[float, ...]
    y: tuple[float, ...]


class _Sizes:
    def __init__(self, good: bytes, bad: bytes, level: int) -> None:
        def one(content: bytes) -> zstandard.ZstdCompressor:
            if len(content) < 8:  # too little for a dictionary
                return zstandard.ZstdCompressor(level=level)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=d)

        self.good, self.bad = one(good), one(bad)

    def difference(self, text: bytes) -> float:
        return (len(self.bad.compress(text)) - len(self.good.compress(text))) / (len(text) + 1)


@lru_cache(maxsize=1)
def _sizes(good: bytes, bad: bytes, level: int) -> _Sizes:
    """One for each worker process, not for each task: its tables take tens of megabytes."""
    return _Sizes(good, bad, level)


def dictionary(texts: list[bytes], size: int, piece: int = 500) -> bytes:
    """Pieces of each text, spread evenly over the whole of it, as many bytes as make ``size`` in all and 200 at least."""
    cut, out = max(200, size // max(1, len(texts))), []
    for t in texts:
        if len(t) <= cut:
            out.append(t)
        else:
            width = min(piece, cut)
            n = cut // width
            starts = [round(i * (len(t) - width) / (n - 1)) for i in range(n)] if n > 1 else [(len(t) - width) // 2]
            out += [t[i : i + width] for i in starts]
    return b"".join(out)[:size]


def _isotonic(x: np.ndarray, y: np.ndarray, bin_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over equal-count bins: rising values between 0 and 1."""
    order = np.argsort(x, kind="stable")
    bins = [b for b in np.array_split(order, max(1, len(x) // bin_rows)) if len(b)]
    blocks: list[list[float]] = []
    for b in bins:
        blocks.append([float(x[b].sum()), float(y[b].sum()), float(len(b))])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    # half a row of either class in each block: no score is quite 0 or 1
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def _train(texts: list[bytes], y: np.ndarray, share: float, p: CompressionParams) -> CompressionModel:
    """Every other row makes the dictionaries, the rest the curve, weighted back to ``share``."""
    flat = CompressionModel(b"", b"", (0.0,), (share,))
    dictionaries = []
    for label in (1, 0):
        own = [t for i, t in enumerate(texts) if y[i] == label and t]
        own = own[::2] if len(own) > 1 else own
        if not own:
            return flat
        dictionaries.append(dictionary(own, p.dict_bytes, p.piece_bytes))
    sizes = _Sizes(*dictionaries, p.level)
    rest = []
    for label in (1, 0):
        own = [i for i in range(len(texts)) if y[i] == label and texts[i]]
        rest += own[1::2] or own
    x, t = np.array([sizes.difference(texts[i]) for i in rest]), y[rest]
    kx, ky = _isotonic(x, t, p.bin_rows)
    now = t.mean()
    odds = ky / (1 - ky) * (share / (1 - share)) / (now / (1 - now))
    return CompressionModel(*dictionaries, tuple(kx.tolist()), tuple((odds / (1 + odds)).tolist()))


def fit(documents: DataFrame, labels: DataFrame, params: CompressionParams = CompressionParams()) -> CompressionModel:
    """Fit on ``labels(doc_id, label)``; one task sees the bounded sample, the driver the model."""
    p = params
    own = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = own.agg(F.avg("label")).first()[0]
    share = 0.5 if share is None else float(share)
    work = Work(documents.sparkSession, "quality")
    rows = labelled_sample(work, documents, labels, p.per_class, p.train_bytes, by_class=True)

    def train(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("o").to_numpy(), kind="stable")
        texts = table.column("text").to_pylist()
        m = _train([texts[i].encode() for i in order], table.column("label").to_numpy()[order], share, p)
        return pa.table({"good": pa.array([m.good], pa.binary()), "bad": pa.array([m.bad], pa.binary()), "x": [list(m.x)], "y": [list(m.y)]})

    got = rows.select(F.lit(0).alias("g"), "o", "label", "text").groupBy("g").applyInArrow(train, "good binary, bad binary, x array<double>, y array<double>").collect()
    work.keep()
    if not got or not 0 < share < 1:
        return CompressionModel(b"", b"", (0.0,), (share,))
    return CompressionModel(bytes(got[0].good), bytes(got[0].bad), tuple(got[0].x), tuple(got[0].y))


def score(documents: DataFrame, model: CompressionModel, params: CompressionParams = CompressionParams(), text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        sizes = _sizes(m.good, m.bad, params.level)

        def batch(texts: pa.Array) -> list:
            x = np.array([sizes.difference(s.data[s.offsets[i] : s.offsets[i + 1]].tobytes()) for s in text_slices(texts) for i in range(len(s))], float)
            y = np.interp(x, m.x, m.y)
            return [y, (y >= params.threshold).astype(np.int32)]

        return batch

    return append_columns(documents, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, drop_text)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return score(docs, fit(docs, labels), drop_text=True).select("doc_id", held_out().alias("held_out"), "score", "predicted")
