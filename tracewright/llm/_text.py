"""Vectorised word and line hashing over Arrow string batches.

Every operator that needs words reads them here, so that all of them cut and hash words alike.
A batch is worked through in slices of about ``SLICE_BYTES`` of UTF-8 so that the temporaries
stay small whatever the batch holds; a document is never cut, so one document is the least a
slice can hold.

Words and shingles are compared by 64-bit hashes of their bytes.  Two different words of one
document meet with a chance of about n^2 / 2^65, which is far below 1e-9 for any real text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes that one numpy pass works on.
SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)

#: Separators of plain words: the ASCII blanks x09-x0D and x20.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INV)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


@dataclass
class Slice:
    """Some whole documents: their bytes, and where each of them starts (n + 1 offsets)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()


def text_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of a string column in order; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Spans:
    """Half-open byte spans in document order; ``bounds[d]:bounds[d + 1]`` are those of d."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def spans(part: Slice, separators: np.ndarray = BLANKS) -> Spans:
    """Longest runs of bytes that are not separators; none crosses documents."""
    n = len(part.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Spans(none, none, np.zeros(len(part) + 1, np.int64))
    inside = ~separators[part.data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~inside[: n - 1]
    edge[part.offsets] = True
    start = np.flatnonzero(inside & edge[:n])
    edge[:n] = ~inside
    edge[n] = True
    edge[part.offsets] = True
    end = np.flatnonzero(inside & edge[1:]) + 1
    return Spans(start, end, np.searchsorted(start, part.offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from one running sum: equal bytes give equal hashes."""
    n = len(data)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive items inside each document, and the position of the first."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = n - k + 1
    g = np.zeros(m, np.uint64)
    for i in range(k):
        g += h[i : i + m] * _U((0xD6E8FEB86659FD93 * (2 * i + 3)) & (2**64 - 1) | 1)
        g = (g << _U(7)) | (g >> _U(57))
    keep = np.ones(m, bool)
    # a start is good if its document still has k items from there on
    for j in range(1, k):
        at = bounds[1:-1] - j
        keep[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(keep)
    return mix(g[at]), at


def lines(part: Slice) -> Spans:
    """The \\n-split lines of each document, empty ones too (an empty text has one)."""
    nl = np.flatnonzero(part.data == 10)
    starts = np.concatenate([part.offsets[:-1], nl + 1])
    # a newline that ends a document's bytes opens an empty last line of the same document
    owner = np.concatenate([np.arange(len(part)), np.searchsorted(part.offsets, nl, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(part) + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[bounds[1:] - 1] = part.offsets[1:]
    return Spans(starts, ends, bounds)
