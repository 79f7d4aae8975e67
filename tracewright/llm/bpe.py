"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes of a text cuts it into chunks of about a kilobyte; where the
cuts fall depends on the content alone, so passages that documents share fall into the same
chunks, wherever they stand.  Spark counts the hashes of all chunks (eight bytes for each), and the
chunks that come twice or more are exchanged: each is encoded once, and the book of them is sent
to all tasks.  The book holds the ``book_chunks`` most frequent ones of up to ``book_bytes`` bytes
each, a fixed bound; what is not in it a task encodes once and keeps in a cache of bounded size.
Neither changes a result.

A chunk is encoded as if nothing stood around it, which can be wrong at its ends.  So each join is
repaired: a window from the last safe place at or before the cut to the first one at or after it
is encoded anew.  A place is safe after a letter and before anything but a letter, or likewise for
digits, as no pre-token of this tokenizer goes over it.  A chunk's ids between its two windows are
used if they have token boundaries at both; else, and where a chunk has no safe place, the windows
grow together over it and all of that is encoded as one.  Windows are cached as well.

Special tokens in a text become their ids, as the tokenizers library does by default, and part the
text; decoding puts them back.  Decoding is a gather from the flat table of the tokens' bytes.

Defined results: null counts as the empty text, which has no ids; an empty table gives no rows;
ties and repeated rows are encoded alike; a document is held whole by one task, whatever its
length; columns of the input that are named like a result are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns, bounded_batches
from ._text import Slice, signed, text_slices


@dataclass(frozen=True)
class BpeParams:
    """``vocabulary`` is a tokenizers JSON file with a byte-level BPE; empty: the public one.

    Chunks have about ``2**mask_bits`` bytes beyond ``least``; ``cache_bytes`` bounds what a task
    keeps of chunks and windows, ``book_chunks`` and ``book_bytes`` what all tasks are sent.
    """

    vocabulary: str = ""
    mask_bits: int = 10
    least: int = 128
    cache_bytes: int = 48 << 20
    book_chunks: int = 8192
    book_bytes: int = 2048


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 anything else that is known; 0 where versions of
    Unicode may differ (marks, what came after 3.2, all beyond the first plane)."""
    kinds = {"L": 1, "N": 2, "P": 3, "S": 3, "Z": 3}
    out = np.zeros(0x110000, np.uint8)
    out[:0x10000] = [kinds.get(unicodedata.ucd_3_2_0.category(chr(c))[0], 0) for c in range(0x10000)]
    out[9:14] = 3
    return out


def safe_places(raw: bytes) -> np.ndarray:
    """Byte places at which every text falls into the same pre-tokens on both sides."""
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    hit = np.flatnonzero(((kind[:-1] == 1) | (kind[:-1] == 2)) & (kind[1:] > 0) & (kind[1:] != kind[:-1])) + 1
    if len(points) == len(raw):
        return hit
    return np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))[hit - 1]


class Codec:
    """One vocabulary in one task."""

    #: Pre-tokens of byte-level BPE: contractions, letters, digits, other signs, blanks.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, params: BpeParams, book: dict[bytes, np.ndarray] | None = None) -> None:
        import tiktoken

        self.p = params
        spec = json.load(open(params.vocabulary or default_vocabulary(), encoding="utf-8"))
        byte_of = _byte_of()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        self.encoding = tiktoken.Encoding("bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.special = added
        self.parts = re.compile(b"(" + b"|".join(re.escape(w.encode()) for w in sorted(added, key=len, reverse=True)) + b")") if added else None
        #: Special tokens that take blanks with them are left to the whole text's encoding.
        self.greedy = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])
        self.book = book or {}
        pieces = {i: b for b, i in ranks.items()} | {i: w.encode() for w, i in added.items()}
        size = max(pieces) + 1
        table = [pieces.get(i, b"") for i in range(size)]
        self.length = np.array([len(b) for b in table], np.int64)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        names = [f"{i}," for i in range(size)]
        self.name_length = np.array([len(s) for s in names], np.int64)
        self.names = np.frombuffer("".join(names).encode(), np.uint8)
        self.names_at = np.concatenate([[0], np.cumsum(self.name_length)])
        self.chunks: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.made = self.reused = 0
        self.gear = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)

    def plain(self, text: bytes) -> np.ndarray:
        """Ids of a whole piece of text, with nothing around it."""
        return np.array(self.encoding.encode(text.decode(), allowed_special=set(self.special), disallowed_special=()), np.int32)

    def once(self, text: bytes) -> np.ndarray:
        """``plain``, from the book or kept; the cache is emptied when it is full."""
        got = self.book.get(text)
        if got is None:
            got = self.chunks.get(text)
        if got is None:
            got = self.plain(text)
            self.made += 1
            if self.held > self.p.cache_bytes:
                self.chunks.clear()
                self.held = 0
            self.held += len(text) + got.nbytes + 200
            self.chunks[text] = got
        else:
            self.reused += 1
        return got

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where chunks end: the hash of the last 16 bytes has ``mask_bits`` zeros, the place
        is a character's start, and the chunk before is long enough."""
        n = len(data)
        if n <= self.p.least:
            return np.array([n])
        h = self.gear[data]
        for shift in (1, 2, 4, 8):
            h[shift:] = h[shift:] * np.uint64(0x9E3779B97F4A7C15) + h[:-shift].copy()
        hit = np.flatnonzero((h >> np.uint64(64 - self.p.mask_bits)) == 0) + 1
        hit = hit[(hit < n)]
        hit = hit[(data[hit] & 0xC0) != 0x80]
        out, last = [], 0
        for c in hit.tolist():
            if c - last >= self.p.least:
                out.append(c)
                last = c
        return np.array([*out, n])

    def encode(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text given as UTF-8 bytes."""
        raw = data.tobytes()
        pieces = self.parts.split(raw) if self.parts else [raw]
        if len(pieces) == 1:
            return self._chunked(raw, data)
        if self.greedy:
            return self.once(raw)
        out = [np.array([self.special[x.decode()]], np.int32) if i % 2 else self._chunked(x, np.frombuffer(x, np.uint8)) for i, x in enumerate(pieces) if x]
        return np.concatenate([*out, np.zeros(0, np.int32)])

    def _chunked(self, raw: bytes, data: np.ndarray) -> np.ndarray:
        """Ids of a text without special tokens, from its chunks and the windows between them."""
        if not raw:
            return np.zeros(0, np.int32)
        cuts = self.cuts(data)
        if len(cuts) == 1:
            return self.once(raw)
        safe, n = safe_places(raw), len(raw)
        i, j = np.searchsorted(safe, cuts[:-1]), np.searchsorted(safe, cuts[:-1], "right") - 1
        ends = np.append(safe, n)
        starts = np.append(safe, 0)  # place -1: no safe place before
        windows = list(zip(starts[j].tolist(), ends[i].tolist(), strict=True))
        out, done = [], 0
        for k, (start, stop) in enumerate(zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)):
            lo, hi = windows[k - 1][1] if k else 0, windows[k][0] if k < len(windows) else n
            body = self._part(raw, start, stop, lo, hi) if lo < hi else None
            if body is not None:
                if lo > done:
                    out.append(self.once(raw[done:lo]))
                out.append(body)
                done = hi
        if done < n:
            out.append(self.once(raw[done:]))
        return np.concatenate(out)

    def _part(self, raw: bytes, start: int, stop: int, lo: int, hi: int) -> np.ndarray | None:
        """The ids of chunk [start, stop) between two safe places; None if they cut a token."""
        ids = self.once(raw[start:stop])
        ends = np.cumsum(self.length[ids])
        a = int(np.searchsorted(ends, lo - start)) + 1 if lo > start else 0
        b = int(np.searchsorted(ends, hi - start)) + 1 if hi > start else 0
        if (a and (a > len(ids) or ends[a - 1] != lo - start)) or (b and (b > len(ids) or ends[b - 1] != hi - start)):
            return None
        return ids[a:b]

    @staticmethod
    def _gather(flat: np.ndarray, at: np.ndarray, length: np.ndarray, ids: np.ndarray) -> bytes:
        n = length[ids]
        total = int(n.sum())
        first = np.cumsum(n) - n
        return flat[np.repeat(at[ids] - first, n) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self._gather(self.flat, self.at, self.length, ids).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._gather(self.names, self.names_at, self.name_length, ids)[:-1]


def _chunks(codec: Codec, texts: pa.Array) -> Iterator[bytes]:
    """The chunks that a book may hold."""
    for s in text_slices(texts):
        for i in range(len(s)):
            raw = s.data[s.offsets[i] : s.offsets[i + 1]].tobytes()
            for piece in (codec.parts.split(raw)[::2] if codec.parts else [raw]) if not codec.greedy else ():
                last = 0
                for c in codec.cuts(np.frombuffer(piece, np.uint8)).tolist() if piece else ():
                    if c - last <= codec.p.book_bytes:
                        yield piece[last:c]
                    last = c


def _hashes(chunks: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x) for x in chunks], np.uint64)


def shared_chunks(documents: DataFrame, params: BpeParams, text_col: str = "text") -> dict[bytes, np.ndarray]:
    """The ids of the most frequent chunks that come more than once, each encoded once."""
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = documents.select(F.col(f"`{text_col}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(params)
        for b in batches:
            h, n = np.unique(_hashes(list(_chunks(codec, b.column(0)))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], names=["h", "n"])

    often = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(params.book_chunks)
    wanted = np.sort(np.array([r.h for r in often.select("h").collect()], np.int64))
    if not len(wanted):
        return {}
    sent = spark.sparkContext.broadcast(wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = Codec(params), set()
        for b in batches:
            chunks = [x for x in dict.fromkeys(_chunks(codec, b.column(0))) if x not in seen]
            h = signed(_hashes(chunks))
            at = np.searchsorted(sent.value, h).clip(max=len(sent.value) - 1)
            keep = np.flatnonzero(sent.value[at] == h)
            seen.update(chunks[i] for i in keep)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array([chunks[i] for i in keep], pa.binary())], names=["h", "chunk"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(params)
        for b in batches:
            ids = [codec.plain(x).tobytes() for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    one = texts.mapInArrow(pick, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk"))
    return {bytes(r.chunk): np.frombuffer(r.ids, np.int32) for r in one.select("chunk").mapInArrow(work, "chunk binary, ids binary").collect()}


def _codecs(documents: DataFrame, params: BpeParams, text_col: str):
    """What makes a codec in a task, with the book of shared chunks."""
    book = shared_chunks(documents, params, text_col) if params.book_chunks else {}
    sent = documents.sparkSession.sparkContext.broadcast(book)
    return lambda: Codec(params, sent.value)


def encode(documents: DataFrame, params: BpeParams = BpeParams(), text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Append the ids of each whole text.  The input is read three times: to count chunks, to fetch the shared ones, to encode."""
    codecs = _codecs(documents, params, text_col)

    def make():
        codec = codecs()

        def batch(texts: pa.Array) -> list:
            ids = [codec.encode(s.data[s.offsets[i] : s.offsets[i + 1]]) for s in text_slices(texts) for i in range(len(s))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))]

        return batch

    return append_columns(documents, text_col, [T.StructField(out_col, T.ArrayType(T.IntegerType()))], make)


def decode(encoded: DataFrame, params: BpeParams = BpeParams(), ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the text that the ids spell (null ids: null)."""

    def make():
        codec = Codec(params)
        return lambda ids: [pa.array([None if x is None else codec.decode(np.array(x, np.int32)) for x in ids.to_pylist()], pa.string())]

    return append_columns(encoded, ids_col, [T.StructField(out_col, T.StringType())], make)


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digests(documents: DataFrame, params: BpeParams = BpeParams(), text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """Encode, decode the ids again, and append count and digests; ids stay in the task."""
    codecs = _codecs(documents, params, text_col)

    def make():
        codec = codecs()

        def one(s: Slice, i: int) -> tuple[int, str, str]:
            ids = codec.encode(s.data[s.offsets[i] : s.offsets[i + 1]])
            return len(ids), hashlib.sha256(codec.decimals(ids)).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

        def batch(texts: pa.Array) -> list:
            rows = [one(s, i) for s in text_slices(texts) for i in range(len(s))]
            return [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []]

        return batch

    return append_columns(documents, text_col, DIGEST, make, drop_text)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
