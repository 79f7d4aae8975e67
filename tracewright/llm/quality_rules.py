"""Quality rules: line-first cleaning.

Every line of a text is judged by itself; the lines that fail are removed, and a document that
loses more than ``max_removed`` of its word characters is rejected.  A line with a word fails if

* punctuation: more than ``max_symbols`` of its word characters are one of ``#*$%&|<>``, or
  "!!" comes up more than ``max_shouts`` times a word, or at least ``min_letters`` letters are in
  it and more than ``max_capitals`` of them are ASCII capitals;
* navigation: it has at most ``nav_words`` words and does not end like a sentence;
* boilerplate: it holds one of ``BOILERPLATE`` in any ASCII case; with a ``phrase_share`` above 0,
  phrases are whole words, and only a line of at most ``phrase_words`` words, or one of whose words
  they are at least that share, fails for them (``PROSE``, as the query and the pipeline have it);
* repetition: it equals an earlier line of the same text.

Words are runs of anything but the blanks x20 and x09-x0D.  Beside the verdict stand the base
measures of the text: words, their code points, symbols, repeated lines and repeated 3-word
windows; a text of fewer than ``min_words`` words, or whose repeated windows cover more than half
of its words, fails whatever its lines are.

Defined results: a null or empty text has no words, so it fails; an empty table gives no rows;
repeated rows are judged alike; an input column that is named like a result is replaced.  One pass, no shuffle; a task holds the
hashes of a quarter of a megabyte of text, or of one document if that is longer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._arrow import append_columns
from ._text import BLANKS, Slice, Spans, gram_hashes, lines, mix, span_hashes, spans, text_slices

SYMBOLS = "#*$%&|<>"
ENDINGS = ".!?:;\"')]"
#: Lower-case phrases that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "cookies on this site", "enable javascript", "privacy policy",
    "read more", "share this", "sign in", "subscribe to our newsletter", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class Rules:
    max_symbols: float = 0.1
    max_shouts: float = 0.3
    max_capitals: float = 0.6
    min_letters: int = 10
    nav_words: int = 3
    min_words: int = 50
    max_removed: float = 0.5
    phrase_words: int = 10
    phrase_share: float = 0.0


#: For prose whose lines are whole paragraphs: one phrase does not fail a long line.
PROSE = Rules(phrase_share=0.25)

FIELDS = [
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    *[T.StructField(c, T.LongType()) for c in ("n_lines", "n_bad_lines", "removed_chars")],
]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL, _END = _table(SYMBOLS), _table(ENDINGS)
_ANY = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE), re.IGNORECASE)
_PHRASE = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])(?:" + _ANY.pattern + rb")(?![A-Za-z0-9\x80-\xff])", re.IGNORECASE)
_SHOUT = re.compile(rb"!!")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _counter(mask: np.ndarray) -> np.ndarray:
    """Running count: the number in [a, b) is c[b] - c[a]."""
    c = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=c[1:], dtype=np.int32)
    return c


def _again(key: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _shared(key: np.ndarray) -> np.ndarray:
    """Which keys come up twice or more."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _phrase_words(part: Slice, at: Spans) -> np.ndarray:
    """Words of each line that belong to a boilerplate phrase."""
    # newlines between texts: no phrase goes over from one to the next
    raw = b"\n".join(part.data[a:b].tobytes() for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True))
    found = list(_PHRASE.finditer(raw))
    line = np.searchsorted(at.start + at.docs(), [m.start() for m in found], "right").astype(np.int64) - 1
    return np.bincount(line, np.array([m.group().count(b" ") + 1 for m in found], float), len(at.start))


def line_verdicts(part: Slice, p: Rules) -> dict[str, np.ndarray]:
    """Line spans of a slice, whether each has a word, and whether it is removed."""
    b, w, at = part.data, spans(part), lines(part)
    within = lambda mask, c=None: (c := _counter(mask))[at.end] - c[at.start]
    lead = (b & 0xC0) != 0x80
    first = np.searchsorted(w.start, at.start)
    last = np.searchsorted(w.start, at.end)
    n = last - first
    worded = n > 0
    chars = within(lead & ~BLANKS[b])
    upper = within((b >= 65) & (b <= 90))
    letters = upper + within(((b >= 97) & (b <= 122)) | ((b >= 0x80) & lead))
    raw = b.tobytes()
    line_of = lambda found: np.searchsorted(at.start, [m.start() for m in found], "right").astype(np.int64) - 1
    shouts = np.bincount(line_of(_SHOUT.finditer(raw)), minlength=len(n))
    bad = within(_SYMBOL[b]) > p.max_symbols * chars
    bad |= shouts > p.max_shouts * n
    bad |= (letters >= p.min_letters) & (upper > p.max_capitals * letters)
    tail = np.zeros(len(n), bool)
    tail[worded] = _END[b[w.end[last[worded] - 1] - 1]]
    bad |= (n <= p.nav_words) & ~tail
    if p.phrase_share > 0:
        phrases = _phrase_words(part, at)
        bad |= (phrases > 0) & ((n <= p.phrase_words) | (phrases >= p.phrase_share * n))
    else:
        bad[line_of(_ANY.finditer(raw))] = True
    key = mix(span_hashes(b, at.start, at.end) + at.docs().astype(np.uint64) * _ODD)
    again = np.zeros(len(n), bool)
    again[worded] = _again(key[worded])
    return {"start": at.start, "end": at.end, "bounds": at.bounds, "worded": worded, "chars": chars, "again": again, "bad": (bad | again) & worded}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
    return c[bounds[1:]] - c[bounds[:-1]]


def measure(part: Slice, p: Rules) -> list[np.ndarray]:
    """The columns of ``FIELDS`` for a slice."""
    b, w = part.data, spans(part)
    n_words = w.counts()
    lead = (b & 0xC0) != 0x80
    word_chars = _sums(lead & ~BLANKS[b], part.offsets)
    n_symbols = _sums(_SYMBOL[b], part.offsets)
    g, at = gram_hashes(span_hashes(b, w.start, w.end), w.bounds, 3)
    owner = np.searchsorted(w.bounds, at, "right") - 1
    twice = at[_shared(mix(g + owner.astype(np.uint64) * _ODD))]
    cover = np.zeros(len(w.start), bool)
    for i in range(3):
        cover[twice + i] = True
    n_repeat = _sums(cover, w.bounds)
    v = line_verdicts(part, p)
    removed = _sums(v["chars"] * v["bad"], v["bounds"])
    base = (n_words < p.min_words) | (100 * n_repeat > 50 * n_words)
    kept = ~base & ~(removed > p.max_removed * word_chars)
    return [n_words, word_chars, n_symbols, _sums(v["again"], v["bounds"]), n_repeat, base, kept, _sums(v["worded"], v["bounds"]), _sums(v["bad"], v["bounds"]), removed]


def judge(documents: DataFrame, rules: Rules = Rules(), text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Append ``FIELDS``: the base measures, the verdict ``kept`` and what the lines lost."""

    def batch(texts: pa.Array) -> list:
        parts = [measure(s, rules) for s in text_slices(texts)]
        return [np.concatenate([x[i] for x in parts]) if parts else [] for i in range(len(FIELDS))]

    return append_columns(documents, text_col, FIELDS, lambda: batch, drop_text)


def clean(documents: DataFrame, rules: Rules = Rules(), text_col: str = "text", out_col: str = "clean_text") -> DataFrame:
    """Append the text without the lines that fail (null stays null)."""

    def batch(texts: pa.Array) -> list:
        out = []
        for s in text_slices(texts):
            v = line_verdicts(s, rules)
            raw = s.data.tobytes()
            for d in range(len(s)):
                at = range(v["bounds"][d], v["bounds"][d + 1])
                out.append(b"\n".join(raw[v["start"][i] : v["end"][i]] for i in at if not v["bad"][i]).decode())
        return [pa.array([t if ok else None for t, ok in zip(out, texts.is_valid().to_pylist(), strict=True)], pa.string())]

    return append_columns(documents, text_col, [T.StructField(out_col, T.StringType())], lambda: batch)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), PROSE, drop_text=True)


# RE2 looks neither ahead nor back: with every separator doubled, neighbours do not share one.
_OTHER = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]"
_DOUBLED = "|".join(p.replace(" ", "  ") for p in BOILERPLATE)
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN d USING (doc_id) LEFT JOIN rep USING (doc_id)),
ln AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))),
m AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '!!')) AS shouts,
    coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace(line, '({_OTHER})', '\1\1', 'g'), '(?i)(?:^|{_OTHER})({_DOUBLED})(?:{_OTHER}|$)', 1), lambda x: len(string_split(x, '  ')))), 0) AS phrases,
    len(regexp_extract_all(line, '[A-Z]')) AS capitals, len(regexp_extract_all(line, '[A-Za-z\x{{80}}-\x{{10FFFF}}]')) AS letters,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
v AS (SELECT doc_id, chars, again, again OR symbols > 0.1::DOUBLE * chars OR shouts > 0.3::DOUBLE * n OR (letters >= 10 AND capitals > 0.6::DOUBLE * letters)
    OR (n <= 3 AND NOT regexp_matches(line, '[.!?:;"'')\]][\x20\x09-\x0D]*$'))
    OR (phrases > 0 AND (n <= 10 OR phrases >= 0.25::DOUBLE * n)) AS bad FROM m),
s AS (SELECT doc_id, count(*) AS n_lines, count_if(again) AS n_dup_lines, count_if(bad) AS n_bad_lines,
    coalesce(sum(chars) FILTER (WHERE bad), 0)::BIGINT AS removed_chars FROM v GROUP BY doc_id),
j AS (SELECT base.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_bad_lines, 0) AS n_bad_lines,
    coalesce(removed_chars, 0) AS removed_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT removed_chars > 0.5::DOUBLE * word_chars AS kept, n_lines, n_bad_lines, removed_chars FROM j
"""
