"""Language identification with interpolated Kneser-Ney character models.

Words are runs of letters (ASCII letters and characters above x7F), lower-cased.  A language's
model predicts each character of a word, and its end, from up to ``order - 1`` characters before
it in the word.  Spark counts the longest n-grams of all training texts by language; the counts
of shorter ones are Kneser-Ney continuation counts, that is, of distinct longer n-grams.  Every
n-gram counts, so the model grows with the input.  Up to ``max_grams`` rows it is held as sorted
hash arrays, one for each length, with a row of log-probabilities (or of back-off weights) for all
languages, so that a character usually costs one binary search.  Beyond that, continuation counts,
discounts, back-off weights and log-probabilities are Spark aggregations and joins, kept as tables;
tasks hold the most frequent n-grams only, and what a text has besides is looked up by a join of its
distinct n-grams with the tables, so that results are the same at every size.

A text's language is the one with the least cross-entropy for each character.  ``score`` is the
probability that it is right, from a logistic curve over the lead in total log-likelihood and
the lead for each character, fitted on at most ``max_calibration`` training texts that the models
have not counted; ``predict`` gives ``und`` below a score of the caller's choice (none by default).

Defined results: ``und`` with score 0 for null, for texts without a letter, and for all texts if
nothing was learned; ties go to the first language in order; repeated rows are alike; rows with a
null lang teach nothing; empty tables give no rows; a text of any length is scored whole, by one
task; columns named ``lang_pred`` or ``score`` are replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import Columns, append_columns
from ._text import Slice, mix, span_hashes, spans, text_slices
from ._work import Work
from .toxicity import held_out

_U = np.uint64
#: ASCII bytes that are no letters end a word.
WORD_ENDS = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])
_SLICE = 1 << 20


@dataclass(frozen=True)
class LanguageParams:
    """``max_grams``: the rows that the driver and a task hold; more of them are joined, not dropped.

    One row in ``calibration_part``, ``max_calibration`` at most, is kept out of the counts for the
    curve, but none of a language with fewer than ``least_rows``."""

    order: int = 4
    max_grams: int = 400_000
    max_calibration: int = 4_000
    calibration_part: int = 8
    least_rows: int = 16


@dataclass(frozen=True)
class GramTables:
    """``(gram, logs)`` by length: n-grams from 1 to order, contexts from 1 to order - 1."""

    grams: tuple[DataFrame, ...]
    contexts: tuple[DataFrame, ...]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...] = ()
    order: int = 4
    #: By length 1 to order: sorted hashes and log-probabilities by language.
    grams: tuple = ()
    #: By length 1 to order - 1: sorted hashes of contexts and log back-off weights.
    contexts: tuple = ()
    #: Log-probability of a character never seen.
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Logistic curve of the score.
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)
    #: Where the whole model is if ``grams`` holds only the most frequent of the longest n-grams.
    tables: GramTables | None = None


def _distinct_words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the slice's distinct words, each after ``order - 1`` blanks by the caller:
    (bytes' starts, ends) of distinct words, each word's index, and words' bounds by document."""
    w = spans(part, WORD_ENDS)
    _, first, index = np.unique(span_hashes(part.data, w.start, w.end), return_index=True, return_inverse=True)
    return w.start[first], w.end[first], index, w.bounds


def _stream(part: Slice, start: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with ``order - 1`` blanks before each; the places of predicted
    characters (letters, and the blank that ends a word); and the word of each such place."""
    n = end - start
    pad = order - 1
    size = n + pad
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()) + 1, 32, np.uint8)
    inner = np.repeat(start - at - pad, n) + (np.arange(int(n.sum())) + np.repeat(pad * (np.arange(len(n)) + 1), n))
    place = np.arange(int(n.sum())) + np.repeat(pad * (np.arange(len(n)) + 1), n)
    out[place] = part.data[inner]
    points = np.frombuffer(out.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letter = points != 32
    wanted = letter.copy()
    wanted[1:] |= letter[:-1]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    word = np.cumsum(first) - 1
    keep = np.flatnonzero(wanted)
    return points, keep, word[keep]


def _hashes(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each place."""
    h = np.full(len(at), n, np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h + points[at - k].astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return mix(h)


def count_grams(training: DataFrame, params: LanguageParams) -> DataFrame:
    """``(lang, gram, n)`` over all rows of ``training(lang, text)``; tasks add up first."""
    order = params.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bytes], int] = {}

        def flush() -> pa.RecordBatch:
            keys = list(total)
            grams = [np.frombuffer(k[1], np.uint32).tobytes().decode("utf-32-le") for k in keys]
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array(grams, pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])
            total.clear()
            return out

        for b in batches:
            langs = b.column("lang").to_pylist()
            for part in text_slices(pc.utf8_lower(b.column("text").cast(pa.string())), _SLICE):
                start, end, index, bounds = _distinct_words(part)
                if not len(start):
                    continue
                points, at, word = _stream(part, start, end, order)
                rows = np.stack([points[at - k] for k in range(order - 1, -1, -1)], 1)
                packed = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * order))).ravel()
                codes, gram = np.unique(packed, return_inverse=True)
                owner = np.array([hash(x) for x in langs[part.first : part.first + len(part)]])
                doc = np.repeat(np.arange(len(part)), np.diff(bounds))
                for lang in dict.fromkeys(langs[part.first : part.first + len(part)]):
                    mine = (owner == hash(lang))[doc]
                    uses = np.bincount(index[mine], minlength=len(start))
                    sums = np.bincount(gram, uses[word], len(codes)).astype(np.int64)
                    for i in np.flatnonzero(sums):
                        key = (lang, codes[i].tobytes())
                        total[key] = total.get(key, 0) + int(sums[i])
            if len(total) > 500_000:
                yield flush()
        if total:
            yield flush()

    rows = training.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(counts: pd.DataFrame, params: LanguageParams) -> LanguageModel:
    """Kneser-Ney tables from the counts of the longest n-grams."""
    order = params.order
    langs = tuple(sorted(counts["lang"].unique()))
    if not langs:
        return LanguageModel(order=order)
    probs: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
    backs: list[dict[str, np.ndarray]] = [{} for _ in range(order)]
    floor = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table = dict(zip(own["gram"], own["n"], strict=True))
        levels = {order: table}
        for n in range(order - 1, 0, -1):
            lower: dict[str, int] = {}
            for g in levels[n + 1]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            levels[n] = lower
        base = 1.0 / (len(levels[1]) + 1)
        below: dict[str, float] = {}
        for n in range(1, order + 1):
            c = levels[n]
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, v in c.items():
                total[g[:-1]] = total.get(g[:-1], 0) + v
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            gamma = {x: d * kinds[x] / total[x] for x in total}
            now = {g: (v - d) / total[g[:-1]] + gamma[g[:-1]] * (below.get(g[1:], base) if n > 1 else base) for g, v in c.items()}
            if n == 1:
                floor[k] = np.log(gamma[""] * base)
                base_low = gamma[""] * base
            else:
                for x, v in gamma.items():
                    backs[n - 1].setdefault(x, np.zeros(len(langs)))[k] = np.log(v)
            for g, v in now.items():
                probs[n].setdefault(g, np.full(len(langs), np.nan))[k] = np.log(v)
            below, base = now, base_low if n == 1 else base
    # what one language has not seen backs off within that language
    for n in range(1, order + 1):
        for g, row in probs[n].items():
            for k in np.flatnonzero(np.isnan(row)):
                row[k] = floor[k] if n == 1 else (backs[n - 1][g[:-1]][k] if g[:-1] in backs[n - 1] else 0.0) + (probs[n - 1][g[1:]][k] if g[1:] in probs[n - 1] else floor[k])

    return LanguageModel(langs, order, tuple(_arrays(probs[n], n, len(langs)) for n in range(1, order + 1)), tuple(_arrays(backs[n], n, len(langs)) for n in range(1, order)), floor)


def _arrays(rows: dict[str, np.ndarray], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams and their rows of k logs."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros((0, k), np.float32)
    points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    h = _hashes(points, np.arange(n - 1, len(points), n), n)
    o = np.argsort(h)
    return h[o], np.array(list(rows.values()), np.float32)[o]


def build_tables(counts: DataFrame, params: LanguageParams, work: Work) -> LanguageModel:
    """What ``build`` makes, by aggregations and joins over any number of counts."""
    order, spark = params.order, counts.sparkSession
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = work.table(levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n")), "level")
    sums = [F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.sum("n").alias("total"), F.count("*").alias("kinds")]
    stats = {n: {r.lang: r for r in t.groupBy("lang").agg(*sums).collect()} for n, t in levels.items()}
    langs = tuple(sorted(stats[order]))

    def wide(rows: DataFrame, key: str, value: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("gram")).agg(F.array(*[F.max(F.when(F.col("lang") == x, F.log(value))) for x in langs]).alias("logs"))

    def filled(logs: str, other) -> Column:
        return F.array(*[F.coalesce(F.col(logs)[k], other(k)) for k in range(len(langs))]).alias("logs")

    grams: list[DataFrame] = []
    contexts: list[DataFrame] = []
    floor = np.zeros(len(langs))
    below = None
    for n in range(1, order + 1):
        rows = []
        for k, lang in enumerate(langs):
            s = stats[n][lang]
            d = min(0.95, max(0.1, s.ones / (s.ones + 2 * s.twos))) if s.ones else 0.1
            low = d * s.kinds / s.total / (s.kinds + 1)
            rows.append((lang, d, float(s.total), low))
            if n == 1:
                floor[k] = np.log(low)
        fixed = F.broadcast(spark.createDataFrame(rows, "lang string, d double, all double, low double"))
        if below is None:
            below = work.table(levels[n].join(fixed, "lang").select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("all") + F.col("low")).alias("p")), "p")
            grams.append(work.table(wide(below, "gram", "p").select("gram", filled("logs", lambda k: F.lit(float(floor[k])))), "grams"))
            continue
        context, tail = F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("tail")
        known = levels[n].groupBy("lang", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(fixed, "lang")
        known = work.table(known.select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma")), "contexts")
        contexts.append(work.table(wide(known, "context", "gamma").select("gram", filled("logs", lambda k: F.lit(0.0))), "backs"))
        lower = below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
        now = levels[n].select("lang", "gram", "n", context, tail).join(known, ["lang", "context"]).join(lower, ["lang", "tail"])
        below = work.table(now.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), "p")
        # what one language has not seen backs off within that language
        own = wide(below, "gram", "p").select("gram", "logs", context, tail)
        own = own.join(contexts[-1].select(F.col("gram").alias("context"), F.col("logs").alias("back")), "context")
        own = own.join(grams[-1].select(F.col("gram").alias("tail"), F.col("logs").alias("shorter")), "tail")
        grams.append(work.table(own.select("gram", filled("logs", lambda k: F.col("back")[k] + F.col("shorter")[k])), "grams"))
    common = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(max(1, params.max_grams // len(langs)))
    head = {r.gram: np.array(r.logs) for r in grams[-1].join(common.select("gram"), "gram").collect()}
    none = [_arrays({}, n, len(langs)) for n in range(1, order)]
    return LanguageModel(langs, order, (*none, _arrays(head, order, len(langs))), tuple(none), floor, tables=GramTables(tuple(grams), tuple(contexts)))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def char_logs(m: LanguageModel, points: np.ndarray, at: np.ndarray, rest: bool = True) -> np.ndarray:
    """Log-probability of the character at each place, by language; without ``rest``, 0 where the
    longest n-gram is not held."""
    out = np.zeros((len(at), len(m.languages)), np.float32)
    todo = np.arange(len(at))
    for n in range(m.order, 0, -1):
        row, hit = _find(m.grams[n - 1][0], _hashes(points, at[todo], n))
        out[todo[hit]] += m.grams[n - 1][1][row[hit]]
        todo = todo[~hit]
        if not rest:
            return out
        if n > 1 and len(todo):
            row, hit = _find(m.contexts[n - 2][0], _hashes(points, at[todo] - 1, n - 1))
            out[todo[hit]] += m.contexts[n - 2][1][row[hit]]
    out[todo] += m.floor.astype(np.float32)
    return out


def doc_logs(m: LanguageModel, texts: pa.Array, rest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Total log-likelihood of each text by language, and the number of predicted characters."""
    logs, chars = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts))
    if not m.languages:
        return logs, chars
    for part in text_slices(pc.utf8_lower(texts.cast(pa.string())), _SLICE):
        start, end, index, bounds = _distinct_words(part)
        if not len(start):
            continue
        points, at, word = _stream(part, start, end, m.order)
        each = np.stack([np.bincount(word, x, len(start)) for x in char_logs(m, points, at, rest).T], 1)
        n = np.bincount(word, minlength=len(start))
        sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each[index], 0)])
        logs[part.first : part.first + len(part)] = sums[bounds[1:]] - sums[bounds[:-1]]
        count = np.concatenate([[0], np.cumsum(n[index])])
        chars[part.first : part.first + len(part)] = count[bounds[1:]] - count[bounds[:-1]]
    return logs, chars


def _rest(m: LanguageModel, texts: pa.Array) -> Iterator[tuple[Slice, np.ndarray, list[str], np.ndarray]]:
    """Of each slice: documents, n-grams that ``m.grams`` does not hold, and how often they come."""
    for part in text_slices(pc.utf8_lower(texts.cast(pa.string())), _SLICE):
        start, end, index, bounds = _distinct_words(part)
        if not len(start):
            continue
        points, at, word = _stream(part, start, end, m.order)
        _, hit = _find(m.grams[-1][0], _hashes(points, at, m.order))
        at, word = at[~hit], word[~hit]
        rows = np.ascontiguousarray(np.stack([points[at - k] for k in range(m.order - 1, -1, -1)], 1))
        codes, gram = np.unique(rows.view(np.dtype((np.void, 4 * m.order))).ravel(), return_inverse=True)
        pair, uses = np.unique(np.repeat(np.arange(len(part)), np.diff(bounds)) * len(start) + index, return_counts=True)
        lo = np.searchsorted(word, pair % len(start))
        n = np.searchsorted(word, pair % len(start), "right") - lo
        place = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key, which = np.unique(np.repeat(pair // len(start), n) * max(1, len(codes)) + gram[place], return_inverse=True)
        times = np.bincount(which, np.repeat(uses, n), len(key)).astype(np.int64)
        names = [c.tobytes().decode("utf-32-le") for c in codes]
        yield part, key // max(1, len(codes)), [names[i] for i in key % max(1, len(codes))], times


def _resolved(m: LanguageModel, wanted: DataFrame) -> DataFrame:
    """``(gram, logs)`` of any n-grams of the full length, as ``char_logs`` has them."""
    t, order, size = m.tables, m.order, range(len(m.languages))
    single = lambda c: F.transform(c, lambda v: v.cast("float"))
    rows = wanted.select("gram")
    for n in range(order, 0, -1):
        rows = rows.withColumn("_k", F.substring("gram", order - n + 1, n)).join(t.grams[n - 1].select(F.col("gram").alias("_k"), single("logs").alias(f"p{n}")), "_k", "left").drop("_k")
        if n > 1:
            rows = rows.withColumn("_k", F.substring("gram", order - n + 1, n - 1)).join(t.contexts[n - 2].select(F.col("gram").alias("_k"), single("logs").alias(f"b{n}")), "_k", "left").drop("_k")
    out = []
    for k in size:
        backs, cases = F.lit(0.0).cast("float"), None
        for n in range(order, 0, -1):
            value = backs + F.col(f"p{n}")[k]
            cases = F.when(F.col(f"p{n}").isNotNull(), value) if cases is None else cases.when(F.col(f"p{n}").isNotNull(), value)
            if n > 1:
                backs = backs + F.coalesce(F.col(f"b{n}")[k], F.lit(0.0).cast("float"))
        out.append(cases.otherwise(backs + F.lit(float(m.floor[k])).cast("float")).cast("double"))
    return rows.select("gram", F.array(*out).alias("logs"))


_KEY = [T.StructField("_lid1", T.LongType()), T.StructField("_lid2", T.LongType())]


def _text_keys(texts: pa.Array) -> np.ndarray:
    import xxhash

    digests = b"".join(xxhash.xxh3_128_digest((t or "").encode()) for t in texts.to_pylist())
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _joined_logs(documents: DataFrame, m: LanguageModel, text_col: str, drop_text: bool) -> DataFrame:
    """Append ``_lid``: logs by language, predicted characters, whether there is a letter.  What tasks
    do not hold is joined by distinct n-grams and added up by text."""
    sent = documents.sparkSession.sparkContext.broadcast(replace(m, tables=None))
    work = Work(documents.sparkSession, "language")

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _text_keys(b.column(0))
            for part, doc, grams, n in _rest(sent.value, b.column(0)):
                k = keys[part.first + doc]
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(grams, pa.string()), pa.array(n)], names=["_lid1", "_lid2", "gram", "n"])

    def held() -> Columns:
        def batch(texts: pa.Array) -> list:
            k = _text_keys(texts)
            logs, chars = doc_logs(sent.value, texts, rest=False)
            return [k[:, 0], k[:, 1], logs.tolist(), chars, _letters(texts, chars)]

        return batch

    keys = [f.name for f in _KEY]
    # copies of a text have the same n-grams: one of them counts
    found = documents.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(misses, "_lid1 long, _lid2 long, gram string, n long").groupBy(*keys, "gram").agg(F.max("n").alias("n"))
    found = work.table(found, "rest")
    logs = work.table(_resolved(m, found.select("gram").distinct()), "logs")
    sums = found.join(logs, "gram").groupBy(*keys).agg(F.array(*[F.sum(F.col("n") * F.col("logs")[k]) for k in range(len(m.languages))]).alias("_lid_rest"))
    fields = [*_KEY, T.StructField("_lid_logs", T.ArrayType(T.DoubleType())), T.StructField("_lid_chars", T.DoubleType()), T.StructField("_lid_letters", T.BooleanType())]
    rows = append_columns(documents, text_col, fields, held, drop_text)
    both = F.coalesce(F.zip_with("_lid_logs", "_lid_rest", lambda x, y: x + y), F.col("_lid_logs"))
    own = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("_lid")]
    return rows.join(sums, keys, "left").select(*own, F.struct(both.alias("logs"), F.col("_lid_chars").alias("chars"), F.col("_lid_letters").alias("letters")).alias("_lid"))


def _letters(texts: pa.Array, chars: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    out = chars > 0
    # characters above x7F need not be letters: look closely where no ASCII letter is
    none = ~np.array(pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), r"[A-Za-z]"), False))
    for i in np.flatnonzero(none & out):
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def _leads(logs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language, and how far it leads the next: log of the total, and for a character."""
    if logs.shape[1] < 2:
        return np.zeros(len(logs), int), np.stack([np.zeros(len(logs)), np.zeros(len(logs))], 1)
    best = logs.argmax(1)
    top = np.sort(logs, 1)
    lead = top[:, -1] - top[:, -2]
    return best, np.stack([np.log1p(lead), lead / np.maximum(chars, 1)], 1)


def fit(training: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Count over ``training(doc_id, lang, text)``, build, and fit the score's curve on rows that are not counted."""
    work = Work(training.sparkSession, "language")
    known = training.where("lang IS NOT NULL AND text IS NOT NULL")
    # ids are chosen first, so that only chosen texts move
    least = known.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= params.least_rows).select("lang")
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(params.calibration_part)) == 0).join(least, "lang", "left_semi").where("doc_id IS NOT NULL")
    chosen = work.table(chosen.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_calibration), "chosen")
    counted = known.join(F.broadcast(chosen), "doc_id", "left_anti")
    counts = work.table(count_grams(counted, params), "counts")
    m = build(counts.toPandas(), params) if counts.count() <= params.max_grams else build_tables(counts, params, work)
    if len(m.languages) < 2:
        return replace(m, curve=(3.0, 0.0, 0.0))
    some = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.lang", "r.text")

    got = _with_logs(some, m, "text", True).select("lang", "_lid.logs", "_lid.chars").toPandas()
    if m.tables is None:
        work.keep()
    if got.empty:
        return replace(m, curve=(1.0, 0.0, 0.0))
    best, x = _leads(np.array(got["logs"].tolist()).reshape(len(got), len(m.languages)), got["chars"].to_numpy())
    x = np.column_stack([x, np.ones(len(x))])
    y = np.clip(np.array(m.languages)[best] == got["lang"].to_numpy(), 0.001, 0.999)
    w = np.zeros(3)
    for _ in range(30):  # ridge-damped Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * w)
    return replace(m, curve=tuple(w.tolist()))


def _with_logs(documents: DataFrame, m: LanguageModel, text_col: str, drop_text: bool) -> DataFrame:
    """Append ``_lid(logs, chars, letters)``; no shuffle if tasks hold the whole model."""
    if m.tables is not None:
        return _joined_logs(documents, m, text_col, drop_text)
    sent = documents.sparkSession.sparkContext.broadcast(m)

    def make() -> Columns:
        def batch(texts: pa.Array) -> list:
            logs, chars = doc_logs(sent.value, texts)
            kinds = [pa.list_(pa.float64()), pa.float64(), pa.bool_()]
            made = [pa.array(x, k) for x, k in zip([logs.tolist(), chars, _letters(texts, chars)], kinds, strict=True)]
            return [pa.StructArray.from_arrays(made, ["logs", "chars", "letters"])]

        return batch

    kind = T.StructType([T.StructField("logs", T.ArrayType(T.DoubleType())), T.StructField("chars", T.DoubleType()), T.StructField("letters", T.BooleanType())])
    return append_columns(documents, text_col, [T.StructField("_lid", kind)], make, drop_text)


def predict(documents: DataFrame, model: LanguageModel, text_col: str = "text", drop_text: bool = False, reject_below: float = 0.0) -> DataFrame:
    """Append ``lang_pred`` and ``score``; texts that score below ``reject_below`` are ``und`` and keep
    their score."""
    names, curve = np.array([*model.languages, "und"], object), np.array(model.curve)

    def make() -> Columns:
        def batch(found: pa.StructArray) -> list:
            if len(names) == 1:
                return [["und"] * len(found), np.zeros(len(found))]
            logs = np.array(found.field("logs").flatten()).reshape(len(found), len(names) - 1)
            best, x = _leads(logs, np.array(found.field("chars")))
            score = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(len(x))]) @ curve)))
            und = ~np.array(found.field("letters")).astype(bool)
            return [names[np.where(und | (score < reject_below), len(names) - 1, best)].tolist(), np.where(und, 0.0, score)]

        return batch

    return append_columns(_with_logs(documents, model, text_col, drop_text), "_lid", [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, drop_text=True)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = held_out(4, 2)
    model = fit(docs.where(~fold).select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", "text"), model, drop_text=True).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
