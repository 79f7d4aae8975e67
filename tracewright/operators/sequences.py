"""Sessions as arrays of token ids (SEQ1-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import retrieval_tokens
from ..functions.quantiles import exact_quantiles
from ..functions.rank import hash_rank

BOS, EOS, FIRST = 1, 2, 3


def vocabulary(sessions: DataFrame, size: int = 50_000) -> DataFrame:
    """``(term, id)`` of the most frequent tokens; ids from 3 on, by falling count, then term."""
    words = sessions.select(F.explode("lines").alias("line")).select(F.explode(retrieval_tokens(F.col("line"))).alias("term"))
    top = words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    order = F.row_number().over(_all().orderBy(F.desc("n"), "term"))  # over the bounded vocabulary only
    return top.select("term", (order + FIRST - 1).cast("int").alias("id"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def hashed_id(token: Column, buckets: int) -> Column:
    return (F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)) + FIRST).cast("int")


def token_ids(lines: Column, buckets: int = 50_000, max_len: int | None = None) -> tuple[Column, Column]:
    """Ids and segment ids of a session: a start mark, and an end mark after every line; ids are
    hashed, the segment is the line's place.  Both are cut alike."""
    of_line = lambda line: F.concat(F.transform(retrieval_tokens(line), lambda t: hashed_id(t, buckets)), F.array(F.lit(EOS)))
    start = lambda i: F.when(i == 0, F.array(F.lit(BOS))).otherwise(F.array().cast("array<int>"))
    ids = F.flatten(F.transform(lines, lambda line, i: F.concat(start(i), of_line(line))))
    sizes = lambda line, i: F.size(retrieval_tokens(line)) + 1 + F.when(i == 0, 1).otherwise(0)
    segments = F.flatten(F.transform(lines, lambda line, i: F.array_repeat(i, sizes(line, i))))
    return (ids, segments) if max_len is None else (F.slice(ids, 1, max_len), F.slice(segments, 1, max_len))


def with_ids(sessions: DataFrame, buckets: int = 50_000, max_len: int | None = None) -> DataFrame:
    ids, segments = token_ids(F.col("lines"), buckets, max_len)
    return sessions.select("*", ids.alias("input_ids"), segments.alias("segment_ids"))


def with_vocabulary_ids(sessions: DataFrame, words: DataFrame, unknown: int = 0) -> DataFrame:
    """``with_ids`` with the ids of a fitted ``vocabulary``; words that it lacks get ``unknown``.

    Distinct words are joined, not occurrences of them: a session takes its own words' ids back as
    a map, so that a frequent word is one row for each session.
    """
    own = sessions.select("session_id", F.explode(F.array_distinct(F.flatten(F.transform("lines", retrieval_tokens)))).alias("term"))
    known = own.join(words.select("term", "id"), "term").groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "id"))).alias("_ids"))
    ids = F.coalesce("_ids", F.create_map().cast("map<string,int>"))
    of_line = lambda line: F.concat(F.transform(retrieval_tokens(line), lambda t: F.coalesce(F.try_element_at(F.col("_known"), t), F.lit(unknown))), F.array(F.lit(EOS)))
    joined = sessions.join(known, "session_id", "left").withColumn("_known", ids).drop("_ids")
    _, segments = token_ids(F.col("lines"))
    return joined.select(*sessions.columns, F.concat(F.array(F.lit(BOS)), F.flatten(F.transform("lines", of_line))).alias("input_ids"), segments.alias("segment_ids"))


def padded(ids: Column, size: Column | int) -> Column:
    """Zeros on the right up to ``size``, cut beyond it."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), F.greatest(size - F.size(ids), F.lit(0)))), F.lit(1), size)


def mask_of(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != 0).cast("int"))


def clamped(segments: Column, most: int) -> Column:
    return F.transform(segments, lambda x: F.least(x, F.lit(most - 1)))


def length_profile(tokenized: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: 90 % and 95 % points (linear, cut to whole numbers), longest, mean."""
    n = F.size("input_ids").cast("double")
    facts = tokenized.agg(F.max(n).cast("int").alias("max_len"), F.avg(n).alias("mean_len"), *([F.percentile_approx(n, [0.9, 0.95]).alias("_q")] if approximate else []))
    if approximate:
        points = [F.get("_q", F.lit(i)) for i in (0, 1)]
    else:
        points = [F.lit(q).cast("double") for q in exact_quantiles(tokenized.select(n.alias("n")), [0.9, 0.95])]
    return facts.select(points[0].cast("int").alias("p90"), points[1].cast("int").alias("p95"), "max_len", "mean_len")


def length_batches(tokenized: DataFrame, key: str = "session_id", budget: int = 16_384, step: int = 64, seed: object = 42) -> DataFrame:
    """Append ``batch``, ``width`` and ``padded_ids``: rows of like length together, padded to their batch's own longest.

    A row belongs to the range of lengths ``(k - 1) * step + 1 .. k * step``; in a range as many rows make a batch as ``budget`` tokens
    hold at the range's end, at least one, in the order of a hash.  Rows are numbered by counts of hash ranges, so no window
    holds a whole range.
    """
    n = F.size("input_ids")
    ranged = tokenized.withColumn("_k", F.greatest(F.ceil(n / step), F.lit(1)).cast("int"))
    placed = hash_rank(ranged, ["_k"], key, seed, "_rank")
    each = F.greatest(F.floor(F.lit(budget) / (F.col("_k") * step)), F.lit(1))
    placed = placed.withColumn("batch", F.concat(F.col("_k").cast("string"), F.lit("_"), F.floor(F.col("_rank") / each).cast("string"))).drop("_k", "_rank")
    widths = placed.groupBy("batch").agg(F.max(n).alias("width"))
    return placed.join(widths, "batch").withColumn("padded_ids", padded(F.col("input_ids"), F.col("width")))


def max_segments(tokenized: DataFrame) -> DataFrame:
    return tokenized.agg(F.coalesce(F.max(F.array_max("segment_ids") + 1), F.lit(0)).alias("max_segments"))


def model_inputs(tokenized: DataFrame) -> DataFrame:
    return tokenized.select("input_ids", "segment_ids", F.col("label").alias("session_label"))
