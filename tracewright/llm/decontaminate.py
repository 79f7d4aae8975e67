"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are runs of ASCII letters and digits and of characters above x7F, A-Z lower-cased.  A
window is 10 consecutive words of a benchmark item.  Of the hashes of all 5-word grams, every
least one of each 6 in a row is a fingerprint, in documents and items alike; so any 10 words that
both hold have a fingerprint in common, at the same place in them, whatever stands around.  Each
fingerprint carries the word hashes around it.  Fingerprints are joined, and a meeting is extended:
it hits where one of the six windows that hold the fingerprint has equal words on both sides.
Items of fewer than 10 words are one window and are met by grams of their own length.

No text is shuffled.  The item side is broadcast only if it has at most ``small`` fingerprints, and
each document is then read once.  Otherwise both sides are shuffled, and a first pass over the
documents finds the grams that hold a large share of their fingerprints (``hot_grams``, at most 1,000):
their entries are spread over 64 parts by document, and the items' entries of these grams are repeated
for each part.  Which grams are found changes the plan's balance and no result.  Words are compared by
64-bit hashes.

Defined results: a null or empty text has no words and no hits; items without words are never met;
empty tables give no rows and no hits; repeated documents come back as often as they came; repeated
items count once, as ids are a set; several texts of one id are judged one by one; a text of any
length is one row of one task; columns other than doc_id, item_id and text are ignored by ``hits``,
whatever their names, and kept by ``decontaminate``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 10
GRAM = 5
GRAMS = WINDOW - GRAM + 1
#: The most benchmark fingerprints that are broadcast.
SMALL = 500_000
#: A gram with about this share of all document fingerprints is spread; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Parts over which a hot gram is spread.
PARTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(hashes: str, n: int) -> Column:
    """Hashes of all ``n`` consecutive entries of a column of word hashes."""
    h = F.col(hashes)
    at = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)])
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), at)).otherwise(F.array().cast("array<bigint>"))


def hashed_words(df: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and ``h``, the hashes of the words of ``text``."""
    return df.select(*keep, words(F.col("text")).alias("w")).select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).drop("w")


def fingerprints(hashed: DataFrame, *keep: str) -> DataFrame:
    """``fps``, an array of (at, gram, around): the word hashes from five words before ``at`` to the
    end of the last window that starts there, null beyond the text's ends."""
    g, m = F.col("g"), F.col("m")
    staged = hashed.select(*keep, "h", _grams("h", GRAM).alias("g"))
    least = lambda i: F.least(*[F.get(g, i + j) for j in range(GRAMS)])
    whole = F.size("h") >= WINDOW
    staged = staged.select("*", F.when(whole, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), least)).otherwise(F.array().cast("array<bigint>")).alias("m"))
    chosen = lambda x, i: F.greatest(*[F.get(m, i - j) for j in range(GRAMS)]) == x
    picked = F.filter(F.transform(g, lambda x, i: F.when(chosen(x, i), F.struct(i.alias("at"), x.alias("gram")))), lambda x: x.isNotNull())
    staged = staged.select(*keep, "h", picked.alias("picked"))
    around = lambda at: F.transform(F.sequence(at - (GRAMS - 1), at + (WINDOW - 1)), lambda k: F.get("h", k))
    return staged.select(*keep, "h", F.transform("picked", lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram"), F.lit(WINDOW).alias("n"), around(x["at"]).alias("around"))).alias("fps"))


def short_grams(n: int) -> Column:
    """All grams of ``n`` words, for items that have no more; in the form of ``fps``."""
    none = F.lit(None).cast("array<bigint>")
    return F.transform(_grams("h", n), lambda x, i: F.struct(i.alias("at"), x.alias("gram"), F.lit(n).alias("n"), none.alias("around")))


def hot_grams(rows: DataFrame, share: float = HOT_SHARE) -> list[int]:
    """Grams that hold about ``share`` of ``rows`` or more, by a summary of fixed size in each task."""
    most = math.ceil(1 / share)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(gram, {most}, {10 * most})").alias("top"))
    near = found.select("n", F.explode("top").alias("x")).where(F.col("x.count") >= share * F.col("n"))
    return sorted(r[0] for r in near.select("x.item").where("item IS NOT NULL").collect())


def _spread(rows: DataFrame, prints: DataFrame, hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part``, by which entries of hot grams meet in ``PARTS`` parts, and others in one."""
    known = F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in hot], "hot bigint"))
    marked = lambda df: df.join(known, F.col("gram") == F.col("hot"), "left")
    is_hot = F.col("hot").isNotNull()
    part = F.when(is_hot, F.pmod(F.xxhash64("doc_id", "same", "at"), F.lit(PARTS)).cast("int")).otherwise(0)
    parts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    return marked(rows).withColumn("part", part).drop("hot"), marked(prints).withColumn("part", parts).drop("hot")


def hits(documents: DataFrame, benchmark: DataFrame, small: int = SMALL) -> DataFrame:
    """One row for each document row, with what it shares with the items of ``benchmark``.

    ``(doc_id, n_words, n_hit, n_items, items, contaminated)``; ``items`` is sorted.
    """
    # The generators are outer ones: for the others Spark infers a filter on the array and pushes
    # it below the projections, where every array would be made anew for each entry of the next.
    items = hashed_words(benchmark, F.col("item_id").cast("string").alias("item")).where(F.size("h") > 0)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("h"), F.lit(WINDOW))).distinct().collect())
    short = [n for n in lengths if n < WINDOW]
    keys = ["doc_id", "same", "n_words"]
    docs = hashed_words(documents, F.col("doc_id"), F.xxhash64("text").alias("same")).select("*", F.size("h").alias("n_words"))

    prints = fingerprints(items.where(F.size("h") >= WINDOW), "item").select("item", F.inline_outer("fps").alias("at", "gram", "n", "theirs")).drop("at").where("gram IS NOT NULL")
    for n in short:
        whole = F.get(_grams("h", n), F.lit(0))
        prints = prints.unionByName(items.where(F.size("h") == n).select("item", whole.alias("gram"), F.lit(n).alias("n"), F.lit(None).cast("array<bigint>").alias("theirs")))
    prints = prints.distinct()
    # each row also has an entry that meets nothing, under a key of its own
    lone = F.array(F.struct(F.lit(-1).alias("at"), F.xxhash64("doc_id", "same").alias("gram"), F.lit(-1).alias("n"), F.lit(None).cast("array<bigint>").alias("around")))
    entries = fingerprints(docs, *keys).select(*keys, F.concat(lone, "fps", *map(short_grams, short)).alias("e"))
    rows = entries.select(*keys, F.inline_outer("e").alias("at", "gram", "n", "around"))
    on = ["gram", "n"]
    if prints.count() <= small:
        prints = F.broadcast(prints)
    elif hot := hot_grams(rows):
        rows, prints = _spread(rows, prints, hot)
        on.append("part")
    met = rows.join(prints, on, "left").where("at < 0 OR item IS NOT NULL")
    # a window is hit where its ten words are equal on both sides; it starts j words before the fingerprint
    first = lambda j: GRAMS - 1 - j
    window = lambda c, j: F.slice(c, first(j) + 1, WINDOW)
    inside = lambda j: F.get("around", F.lit(first(j))).isNotNull() & F.get("around", F.lit(first(j) + WINDOW - 1)).isNotNull()
    equal = [F.when(inside(j) & (window("around", j) == window("theirs", j)), F.col("at") - j) for j in range(GRAMS)]
    starts = F.when(F.col("n") == WINDOW, F.filter(F.array(*equal), lambda x: x.isNotNull())).when(F.col("n") > 0, F.array("at")).otherwise(F.array().cast("array<int>"))
    met = met.select(*keys, "at", "n", "item", starts.alias("starts")).where("at < 0 OR size(starts) > 0")
    met = met.select(*keys, "at", "item", F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("n")).alias("e"))).alias("spans"))

    grouped = met.groupBy(*keys).agg(
        F.count_if(F.col("at") < 0).cast("int").alias("times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.size("spans") > 0, F.col("item")))).alias("items"),
    )
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).cast("bigint").alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")), step)["n"]
    out = grouped.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "times")
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("_", "times").withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a window of an item (rows with null ids stay)."""
    bad = hits(documents.select("doc_id", "text"), benchmark).where("contaminated").select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti").select(*documents.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
itemw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM itemw WHERE len(w) > 0)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM dw),
grams AS (SELECT doc_id, n, i, words FROM (SELECT doc_id, n, i, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS k
  FROM pos, (SELECT DISTINCT n FROM win) WINDOW f AS (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)) WHERE k = n),
met AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
