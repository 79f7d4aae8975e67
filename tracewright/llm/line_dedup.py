"""Line dedup over a corpus, in DataFrame expressions only.

Documents are exploded into lines.  A line's key is the line without ASCII blanks at its ends, A-Z
lower-cased; keys are compared by 96 bits of hashes.  Distinct documents are counted for each key
(first by key and document, so that no key meets in one task, then by key, summed where they are).
A key of ``min_chars`` code points or more in ``min_docs`` documents or more loses its lines
everywhere but in the largest doc_id that holds it.  Lines meet the keys to be dropped by hash; the
few keys that could fill a task are sent to all tasks instead (``counted_join``).  What comes back is positions,
gathered by document; texts are shuffled once, to meet their positions, and reassembled in order.

Defined results: a null or empty text is one empty line; ids are counted, so repeats of a row and
several texts of one id count as one document, and all rows of the largest id keep the line; a row with a
null id is no document in the counts, but loses its frequent lines; an empty table gives no rows;
a text of any length and of any number of lines is worked on whole, in time in proportion to it;
columns other than doc_id and text are ignored by ``kept_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._skew import counted_join
from ._work import Work

MIN_CHARS = 20
MIN_DOCS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, same, pos, a, b)``: a row for each line whose key is long enough."""
    # the row's hash is made below the generator, so that no text goes through it; an outer generator, as
    # for others Spark infers a filter that would split every text twice
    rows = documents.select("doc_id", F.xxhash64("text").alias("same"), lines_of(F.col("text")).alias("ls"))
    rows = rows.select("doc_id", "same", F.posexplode_outer("ls").alias("pos", "line"))
    key = F.btrim("line", F.lit(_BLANKS))
    rows = rows.select("doc_id", "same", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    # lower() is fast and right where all letters are ASCII ones
    low = F.when(F.octet_length("key") == F.length("key"), F.lower("key")).otherwise(F.translate("key", _UPPER, _LOWER))
    rows = rows.select("doc_id", "same", "pos", low.alias("key"))
    return rows.select("doc_id", "same", "pos", F.xxhash64("key").alias("a"), F.hash("key").alias("b"))


def frequent_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(a, b, n, last)``: keys of ``min_docs`` documents or more, their lines, and their largest document."""
    each = lines.groupBy("a", "b", "doc_id").agg(F.count("*").alias("n"))
    count = each.groupBy("a", "b").agg(F.count("doc_id").alias("docs"), F.sum("n").alias("n"), F.max("doc_id").alias("last"))
    return count.where(F.col("docs") >= min_docs).select("a", "b", "n", "last")


def kept_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` of every row of ``documents(doc_id, text)``."""
    docs = documents.select("doc_id", "text")
    work = Work(docs.sparkSession, "lines")
    lines = keyed_lines(docs, min_chars)
    frequent = work.table(frequent_keys(lines, min_docs), "frequent")
    met = counted_join(work, lines, frequent, ["a", "b"], "n", [F.col("doc_id"), F.col("same"), F.col("pos")])
    gone = met.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "same").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"), "gone")
    rows = docs.withColumn("same", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")), "left")
    rows = rows.select("doc_id", lines_of(F.col("text")).alias("ls"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone")
    text = F.when(F.size("gone") == 0, F.array_join("ls", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("ls", i)), "\n"))
    return rows.select("doc_id", F.size("ls").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"), text.alias("text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT r, k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
