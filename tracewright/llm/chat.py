"""Chat formatting by cumulative-snapshot collapse, in DataFrame expressions only.

Services log a conversation again after each turn, so many logged conversations are prefixes of
longer ones.  A rolling hash of the turns (place, role, text) gives each prefix of a conversation a
128-bit name.  A conversation whose whole name is a proper prefix's name of any other goes (anti-join);
of equal ones the least id stays.  What remains is rendered, whole, as one text.

The prefix names are reduced to the distinct ones before the join, so a first turn or a
conversation that a third of all rows share is one row of that join.  Texts are shuffled once,
for the conversations that stay.

Rendering: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn; a marker inside a role or a text
is broken by a space after ``<``, so that no text can open or close a turn.

Defined results: turns are ordered by (turn, role, text), nulls first, whatever order rows come
in; exact repeats of a row (as logs give) count once; a null text is empty and a null role is
"unknown"; rows with a null conv_id are left out; a text of any length is rendered whole; columns
other than conv_id, turn, role and text are ignored, whatever their names; no rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARK = r"<(\|im_(?:start|end)\|>)"


def _safe(c: Column) -> Column:
    return F.regexp_replace(c, _MARK, "< $1")


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_logged)`` of the conversations that no longer one begins with;
    ``n_logged`` counts the equal ones that it stands for."""
    one = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("x"), F.hash("text", "role").alias("y"), "role", F.md5(F.encode("text", "UTF-8")).alias("key")
    ).distinct()
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "key")
    placed = one.select("conv_id", "x", "y", F.row_number().over(w).alias("i"))
    named = placed.select("conv_id", "i", F.xxhash64("i", "x", "y").alias("a"), F.xxhash64("y", "i", "x", F.lit(7)).alias("b"))
    run = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rolled = named.select("conv_id", "i", F.bit_xor("a").over(run).alias("a"), F.bit_xor("b").over(run).alias("b"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    whole = rolled.where("i = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    prefixes = rolled.where("i < n").select(F.col("i").alias("n"), "a", "b").distinct()
    return whole.join(prefixes, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").cast("bigint").alias("n_turns"), "n_logged")


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, rendered)`` of whole conversations."""
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    t = t.withColumn("key", F.md5(F.encode("text", "UTF-8")))
    each = lambda x: F.concat(F.lit("<|im_start|>"), _safe(x["role"]), F.lit("\n"), _safe(x["text"]), F.lit("<|im_end|>\n"))
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "text"))).alias("t"))
    return whole.select("conv_id", F.array_join(F.transform("t", each), "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations with their turns and rendered text."""
    top = maximal(turns)
    kept = turns.join(top.select("conv_id"), "conv_id", "left_semi")
    return top.join(render(kept), "conv_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "n_turns", "n_logged", "rendered")


_TURN = "replace(replace({}, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')"
OP3_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM t),
c AS (SELECT conv_id, i, string_agg(md5(role || chr(10) || text), '/') OVER (PARTITION BY conv_id ORDER BY i) AS pre, count(*) OVER (PARTITION BY conv_id) AS n FROM h),
w AS (SELECT pre, min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_logged FROM c WHERE i = n GROUP BY pre),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.i < c.n AND c.pre = w.pre)),
r AS (SELECT conv_id, string_agg('<|im_start|>' || {_TURN.format("role")} || chr(10) || {_TURN.format("text")} || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered FROM h GROUP BY conv_id)
SELECT conv_id, n_turns, n_logged, rendered FROM m JOIN r USING (conv_id)
"""
