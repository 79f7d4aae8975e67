"""Projections and predicates over one log line (PRJ1-9) and the retrieval tokens (RET3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_KEY = r"(blk_-?\d+)"


def stripped(line: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def anomalous(line: Column) -> Column:
    """The first character is not ``-``; null for an empty line."""
    return F.when(F.length(line) > 0, ~line.startswith("-"))


def message(line: Column) -> Column:
    """What follows the first blank; the whole line if it has none."""
    return F.substring(line, F.instr(line, " ") + 1, F.length(line))


def cleaned(line: Column) -> Column:
    """Brackets and separators out, all-capital words lowered, camel case split, all lowered."""
    t = F.regexp_replace(line, r"[\]\[)(=,;]", " ")
    words = F.transform(F.split(t, " "), lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), F.lower(w)).otherwise(w))
    t = F.array_join(words, " ")
    t = F.regexp_replace(t, "([A-Z]+)", r" $1")
    t = F.regexp_replace(t, "([A-Z][a-z]+)", r" $1")
    return F.lower(F.trim(F.regexp_replace(t, " +", " ")))


def tokens(line: Column) -> Column:
    """White-space tokens, repeats kept, none empty."""
    return F.array_remove(F.split(line, r"\s+"), "")


def retrieval_tokens(text: Column) -> Column:
    return tokens(F.lower(text))


def log_time(line: Column) -> Column:
    """Time of ``yyMMdd HHmmss`` at the start of a line; null if it is none."""
    t = tokens(line)
    return F.try_to_timestamp(F.concat_ws(" ", F.get(t, F.lit(0)), F.get(t, F.lit(1))), F.lit("yyMMdd HHmmss"))


def first_key(line: Column, pattern: str = BLOCK_KEY) -> Column:
    """The first match of the pattern's group; null if there is none."""
    k = F.regexp_extract(line, pattern, 1)
    return F.when(k != "", k)


def only_key(line: Column, pattern: str = BLOCK_KEY) -> Column:
    """The one distinct match; null if there is none or there are several."""
    k = F.array_distinct(F.regexp_extract_all(line, F.lit(pattern), 1))
    return F.when(F.size(k) == 1, F.get(k, F.lit(0)))


def long_enough(line: Column, least: int = 2) -> Column:
    return F.size(tokens(line)) >= least


def window_id(start: Column) -> Column:
    return F.format_string("BGL_%08d", start)


def key_id(key: Column) -> Column:
    return F.concat(F.lit("HDFS_"), key)


def evidence_id(session_id: Column) -> Column:
    return F.concat(F.lit("E_"), session_id)


def label_flag(label: Column, exact: bool = False) -> Column:
    """1 for "anomaly" in any case (``exact``: only "Anomaly"), numbers as they are, else 0."""
    word = label.cast("string")
    number = F.lit(None).cast("int") if exact else word.try_cast("int")
    hit = word == "Anomaly" if exact else F.lower(word) == "anomaly"
    return F.coalesce(F.when(hit, 1), number, F.lit(0))
