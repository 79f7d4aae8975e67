"""Masking of volatile values: ordered rewrite rules, each on the output of the one before."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]

# Order, patterns and placeholders define the masked text.
GENERIC: tuple[Rule, ...] = (
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IPV4>"),
    (r"\b[0-9a-fA-F:]{7,39}\b", "<IPV6>"),
    (r"\b([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b", "<MAC>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<HEX>"),
    (r"\bblk_-?\d+\b", "<BLOCK_ID>"),
    (r"\/[\w\-\.\/]+", "<PATH>"),
    (r"https?:\/\/[^\s]+", "<URL>"),
    (r"\b[\w\.-]+@[\w\.-]+\.\w+\b", "<EMAIL>"),
    (r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<TIMESTAMP>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<TIME>"),
    (r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\b", "<DATE>"),
    (r"\b0x[0-9a-fA-F]{6,16}\b", "<MEMADDR>"),
    (r":(\d{1,5})\b", ":<PORT>"),
    (r"\bpid[=:\s]*\d+\b", "pid=<PID>"),
    (r"\btid[=:\s]*\d+\b", "tid=<TID>"),
    (r"\bthread[=:\s]*\d+\b", "thread=<TID>"),
    (r"\b\d{6,}\b", "<NUM>"),
    (r"\b\d{2,5}\b", "<NUM>"),
)
BGL: tuple[Rule, ...] = (
    (r"\bR\d{2}-M\d-N\d-C:J\d{2}-U\d{2}\b", "<NODE>"),
    (r"\bR\d{2}-M\d-N\d(?:-C)?(?:-J\d{2})?(?:-U\d{2})?\b", "<NODE>"),
    (r"\bcore\.\d+\b", "core.<CORE>"),
    (r"\b[0-9a-fA-F]{8}\b", "<HEX8>"),
    (r"\bDDR\(\d+,\d+,\d+\)", "DDR(<MEMLOC>)"),
    (r"\(\d+,\d+,\d+\)", "(<COORD>)"),
)
HDFS: tuple[Rule, ...] = (
    (r"\bblk_-?\d+\b", "<BLOCK>"),
    (r"\b\d+\.\d+\.\d+\.\d+:\d+\b", "<DATANODE>"),
    (r"/user/[\w/]+", "<HDFS_PATH>"),
    (r"/tmp/[\w/]+", "<TMP_PATH>"),
    (r"replicas=\d+", "replicas=<NUM>"),
    (r"size=\d+", "size=<SIZE>"),
)


_FIXED = frozenset((*GENERIC, *BGL, *HDFS))


def rules_for(dataset: str = "", custom: Sequence[Rule] = ()) -> tuple[Rule, ...]:
    """Rules of a data set in any case, after the caller's own; unknown names are generic."""
    own = {"BGL": BGL, "HDFS": HDFS}.get(dataset.upper(), ())
    return (*custom, *own, *GENERIC)


def _replacement(text: str) -> str:
    """A caller's ``\\1`` is Java's ``$1``; other dollars and backslashes are meant as such."""
    return "".join(f"${p[1:]}" if re.fullmatch(r"\\\d", p) else p.replace("\\", "\\\\").replace("$", "\\$") for p in re.split(r"(\\\d)", text))


def literal_of(pattern: str) -> str:
    """The longest piece of text that every match of the pattern holds; empty if none is known."""
    try:
        parsed = sre_parser.parse(pattern)
    except re.error:  # Java's syntax has more
        return ""
    if parsed.state.flags & re.IGNORECASE:
        return ""
    runs, now = [""], ""
    for op, value in parsed:
        now = now + chr(value) if op is sre.LITERAL else ""
        runs.append(now)
    return max(runs, key=len)


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with one reference to ``value``: filters that Spark pushes below a chain of
    projections would else repeat the chain for each reference of each step."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def mask(text: Column, rules: Sequence[Rule]) -> Column:
    """All rules in order; ``(?U)`` makes classes Unicode-aware, and ASCII text does not need it."""

    def chain(flags: str) -> Column:
        out = text
        for pattern, to in rules:
            out = F.regexp_replace(out, flags + pattern, _replacement(to))
        return out

    if not all(to.isascii() for _, to in rules):
        return chain("(?U)")
    return F.when(_is_ascii(text), chain("")).otherwise(chain("(?U)"))


def stat_key(replacement: str) -> str:
    return replacement.strip("<>")


def _step(rule: Rule):
    """How a rule rewrites a text, and how it is counted on (text before, text after)."""
    pattern, to = rule
    must = literal_of(pattern)
    either = lambda fn: F.when(F.col("_a"), fn(pattern)).otherwise(fn(f"(?U){pattern}"))

    def rewritten(x: Column) -> Column:
        changed = either(lambda p: F.regexp_replace(x, p, _replacement(to)))
        return F.when(x.contains(must), changed).otherwise(x) if must else changed

    def counted(s: Column) -> Column:
        worth = s["p"] != s["t"] if rule in _FIXED else s["p"].contains(must)
        return F.when(worth, either(lambda p: F.regexp_count(s["p"], F.lit(p)))).when(s["p"].isNotNull(), 0)

    return rewritten, counted


def mask_columns(df: DataFrame, text: str, rules: Sequence[Rule], out: str = "masked", stats: str | None = None) -> DataFrame:
    """Append the masked text and, if named, the counts by placeholder (none that are zero).

    One projection for each rule: Catalyst keeps a single rewrite chain, and a rule's matches are
    counted on the text as the rules before it left it.  A rule is tried only on text that holds what
    all its matches hold, without Unicode classes on ASCII text, and the matches of the fixed rules
    are counted only where the text has changed, as none of them rewrites a match into itself.
    """
    names = [f"_n{i}" for i in range(len(rules))]
    keep = [c for c in df.columns if c not in (out, stats)]
    plain = all(to.isascii() for _, to in rules)
    now = df.select(*keep, F.col(text).alias("_t")).select("*", (_is_ascii(F.col("_t")) if plain else F.lit(False)).alias("_a"))
    for i, rule in enumerate(rules):
        rewritten, counted = _step(rule)
        if not stats:
            now = now.select(*keep, "_a", _let(F.col("_t"), rewritten).alias("_t"))
            continue
        now = now.select(*keep, "_a", *names[:i], _let(F.col("_t"), lambda x: F.struct(x.alias("p"), rewritten(x).alias("t"))).alias("_s"))  # noqa: B023
        now = now.select(*keep, "_a", *names[:i], _let(F.col("_s"), counted).alias(names[i]), F.col("_s")["t"].alias("_t"))
    extra = []
    if stats:
        keys = list(dict.fromkeys(stat_key(to) for _, to in rules))
        sums = [sum((F.col(names[i]) for i, (_, to) in enumerate(rules) if stat_key(to) == k), F.lit(0)) for k in keys]
        extra = [F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*sums)), lambda _, v: v > 0).alias(stats)]
    return now.select(*keep, F.col("_t").alias(out), *extra)


def compression_ratio(original: Column, masked: Column) -> Column:
    return F.when(original > 0, 1 - masked / original).otherwise(F.lit(0.0))
