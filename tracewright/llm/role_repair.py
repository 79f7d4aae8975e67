"""Conversation structure repair: generalised LR parsing with weighted edits.

A conversation is right if its role initials are ``(s?(ua)+)?``.  As a grammar, with what is open
before a pair as a symbol of its own:

    C -> nothing | T        T -> O u a        O -> nothing | s | T

``_ACTION`` and ``_GOTO`` are its LR tables.  The parser keeps a graph-structured stack: one node for
each stack top that the rows so far can leave, with a link to the node that it came from.  A row is kept (0), reroled to user
or assistant (1) or deleted (2, and the only way for a blank or a repeated one); before it, and at the
end, turns with empty text can be inserted (5 each); a truncated row costs 5 unless it is
deleted.  Nodes with equal tops are merged: the least (cost, audit) stays, where the audit is the
edits' initials in order.  Below a top there is one stack only, so what a row does to a top is found once by
running the LR automaton, for each kind of row, and kept (``_moves``).

Audits are compared without being spelled out: the audits of two nodes of one frontier end with a
row's own edit and cover equally many rows, so neither begins with the other, and their order is kept as a rank.

How it runs: rows are dealt by conversation, sorted, and parsed as they stream by.  A conversation of more than
``segment_rows`` rows or ``segment_bytes`` goes another way, with equal results: its rows are counted
(repeats become one row), dealt by ranges of (turn, role, text), and each range is parsed from every
possible top at once; ranges are then joined in order by least (cost, audit), and each range is
replayed with the edits that this has chosen.  So no task holds such a conversation; its audit alone is one value.

Defined results: rows are ordered by turn (nulls first), then role, then text, whatever order they
come in; a null role or text is one space; a null conv_id is a conversation of its own; repeated
rows are rows (each but the first a duplicate); roles are judged by their first character alone; an empty table
gives none; a text of any length is one row; columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import bounded_batches
from ._skew import counted_join
from ._work import Work

_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 1, 2, 5, 5
_ROLE = {"u": "user", "a": "assistant"}

#: Rules by number: what they make, and of how many symbols.
_RULES = {"none": ("O", 0), "system": ("O", 1), "more": ("O", 1), "pair": ("T", 3)}
#: LR states: 0 nothing read, 1 after s, 2 after T, 3 after O, 4 after O u, 5 after O u a.  A number shifts.
_ACTION: dict[tuple[int, str], int | str] = {
    (0, "s"): 1, (0, "u"): "none", (0, "$"): "accept", (1, "u"): "system", (2, "u"): "more", (2, "$"): "accept",
    (3, "u"): 4, (4, "a"): 5, (5, "u"): "pair", (5, "$"): "pair",
}
_GOTO = {(0, "O"): 3, (0, "T"): 2}
#: The stack below each top that a frontier can have.
_BELOW = {0: (), 1: (0,), 4: (0, 3), 5: (0, 3, 4)}
TOPS = tuple(_BELOW)


@cache
def _read(top: int, terminal: str) -> int | None:
    """The top after a terminal, or, after ``$``, 0 if all is accepted; None if it cannot stand here."""
    stack = [*_BELOW[top], top]
    while True:
        act = _ACTION.get((stack[-1], terminal))
        if act is None or act == "accept":
            return None if act is None else 0
        if isinstance(act, int):
            return act
        made, size = _RULES[act]
        del stack[len(stack) - size :]
        stack.append(_GOTO[stack[-1], made])


@cache
def _inserts(top: int) -> tuple[tuple[int, int, str], ...]:
    """``(cost, top, letters)`` of the cheapest insertions that lead to each other top."""
    best = {top: (0, "")}
    todo = [top]
    while todo:
        at = todo.pop(0)
        for t in _ROLE:
            to = _read(at, t)
            if to is not None and to not in best:
                best[to] = (best[at][0] + _INSERT, best[at][1] + "I")
                todo.append(to)
    return tuple((c, to, x) for to, (c, x) in best.items())


@cache
def _moves(kind: str) -> tuple[tuple[int, tuple[tuple[int, int, str], ...]], ...]:
    """For each top, ``(top after, cost, letters)`` of the best ways past a row of ``kind``: its
    initial (s, u, a, or - for others), then one of ``.`` (sound), ``t`` (truncated) and ``x`` (must go)."""
    initial, fault = kind
    out = []
    for top in TOPS:
        best: dict[int, tuple[int, str]] = {}
        for cost, at, letters in _inserts(top):
            ways = [(at, cost + _DELETE, letters + "D")]
            if fault != "x":
                more = cost + (_TRUNCATED if fault == "t" else 0)
                ways += [(_read(at, initial), more + _KEEP, letters + "K")]
                ways += [(_read(at, t), more + _REROLE, letters + "R") for t in _ROLE]
            for to, c, x in ways:
                if to is not None and (c, x) < best.get(to, (c + 1, "")):
                    best[to] = (c, x)
        out.append((top, tuple((to, c, x) for to, (c, x) in best.items())))
    return tuple(out)


@cache
def _end(top: int) -> tuple[int, str]:
    """The cheapest insertions after which the conversation can end."""
    return min((c, x) for c, to, x in _inserts(top) if _read(to, "$") is not None)


class _Node(NamedTuple):
    cost: int
    rank: int
    letters: str
    link: _Node | None


def parse(kinds: Iterable[str], entry: int = 0) -> dict[int, tuple[int, str]]:
    """``(cost, audit)`` for each stack top that can be left after rows of these kinds."""
    front: dict[int, _Node] = {entry: _Node(0, 0, "", None)}
    for kind in kinds:
        best: dict[int, _Node] = {}
        for top, ways in _moves(kind):
            node = front.get(top)
            if node is not None:
                for to, cost, letters in ways:
                    old = best.get(to)
                    new = (node.cost + cost, node.rank, letters)
                    if old is None or new < old[:3]:
                        best[to] = _Node(*new, node)
        order = sorted(best, key=lambda t: best[t][1:3])
        front = {t: best[t]._replace(rank=i) for i, t in enumerate(order)}
    out = {}
    for top, node in front.items():
        parts, at = [], node
        while at is not None:
            parts.append(at.letters)
            at = at.link
        out[top] = (node.cost, "".join(reversed(parts)))
    return out


def finished(tops: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min((cost + _end(top)[0], audit + _end(top)[1]) for top, (cost, audit) in tops.items())


def replay(rows: Iterable[tuple[str, str]], audit: str, top: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The repaired ``(role, text)`` and the top that they leave."""
    out, rows = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        initial = role[:1]
        if edit != "K":
            initial = "u" if _read(top, "u") is not None else "a"
            role = _ROLE[initial]
        top = _read(top, initial)
        out.append((role, text))
    return out, top


_BLANK = " \t\n\x0b\f\r"


def _fault(text: str, again: bool) -> str:
    """The first fault: ``b`` blank, ``d`` duplicate, ``t`` truncated, ``.`` none."""
    body = text.rstrip(_BLANK)
    return "b" if not body else "d" if again else "." if body[-1] in ".!?" else "t"


def _kind(role: str, fault: str) -> str:
    initial = role[:1]
    return (initial if initial in ("s", "u", "a") else "-") + ("x" if fault in "bd" else fault)


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The values of ``_STATS``, and the repaired turns, of one conversation's sorted rows."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(_fault(text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = finished(parse(_kind(r, f) for (_, r, _), f in zip(rows, faults, strict=True)))
    turns, _ = replay(((r, t) for _, r, t in rows), audit)
    return (
        _gaps([t for t, _, _ in rows]), faults.count("b"), faults.count("d"), faults.count("t"), _illegal([r for _, r, _ in rows]), cost, audit,
        [{"role": r, "text": t} for r, t in turns],
    )


class Repair(NamedTuple):
    """``short`` has a row for each conversation, with its repaired ``turns``; of long conversations
    ``long`` has the rows and ``long_turns (conv_id, part, turns)`` the repaired turns in parts, in order."""

    short: DataFrame
    long: DataFrame | None
    long_turns: DataFrame | None


def repair(turns: DataFrame, segment_rows: int = 20_000, segment_bytes: int = 32 << 20) -> Repair:
    """Repair conversations of ``turns(conv_id, turn, role, text)``; rows of a conversation that are
    not there any more are given as rows whose ``gone`` is true, so that an empty one is returned too."""
    bounded_batches(turns.sparkSession)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), gone.alias("gone"))
    work = Work(rows.sparkSession, "roles")
    size = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    large = work.table(size.where((F.col("n") > segment_rows) | (F.col("b") > segment_bytes)), "large")
    total = large.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    if total.n is None:
        return Repair(_short(rows), None, None)
    same = rows["conv_id"].eqNullSafe(large["conv_id"])
    parts = 1 + max(total.n // segment_rows, total.b // segment_bytes)
    return Repair(_short(rows.join(large, same, "left_anti")), *_long(work, rows.join(large, same, "left_semi"), int(parts)))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task's memory, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []  # held: rows of the conversation that is not over yet

        def flush() -> pa.RecordBatch:
            ids = pa.array([x[0] for x in out], kind)
            rest = [pa.array(c, k) for c, k in zip(zip(*(x[1:] for x in out), strict=True), [*[pa.int64()] * 6, pa.string(), _TURNS], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([ids, *rest], names=names)

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, turn, role, text, gone in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if held is None or conv != now:
                    if held is not None:
                        out.append((now, *_repaired(held)))
                    now, held = conv, []
                if not gone:
                    held.append((turn, role, text))
            if out:
                yield flush()
        if held is not None:
            out.append((now, *_repaired(held)))
            yield flush()

    names = ["conv_id", *[x.split()[0] for x in _STATS.split(", ")], "turns"]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, {_STATS}, turns array<struct<role string, text string>>")


def _long(work: Work, rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Conversations of any length, in ranges of their rows."""
    kind = dict(rows.dtypes)["conv_id"]
    rows = rows.select("conv_id", "turn", "role", "text", "gone", F.xxhash64("text").alias("x"), F.hash("text").alias("y"))
    counted = rows.groupBy("conv_id", "turn", "role", "text", "gone", "x", "y").agg(F.count("*").alias("times"))
    counted = work.table(counted, "counted")
    # the first turn with this role and text; a later one is a duplicate
    key = ["conv_id", "role", "x", "y"]
    first = work.table(counted.where("NOT gone").groupBy(*key).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats")
    marked = counted_join(work, counted, first, key, "n", [F.col("conv_id"), F.col("turn"), F.col("x")], "left")
    marked = marked.withColumn("again", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)))
    order = ["conv_id", "turn", "role"]
    dealt = marked.repartitionByRange(parts, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    dealt = dealt.select(*order, "text", "gone", "times", "again", F.spark_partition_id().alias("part"))
    dealt = work.table(dealt, "dealt")

    def held(table: pa.Table) -> dict:
        by: dict = {}
        cols = ("conv_id", "turn", "role", "text", "gone", "times", "again")
        for conv, turn, role, text, gone, times, again in sorted(zip(*(table.column(c).to_pylist() for c in cols), strict=True), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
            own = by.setdefault(conv, [])
            if not gone:
                own.append((turn, role, text, _fault(text, again)))
                own += [(turn, role, text, _fault(text, True))] * (times - 1)
        return by

    def parsed(table: pa.Table) -> pa.Table:
        out = []
        for conv, own in held(table).items():
            known = sorted({t for t, *_ in own if t is not None})
            roles, faults = [r for _, r, _, _ in own], "".join(f for *_, f in own)
            ways = [{"entry": e, "top": t, "cost": c, "audit": a} for e in TOPS for t, (c, a) in parse([_kind(r, f) for _, r, _, f in own], e).items()]
            ends = (known[0], known[-1]) if known else (None, None)
            out.append((conv, *ends, len(known), faults.count("b"), faults.count("d"), faults.count("t"), _illegal(roles), (roles[0] or " ")[0] if roles else None, (roles[-1] or " ")[0] if roles else None, ways))
        cols = list(zip(*out, strict=True))
        part = table.column("part")[0].as_py()
        kinds = [table.schema.field("conv_id").type, *[pa.int64()] * 7, pa.string(), pa.string(), ways_kind]
        arrays = [pa.array([part] * len(out), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        return pa.table(arrays, names=["part", "conv_id", "lo", "hi", "known", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways"])

    ways_kind = pa.list_(pa.struct([("entry", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    ways_sql = "array<struct<entry int, top int, cost long, audit string>>"
    pieces = dealt.groupBy("part").applyInArrow(parsed, f"part int, conv_id {kind}, lo long, hi long, known long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways {ways_sql}")
    pieces = work.table(pieces, "pieces")

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        # cost, audit and the audits of the single ranges, for each top
        front: dict[int, tuple[int, str, list[str]]] = {0: (0, "", [])}
        illegal, last, known, hi, lo = 0, None, 0, None, None
        for r in rows:
            best: dict[int, tuple[int, str, list[str]]] = {}
            for w in r["ways"]:
                if w["entry"] in front:
                    c, a, own = front[w["entry"]]
                    new = (c + w["cost"], a + w["audit"], [*own, w["audit"]])
                    best[w["top"]] = min(best.get(w["top"], new), new)
            front = best
            if r["first"] is not None:
                illegal += r["illegal"] + (last is not None and last + r["first"] not in ("su", "ua", "au"))
                last = r["last"]
            if r["lo"] is not None:
                known += r["known"] - (r["lo"] == hi)
                lo, hi = r["lo"] if lo is None else lo, r["hi"]
        cost, audit, own = min((c + _end(t)[0], a + _end(t)[1], [*x[:-1], x[-1] + _end(t)[1]]) for t, (c, a, x) in front.items())
        sums = [sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")]
        gaps = hi - lo + 1 - known if lo is not None else 0
        # the top that each range begins with
        entries, at = [], 0
        for a in own:
            entries.append(at)
            at = _after(a, at, rows[len(entries) - 1]["ways"])
        steps = [{"part": r["part"], "entry": e, "audit": a} for r, e, a in zip(rows, entries, own, strict=True)]
        values = [[v] for v in (gaps, *sums, illegal, cost, audit, steps)]
        kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("audit", pa.string())]))]
        names = ["conv_id", *[x.split()[0] for x in _STATS.split(", ")], "steps"]
        return pa.table([table.column("conv_id").slice(0, 1), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=names)

    whole = pieces.groupBy("conv_id").applyInArrow(joined, f"conv_id {kind}, {_STATS}, steps array<struct<part int, entry int, audit string>>")
    whole = work.table(whole, "whole")
    steps = whole.select("conv_id", F.inline("steps")).select("part", "conv_id", "entry", "audit")

    def replayed(left: pa.Table, right: pa.Table) -> pa.Table:
        own = held(left)
        out = []
        for conv, entry, audit in zip(*(right.column(c).to_pylist() for c in ("conv_id", "entry", "audit")), strict=True):
            turns, _ = replay(((r, t) for _, r, t, _ in own.get(conv, [])), audit, entry)
            out.append((conv, right.column("part")[0].as_py(), [{"role": r, "text": t} for r, t in turns]))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(cols, [right.schema.field("conv_id").type, pa.int32(), _TURNS], strict=True)], names=["conv_id", "part", "turns"])

    turns = dealt.groupBy("part").cogroup(steps.groupBy("part")).applyInArrow(replayed, f"conv_id {kind}, part int, turns array<struct<role string, text string>>")
    return whole.drop("steps"), turns


def _after(audit: str, entry: int, ways: list[dict]) -> int:
    """The top that a range leaves: it follows from its audit; of the last range, that before the end's insertions."""
    return next((w["top"] for w in ways if w["entry"] == entry and w["audit"] == audit), entry)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults, by the checksum of ``conv_id:turn``; rows that are dropped are ``gone``."""
    space = F.lit(" ")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), space)
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    d = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), d.alias("d"))
    text = F.when(F.col("d") <= 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "d")
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text", (F.col("d") == 0).alias("gone"))


def _digests(parts: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of turns in parts; a digest reads them in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out, kind, begun = None, None, [], None, False
        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, turns in zip(b.column("conv_id"), b.column("turns"), strict=True):
                conv = conv.as_py()
                if sha is None or conv != now:
                    out += [(now, sha.hexdigest())] if sha is not None else []
                    now, sha, begun = conv, hashlib.sha256(), False
                for t in turns:
                    sha.update(("\n" * begun + t["role"].as_py() + ":" + t["text"].as_py()).encode())
                    begun = True
        out += [(now, sha.hexdigest())] if sha is not None else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], names=["conv_id", "repaired_sha256"])

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(run, f"conv_id {dict(parts.dtypes)['conv_id']}, repaired_sha256 string")


def repair_digests(turns: DataFrame, **bounds: int) -> DataFrame:
    """The columns of ``_STATS`` and a digest of the repaired turns, for each conversation."""
    got = repair(turns, **bounds)
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = got.short.withColumn("repaired_sha256", F.sha2(F.encode(body, "UTF-8"), 256)).drop("turns")
    if got.long is not None:
        sha = _digests(got.long_turns).withColumnRenamed("conv_id", "_conv")
        out = out.unionByName(got.long.join(sha, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv"))
    return out


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_NOT_BLANK = r"[^\x20\x09-\x0D]"
OP12_SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT p.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) % 20 AS d FROM plain p, tab),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS x FROM h WHERE d <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
num AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM dam JOIN ids ON dam.conv_id IS NOT DISTINCT FROM ids.conv_id),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_NOT_BLANK}') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
  WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS f,
  role[1] AS z, lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS pair FROM num),
ins(q, p, c0, x, o) AS (VALUES ('z', 'z', 0, '', ''), ('z', 'u', 5, 'I', 'user:' || chr(10)), ('z', 't', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', 'user:' || chr(10)),
  ('s', 't', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('u', 'u', 0, '', ''), ('u', 't', 5, 'I', 'assistant:' || chr(10)), ('t', 't', 0, '', ''), ('t', 'u', 5, 'I', 'user:' || chr(10))),
step(p, z, nxt, role) AS (VALUES ('z', 's', 's', ''), ('z', 'u', 'u', 'user'), ('s', 'u', 'u', 'user'), ('u', 'a', 't', 'assistant'), ('t', 'u', 'u', 'user')),
way AS (SELECT q, p, c0, x, o, p AS nxt, 'D' AS e, NULL AS z, '' AS role FROM ins UNION ALL SELECT q, p, c0, x, o, nxt, 'K', z, '' FROM ins JOIN step USING (p) UNION ALL SELECT q, p, c0, x, o, nxt, 'R', NULL, role FROM ins JOIN step USING (p) WHERE role <> ''),
rec AS (SELECT c, 0::BIGINT AS i, 'z' AS q, '0000000000' AS key, '' AS o FROM ids UNION ALL
  SELECT c, i, q, min(key) AS key, arg_min(o, key) AS o FROM (
    SELECT r.c, f.i, nxt AS q, lpad((r.key[1:10]::BIGINT + c0 + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND f = 't' THEN 5 ELSE 0 END)::VARCHAR, 10, '0') || r.key[11:] || x || e AS key,
      r.o || way.o || CASE e WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE way.role || ':' || f.text || chr(10) END AS o
    FROM rec r JOIN f ON f.c = r.c AND f.i = r.i + 1 JOIN way ON way.q = r.q AND (e = 'D' OR f.f IN ('t', '.') AND (e = 'R' OR f.z = way.z))) GROUP BY c, i, q),
n AS (SELECT c, count(f.c) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 'b') AS blank, count_if(f = 'd') AS duplicate, count_if(f = 't') AS truncated,
  count_if(i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM ids LEFT JOIN f USING (c) GROUP BY c),
done AS (SELECT c, min(key) AS key, arg_min(o, key) AS o FROM (SELECT c, lpad((key[1:10]::BIGINT + c0)::VARCHAR, 10, '0') || key[11:] || x AS key, rec.o || ins.o AS o FROM rec JOIN n USING (c) JOIN ins USING (q) WHERE rec.i = n.n AND p IN ('z', 't')) GROUP BY c)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, key[1:10]::BIGINT AS cost, key[11:] AS audit, sha256(o[1:length(o) - 1]) AS repaired_sha256 FROM ids JOIN n USING (c) JOIN done USING (c)
"""
