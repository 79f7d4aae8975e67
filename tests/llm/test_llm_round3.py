"""Line dedup, conversation repair and hard negatives: brute force, odd rows, hot keys."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracewright.llm import hard_negatives as N
from tracewright.llm import line_dedup as L
from tracewright.llm import role_repair as R

BLANK = " \t\n\x0b\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- lines


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def kept(rows):
    keys = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(BLANK))
            if len(k) >= 20 and i is not None:
                keys[k].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (len(keys[k := lower(x.strip(BLANK))]) >= 3 and max(keys[k]) != i)]
        out.append((-1 if i is None else i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_line_dedup_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["a line that everybody has in their footer", "\tÉA LINE of Umlauts ÄÖÜ and more \x0b", "  éa line of Umlauts ÄÖÜ and MORE", "Éa line of umlauts ÄÖÜ and more", "short", "", "x" * 20, "y" * 19, "🙂" * 20, "z " * 12]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(i, pool[0] + "\n" + pool[0]) for i in range(200, 260)]  # a line that a third of the documents hold
    rows += [(5, "another text of this id\n" + pool[0]), (5, "another text of this id\n" + pool[0]), (None, pool[0] + "\nof no id"), (7, None), (8, ""), (9, "\n\n"), (300, "\n".join(f"line {i} {'w' * 20}" for i in range(50_000)) + "\n" + pool[0])]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    want = kept(rows)
    import tracewright.llm._skew as K

    for hot in (K.HOT_KEYS, 1, 3):
        monkeypatch.setattr(K.counted_join, "__defaults__", ("inner", hot))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.kept_lines(df).collect())
        assert got == want
    assert L.kept_lines(df.limit(0)).collect() == []


def test_no_key_of_a_line_fills_a_task(spark):
    """The rows of hot keys never meet under their key."""
    from tracewright.llm._skew import counted_join
    from tracewright.llm._work import Work

    work = Work(spark, "hot")
    rows = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
    table = work.table(rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS twice"))
    got = counted_join(work, rows, table, ["k"], "n", [rows["id"]], hot_keys=10)
    assert sorted(map(tuple, got.collect())) == sorted((i, 7 if i % 3 == 0 else i, 14 if i % 3 == 0 else 2 * i) for i in range(6000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- conversations


def cheapest(rows):
    """By trying all edits of (initial, fault) rows: cost, audit, roles."""
    best = None
    for edits in itertools.product([e for e in ("D", "K", "Ru", "Ra")], repeat=len(rows)):
        for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            audit, out, cost = "", "", 0
            for (z, fault), e, more in zip(rows, edits, inserts, strict=False):
                audit, out, cost = audit + "I" * len(more), out + more, cost + 5 * len(more)
                if fault == "x" and e != "D":
                    break
                audit += e[0]
                cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if fault == "t" and e != "D" else 0)
                out += "" if e == "D" else z if e == "K" else e[1]
            else:
                out, audit, cost = out + inserts[-1], audit + "I" * len(inserts[-1]), cost + 5 * len(inserts[-1])
                if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, out)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_parser_by_brute_force(n):
    kinds = [z + f for z in "sua-" for f in ".tx"]
    cases = list(itertools.product(kinds, repeat=n))
    for case in random.Random(n).sample(cases, min(len(cases), 60)):
        cost, audit, out = cheapest([tuple(k) for k in case])
        assert R.finished(R.parse(case)) == (cost, audit)
        turns, top = R.replay([({"s": "system", "u": "user", "a": "assistant", "-": "tool"}[z], "x") for z, _ in case], audit)
        assert "".join(r[0] for r, _ in turns) == out


def conversations():
    rng, rows = random.Random(5), []
    for c in range(60):
        n = rng.choice([1, 3, 8, 30])
        for t in range(n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Fine.", "and then", "Why?", " \t\n", None, "Yes!\n", f"number {t}.", "Ende ", "é!"])
            rows.append((c, rng.choice([t, t, t, None, t // 2, t + 5]), role, text))
    rows += [(70, 1, "user", "Same.")] * 9 + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (71, None, None, None), (72, -3, "assistant", "x" * 200_000 + ".")]
    return rows


def repaired(rows):
    """The contract, row by row in Python; edits by the parser that the test above has checked."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = by[c]
        if d:
            x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
            own += [(t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)
    out = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, r, x in own:
            body = x.strip(BLANK)
            faults.append("b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else ".")
            seen.add((r, x))
        cost, audit = R.finished(R.parse((r[:1] if r[:1] and r[:1] in "sua" else "-") + ("x" if f in "bd" else f) for (_, r, _), f in zip(own, faults, strict=True)))
        turns, _ = R.replay([(r, x) for _, r, x in own], audit)
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in turns)))
    return out


def test_repair_in_one_pass_and_in_ranges(spark):
    rows = conversations()
    want = repaired(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gone_ int").repartition(5)
    for bounds in ({}, {"segment_rows": 5}, {"segment_rows": 1, "segment_bytes": 1}):
        got = {r[0]: tuple(r[1:]) for r in R.repair_digests(R.damaged(df), **bounds).collect()}
        assert got == want
    assert R.repair_digests(R.damaged(df.limit(0))).collect() == []


def test_repair_returns_the_turns(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "And?"), (2, 1, "assistant", "Well.")]
    got = {r.conv_id: r for r in R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).short.collect()}
    assert (got[1].cost, got[1].audit, [tuple(t) for t in got[1].turns]) == (3, "KDR", [("user", "Hi."), ("assistant", "And?")])
    assert (got[2].cost, got[2].audit, got[2].turns) == (2, "D", [])


# ---------------------------------------------------------------- negatives


def mined(rows):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = list({(i, y, tuple(v)): (i, y, v) for i, y, v in rows}.values())
    dim = max((len(v) for _, _, v in rows), default=0)
    full = [(i, y, np.pad(v, (0, dim - len(v)))) for i, y, v in rows]
    out = []
    for a, ya, va in full:
        if a % 50 == 0:
            score = sorted(((-int(va @ v), i, y) for i, y, v in full if i != a))
            for p, i, _ in [s for s in score if s[2] == ya][:5]:
                inside = [s for s in score if s[2] != ya and -50 * p <= -100 * s[0] <= -95 * p][:3]
                out += [(a, i, k, j, -p, -s) for k, (s, j, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [False, True])
def test_negatives_by_brute_force(spark, clustered):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vec = lambda: (centres[rng.integers(6)] + 0.05 * rng.normal(size=8) if clustered else rng.normal(size=8)) / 3
    rows = [(i, int(rng.integers(4)), [float(x) for x in vec().astype(np.float32)]) for i in range(700)]
    rows += [(i, i % 3, rows[1][2]) for i in range(700, 1000)]  # one vector for a third of the rows
    rows += [(50, rows[50][1], rows[50][2])] * 3
    rows += [(1000, None, [0.1] * 8), (1050, 1, None), (1100, 1, [0.1] * 7 + [None]), (1150, 2, [float("nan")] * 8), (1200, 2, [float("inf")] * 8), (None, 1, [0.2] * 8), (1250, 1, [0.5, 0.25]), (1300, 1, []), (1350, 9, [0.3] * 8)]
    df = spark.createDataFrame([(i, v, y, 0) for i, y, v in rows], "vec_id long, embedding array<float>, label int, cell int").repartition(3)
    want = mined(rows)
    assert want
    for p in (N.MiningParams(), N.MiningParams(sample=40, cells=5, block=60, chunk=7, leaf=8)):
        assert sorted(map(tuple, N.mine(df, p).collect())) == want
    assert N.mine(df.limit(0)).collect() == []
    one = spark.createDataFrame([(50, [0.5], 1), (51, [1e30], 1), (52, [-1e30], 2)], "vec_id long, embedding array<float>, label int")
    assert N.mine(one).collect() == []


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(c, 3, size=(400, 6)) for c in rng.normal(0, 300, size=(10, 6))]).astype(np.int64)
    most = float(np.sqrt((v * v).sum(1).max())) + 1e-6
    x = N.augmented(v, most)
    tree = N.CoverTree.build(x, 32)
    assert sorted(np.concatenate(tree.leaves)) == list(range(len(v)))
    nodes, at = {}, np.empty(len(v), int)
    for k, rows in enumerate(tree.leaves):
        at[rows] = k
    for depth in range(len(tree.levels) - 1, -1, -1):
        _, parent, radius = tree.levels[depth]
        assert (np.linalg.norm(x - tree.centres[at], axis=1) <= radius[at] + 1e-9).all()
        nodes[depth] = len(radius)
        at = parent[at]
    assert nodes[0] == 1 and nodes[len(nodes) - 1] > 50
    # an anchor near one cluster looks at few of the rows
    q, seen = v[:1], []
    ids, labels = np.arange(len(v)), np.zeros(len(v), np.int64)
    own = N.products
    try:
        N.products = lambda a, b, m: seen.append(len(b)) or own(a, b, m)
        low, high = np.array([[-(10**12)]]), np.array([[10**12]])
        best = N.search(tree, v, ids, labels, q, np.array([-1]), np.array([0]), (low, high), np.full((1, 1), N._LOW), 5, True, most)
    finally:
        N.products = own
    score = v @ v[0]
    want = np.lexsort((ids, -score))[:5]
    assert list(best.id) == list(want) and sum(seen) < len(v) / 4
