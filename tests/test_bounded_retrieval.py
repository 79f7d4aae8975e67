"""Bounded retrieval against plain Python: BM25 with pruned scoring, cosine with cells, both together."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tracewright.operators import bm25 as bm25_module
from tracewright.operators import dense, evidence
from tracewright.sources.scratch import Work


def bm25(docs, queries, k, min_score, k1=1.5, b=0.75, eps=0.25):
    tokens = [t.lower().split() for _, _, t in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(t for ts in tokens for t in set(ts))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: mean * eps if r < 0 else r for t, r in raw.items()}
    out = []
    for q, text, exclude in queries:
        scored = []
        for (sid, at, _), ts in zip(docs, tokens, strict=True):
            tf = Counter(ts)
            s = sum(idf[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avg)) for t in text.lower().split() if t in tf)
            if round(s, 6) >= min_score and sid not in (exclude or []):
                scored.append((-round(s, 6), at, sid))
        out += [(q, i, sid, -s) for i, (s, _, sid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [2, 3])
def test_pruned_scoring_gives_the_same_rows(spark, seed, monkeypatch):
    defaults = bm25_module.best_scores.__defaults__
    monkeypatch.setattr(bm25_module.best_scores, "__defaults__", (*defaults[:-1], 0 if seed < 3 else defaults[-1]))
    rng = random.Random(seed)
    # words that all, nearly all, many and few texts hold; copies of one text; empty texts
    hot, warm, cold = ["num", "ip"], [f"h{i}" for i in range(6)], [f"c{i}" for i in range(60)]
    def text():
        words = hot + [w for w in warm if rng.random() < 0.8] * rng.randint(1, 3) + rng.choices(cold, k=rng.randint(0, 6))
        return " ".join(rng.sample(words, len(words)))
    docs = [(f"s{i}", i, text()) for i in range(150)]
    docs += [(f"s{i}", i, docs[3][2]) for i in range(150, 220)] + ([("s220", 220, ""), ("s221", 221, "lone word")] if seed > 1 else [])
    queries = [(f"q{i}", text() + " unknown", rng.choice([None, ["s3"], ["s3", "s160", "s0"]])) for i in range(25)] + [("qe", "", None), ("qh", "num num", None), ("qc", "c1 c2 c2", ["s1"])]
    ev = spark.createDataFrame([(f"E_{s}", s, i, t, i % 2) for s, i, t in docs], "evidence_id string, session_id string, doc_idx long, text string, label int")
    qs = spark.createDataFrame(queries, "query_id string, query string, exclude array<string>")
    index = evidence.bm25_index(ev)
    for k, low in ((5, 0.0), (4, -40.0)):
        got = sorted((r.query_id, r.rank, r.session_id, r.score) for r in evidence.retrieve(qs, ev, index, k, low, digits=6).collect())
        want = bm25(docs, queries, k, low)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def scored(spark, rows, queries):
    ev = spark.createDataFrame([(f"E_{s}", s, i, t, 0) for s, i, t in rows], "evidence_id string, session_id string, doc_idx long, text string, label int")
    qs = spark.createDataFrame(queries, "query_id string, query string, exclude array<string>")
    index, work = evidence.bm25_index(ev), Work(spark, "test")
    terms = work.table(evidence.query_terms(qs, index))
    return evidence.best_scores(terms, index, work, 5, 0.0, worth=0).count(), evidence.bm25_scores(qs, index).count()


def test_few_pairs_are_scored(spark):
    rng = random.Random(8)
    rows = [(f"s{i}", i, " ".join(["the", "of", "and", *rng.choices([f"m{k}" for k in range(30)], k=4), *[f"w{rng.randint(0, 300)}" for _ in range(5)]])) for i in range(800)]
    few, pairs = scored(spark, rows, [(f"q{i}", rows[i][2], None) for i in range(0, 800, 40)])
    assert pairs > 10_000 and few < pairs / 4
    # a masked log: all terms but a few are in all texts, and no score can reach 0
    rows = [(f"s{i}", i, " ".join(["num"] * 9 + ["ip"] * (1 + i % 5) + ["size"] * 7 + [f"d{i % 7}"])) for i in range(300)]
    assert scored(spark, rows, [(f"q{i}", rows[i][2], None) for i in range(20)]) == (0, 700)


def test_grown_index_is_the_index_of_all(spark):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choices([f"t{int(rng.paretovariate(1))}" for _ in range(40)], k=rng.randint(0, 12)))
    rows = [(f"E{i}", f"s{i}", i, text(), 0) for i in range(120)]
    rows += [(f"E{i}", f"s{i}", i, rows[i % 7][3], 0) for i in range(120, 180)]  # copies of texts in all parts
    frame = lambda r: spark.createDataFrame(r, "evidence_id string, session_id string, doc_idx long, text string, label int")
    old, new, gone = rows[:100] + rows[120:150], rows[100:120] + rows[150:], {f"E{i}" for i in (*range(3, 30), 121, 125)}
    live = [r for r in rows if r[0] not in gone]
    one, grown = evidence.bm25_index(frame(live)), evidence.bm25_index(frame(old))
    out = spark.createDataFrame([(g,) for g in gone], "evidence_id string")
    both = evidence.grown_index(grown, frame(new), out)
    steps = evidence.grown_index(evidence.grown_index(grown, removed=out), frame(new))
    q = spark.createDataFrame([(f"q{i}", text(), None) for i in range(15)], "query_id string, query string, exclude array<string>")
    rows_of = lambda ix, name, *cols: sorted(map(tuple, ix[name].select(*cols).collect()))
    near = lambda df: sorted((r.query_id, r.rank, r.evidence_id, round(r.score, 6)) for r in df.collect())
    for ix in (both, steps):
        assert rows_of(ix, "postings", "term", "text_id", "tf", "dl") == rows_of(one, "postings", "term", "text_id", "tf", "dl")
        assert rows_of(ix, "docs", "text_id", "copies", "dl", "first_idx", "pos") == rows_of(one, "docs", "text_id", "copies", "dl", "first_idx", "pos")
        assert rows_of(ix, "terms", "term", "df") == rows_of(one, "terms", "term", "df")
        assert near(evidence.retrieve(q, frame(live), ix, 5)) == near(evidence.retrieve(q, frame(live), one, 5))


# ---------------------------------------------------------------- vectors


def cosine(rows, queries, k):
    good = lambda v: v is not None and all(x is not None for x in v) and np.isfinite(n := np.linalg.norm(v)) and n > 0
    out = []
    for q, v, exclude in queries:
        if good(v):
            s = sorted((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6), at, sid) for sid, at, x in rows if good(x) and sid not in (exclude or []))
            out += [(q, i, sid, -c) for i, (c, _, sid) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [True, False])
def test_vectors_by_brute_force(spark, clustered):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vec = lambda i: [float(x) for x in (centres[i % 12] + 0.15 * rng.normal(size=16) if clustered else rng.normal(size=16))]
    rows = [(f"v{i}", i, vec(i)) for i in range(600)] + [(f"v{i}", i, None) for i in range(600, 603)]
    rows += [(f"v{i}", i, [1.0] + [0.0] * 15) for i in range(700, 1000)]  # one vector for a third of the rows
    rows += [("z", 1001, [0.0] * 16), ("n", 1002, [float("nan")] * 16), ("h", 1003, [None] + [1.0] * 15)]
    queries = [(f"q{i}", vec(i), [f"v{i}"] if i % 2 else None) for i in range(40)] + [("hot", [1.0] + [0.0] * 15, ["v700", "v701"]), ("none", None, None), ("zero", [0.0] * 16, None)]
    df = spark.createDataFrame([(f"E_{s}", s, i, v) for s, i, v in rows], "evidence_id string, session_id string, doc_idx long, vector array<double>")
    qs = spark.createDataFrame(queries, "query_id string, vector array<double>, exclude array<string>")
    want = cosine(rows, queries, 5)
    for index, options in ((dense.dense_index(df), {}), (dense.dense_index(df, cells=12, block=80), {"probes": 3, "chunk": 25})):
        got = sorted((r.query_id, r.rank, r.session_id, r.score) for r in dense.dense_retrieve(qs, index, 5, **options).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    first = {(r.query_id, r.session_id) for r in dense.dense_retrieve(qs, index, 5, probes=3, exact=False).collect()}
    recall = len(first & {(w[0], w[2]) for w in want}) / len(want)
    assert recall >= (0.9 if clustered else 0.3)
    assert dense.dense_retrieve(qs, dense.dense_index(df.limit(0)), 5).collect() == []


def test_methods_on_sessions(spark):
    lines = [["disk failed on node", "retry disk"], ["user logged in"], ["disk failed on node", "retry disk again"], ["user logged out"], ["network is down"]]
    s = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(lines)], "session_id string, lines array<string>")
    ev = spark.createDataFrame([(f"E_s{i}", f"s{i}", i, "\n".join(x), 0) for i, x in enumerate(lines)], "evidence_id string, session_id string, doc_idx long, text string, label int")
    for method in ("bm25", "dense", "hybrid"):
        index = evidence.bm25_index(ev) if method == "bm25" else None
        top = {r.query_id: r.session_id for r in evidence.retriever(method)(s, ev, index, 2).where("rank = 1").collect()}
        assert (top["s0"], top["s2"], top["s1"]) == ("s2", "s0", "s3"), method


def test_no_table_holds_the_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"s{i}", i, " ".join(["the", *rng.choices([f"w{k}" for k in range(20)], k=6), f"r{i % 90}"])) for i in range(600)]
    queries = [(f"q{i}", rows[i][2], [f"s{i}"]) for i in range(0, 600, 10)]
    ev = spark.createDataFrame([(f"E_{s}", s, i, t, 0) for s, i, t in rows], "evidence_id string, session_id string, doc_idx long, text string, label int")
    qs = spark.createDataFrame(queries, "query_id string, query string, exclude array<string>")
    counts, table = [], Work.table
    monkeypatch.setattr(Work, "table", lambda self, df, name="t": (out := table(self, df, name), counts.append(out.count()))[0])
    index = evidence.bm25_index(ev)
    got = sorted((r.query_id, r.rank, r.session_id, r.score) for r in evidence.retrieve(qs, ev, index, 3, digits=6).collect())
    assert [g[:3] for g in got] == [w[:3] for w in bm25(rows, queries, 3, 0.0)]
    # 60 queries share a word with each of 600 texts; a row of the index holds a text
    assert max(counts) <= 600
    # queries in parts, texts in blocks
    work = Work(spark, "test")
    terms = work.table(evidence.query_terms(qs, index))
    parted = evidence.best_texts(qs, terms, index, work, 4, 0.0, 6, pairs=50, block=300)
    whole = evidence.best_texts(qs, terms, index, work, 4, 0.0, 6)
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, whole.collect())) and parted.count() == 240


def test_a_score_of_nothing_is_no_better_than_none(spark):
    # a word in half of all texts weighs 0, so the first documents come first, whether they hold it or not
    rows = [(f"s{i}", i, "half x" if i % 2 else "other y") for i in range(40)]
    queries = [("q", "half", None), ("both", "half other", ["s0"])]
    ev = spark.createDataFrame([(f"E_{s}", s, i, t, 0) for s, i, t in rows], "evidence_id string, session_id string, doc_idx long, text string, label int")
    qs = spark.createDataFrame(queries, "query_id string, query string, exclude array<string>")
    got = sorted((r.query_id, r.rank, r.session_id, r.score) for r in evidence.retrieve(qs, ev, evidence.bm25_index(ev), 4, digits=6).collect())
    assert got == bm25(rows, queries, 4, 0.0)
