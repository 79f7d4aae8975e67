import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tracewright.operators import evidence as E
from tracewright.operators import explain as X
from tracewright.operators import verify as V
from tracewright.sources import logs


def brute_force(docs, queries, k, exclude):
    toks = [t.lower().split() for _, t in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(w for t in toks for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    out = {}
    for qid, q in queries:
        scores = []
        for i, t in enumerate(toks):
            tf = Counter(t)
            s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in q.lower().split())
            scores.append((-round(s, 6), i))
        keep = [(s, i) for s, i in sorted(scores) if -s >= 0 and docs[i][0] not in exclude.get(qid, ())]
        out[qid] = [(docs[i][0], -s) for s, i in keep[:k]]
    return out


def test_retrieval_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i}", " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(1, 8)))) for i in range(120)]
    docs += [(f"e{i}", docs[i][1]) for i in range(20)]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=3))) for i in range(15)] + [("none", "zzz"), ("rare", docs[3][1])]
    exclude = {"none": ["d0", "d2"], "rare": ["d3"]}
    ev = spark.createDataFrame([(f"E_{s}", s, i, t, i % 2) for i, (s, t) in enumerate(docs)], "evidence_id string, session_id string, doc_idx long, text string, label int")
    qs = spark.createDataFrame([(q, t, exclude.get(q)) for q, t in queries], "query_id string, query string, exclude array<string>")
    index = E.bm25_index(ev)
    logs.save_index(index, str(tmp_path / "ix"))
    for ix in (index, logs.load_index(spark, str(tmp_path / "ix"))):
        got = {}
        for r in E.retrieve(qs, ev, ix, 5, digits=6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.session_id, r.score))
        want = brute_force(docs, queries, 5, exclude)
        assert {q: [s for s, _ in v] for q, v in got.items()} == {q: [s for s, _ in v] for q, v in want.items() if v}


def test_explanations_and_checks(spark):
    body = '{"prediction":"anomaly","summary":"s","claims":[{"claim":"memory errors seen","evidence_ids":["E1","E2"]},{"claim":"memory again was bad","evidence_ids":["E1"]},{"claim":"no evidence for this","evidence_ids":[]}]}'
    fence = "`" * 3
    rows = [("a", body), ("b", f"{fence}json\n{body}\n{fence}"), ("c", f"so: {body} bye"), ("d", '{"summary": null}'), ("e", "nothing"), ("f", None)]
    p = X.parsed(spark.createDataFrame(rows, "session_id string, content string"))
    hit = lambda i, t: F.struct(F.lit(1.0).alias("score"), F.lit(f"E_{i}").alias("evidence_id"), F.lit(t).alias("text"))
    p = p.withColumn("hits", F.array(hit(1, "a memory error"), hit(2, "quiet"))).withColumn("id_mapping", X.id_mapping(F.col("hits")))
    got = {r.session_id: r for r in V.verify(p).collect()}
    for s in "abc":
        assert len(got[s].explanation.claims) == 3 and not got[s].parse_failed
        assert {i["check"]: i["status"] for i in got[s].issues} == {"structure": "pass", "evidence_ids": "pass", "coverage": "fail", "keyword_match": "pass", "empty_claims": "pass"}
        assert got[s].pass_rate == 0.8 and not got[s].verified
    assert got["d"].explanation.summary == "" and got["d"].explanation.prediction == "anomaly" and not got["d"].parse_failed
    assert got["e"].parse_failed and got["e"].explanation.insufficient_evidence and got["f"].parse_failed
