"""Classifiers, single sessions, sweeps, and a whole run with its saved results."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright import registry
from tracewright.operators import evidence, explain, scoring, sequences, sessions, splits
from tracewright.plans import explain_all
from tracewright.sources.scratch import Work

NORMAL, BAD = "connection opened by client closed again heartbeat ok".split(), "panic fault overflow corrupt".split()


def labelled(spark, n=160):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        rows.append((f"s{i:03d}", y, [" ".join(rng.choices(NORMAL, k=5) + (rng.choices(BAD, k=5) if y else [])) for j in range(3)]))
    return splits.stratified_split(spark.createDataFrame(rows, "session_id string, label int, lines array<string>"))


@pytest.fixture(scope="module")
def fitted(spark):
    s = labelled(spark).cache()
    return s, scoring.fit_classifier(splits.oversampled(splits.in_split(s, "train")).drop("draw"), splits.in_split(s, "val"), features=4096, reg=(0.01, 0.1))


def test_classifier_learns_what_can_be_learned(fitted):
    s, model = fitted
    got = scoring.score_sessions(model, splits.in_split(s, "test")).collect()
    assert len(got) >= 20 and all(r.pred == r.label for r in got)
    assert all(abs(sum(r.prob) - 1) < 1e-9 and abs(r.margin - abs(r.prob[1] - r.prob[0])) < 1e-9 for r in got)


def test_one_session(spark, fitted):
    _, model = fitted
    one = lambda y: spark.createDataFrame([("x", y, [" ".join(BAD if y else NORMAL)] * 3)], "session_id string, label int, lines array<string>")
    bad, good = (scoring.score_one(model, one(y)).first() for y in (1, 0))
    assert (bad.prediction, good.prediction) == ("Anomalous", "Normal") and bad.length == 3
    assert bad.confidence == pytest.approx(bad.anomaly_prob) and good.confidence == pytest.approx(good.normal_prob)


def test_sweep(fitted):
    s, _ = fitted
    parts = [splits.in_split(s, p) for p in ("train", "val", "test")]
    got = {r.k: (r.macro_f1, r.test_acc) for r in scoring.sweep(*parts, [2048, 4096]).collect()}
    assert set(got) == {2048, 4096} and got[4096] == (1.0, 1.0)


def test_fits_keep_one_set_of_counts_and_no_frames(spark, monkeypatch):
    s = labelled(spark)
    parts = [splits.in_split(s, p) for p in ("train", "val", "test")]

    def kept(*_):
        raise AssertionError("sessions are kept in executors")

    for name in ("persist", "cache"):
        monkeypatch.setattr(type(s), name, kept)
    live, most, table, delete = set(), [0], Work.table, Work._delete
    monkeypatch.setattr(Work, "table", lambda self, df, name="t": (out := table(self, df, name), live.add(out._work_path), most.append(sum("/fit-" in p for p in live)))[0])
    monkeypatch.setattr(Work, "_delete", lambda self, path: (live.discard(path), delete(self, path))[1])
    assert scoring.sweep(*parts, [1024, 2048, 4096]).count() == 3
    assert max(most) == 2 and not any("/fit-" in p for p in live)  # of the fit that runs: train and val


def test_parts_are_those_of_whole_sessions(spark):
    d = "/root/testdata/sf0.001"
    whole = splits.stratified_split(sessions.with_labels(registry.document_sessions(spark, d), registry.quality_labels(spark, d)).withColumnRenamed("block_id", "session_id"))
    train, val, test = registry.labelled_parts(spark, d)
    want = {(r.session_id, r.label, r.split, r.n) for r in whole.selectExpr("session_id", "label", "split", "size(lines) AS n").collect()}
    got = {(r.session_id, r.label, r.split, r.n) for p in (train, val, test) for r in p.selectExpr("session_id", "label", "split", "size(lines) AS n").collect()}
    assert got == want


def test_retriever_names():
    assert evidence.retriever() is evidence.batch_retrieve
    assert evidence.retriever("dense") is evidence.dense_batch_retrieve
    assert evidence.retriever("hybrid") is evidence.hybrid_batch_retrieve
    with pytest.raises(ValueError):
        evidence.retriever("other")


def test_loaders(spark):
    lines = spark.createDataFrame([(i, f"- INFO blk_{i % 5} at {i}") for i in range(60)], "line_no long, line string")
    assert explain_all.load_sessions(lines, "bgl").count() == 5
    labels = spark.createDataFrame([("blk_1", "Anomaly")], "block_id string, label string")
    got = {r.session_id: (r.label, len(r.lines)) for r in explain_all.load_sessions(lines, "Hdfs", labels).collect()}
    assert got == {f"HDFS_blk_{k}": (int(k == 1), 12) for k in range(5)}
    with pytest.raises(ValueError):
        explain_all.load_sessions(lines, "other")


def test_vocabulary_ids_of_unknown_words(spark):
    s = spark.createDataFrame([("a", ["x y", "y z"]), ("b", [])], "session_id string, lines array<string>")
    words = sequences.vocabulary(s, 2)
    got = {r.session_id: (r.input_ids, r.segment_ids) for r in sequences.with_vocabulary_ids(s, words, unknown=9).collect()}
    assert got["a"] == ([1, 4, 3, 2, 3, 9, 2], [0, 0, 0, 0, 1, 1, 1]) and got["b"][0] == [1]


def test_a_run_and_its_saved_results(spark, tmp_path):
    s = labelled(spark)
    scores = scoring.score_columns(splits.in_split(s, "test").select("session_id", F.when(F.col("label") == 1, F.array(F.lit(0.0), F.lit(2.0))).otherwise(F.array(F.lit(2.0), F.lit(0.0))).alias("logits")))
    prepared = explain_all.prepare_prompts(s, scores, "", k=3).cache()
    flagged = [r.session_id for r in prepared.collect()]
    assert flagged and all(r.prompt.count("[E") <= 3 and r.session_id in r.prompt for r in prepared.collect())
    answer = '{"prediction": "anomaly", "summary": "it broke", "claims": [{"claim": "heartbeat opened client connection", "evidence_ids": ["E1"]}]}'
    rows = [(x, answer if i else "no json", "gpt-4o", 100, 10, None, 5.0, None if i != 1 else "timeout") for i, x in enumerate(sorted(flagged))]
    given = spark.createDataFrame(rows, "session_id string, content string, model string, prompt_tokens long, completion_tokens long, total_tokens long, latency_ms double, error string")
    finished = explain_all.finish_explanations(prepared, given)
    explain_all.save_results(finished, scores, f"{tmp_path}/run", {"dataset": "none"})
    explain_all.save_results(finished.limit(0), scores.limit(0), f"{tmp_path}/run2")
    records = spark.read.json(f"{tmp_path}/run/records").collect()
    assert {r.session_id for r in records} == set(flagged) - {sorted(flagged)[1]}
    assert all(r.explanation.prediction == "anomaly" and r.created_at for r in records)
    (metrics,) = spark.read.json(f"{tmp_path}/run/metrics").collect()
    assert (metrics.anomalies, metrics.explained, metrics.failed, metrics.dataset) == (len(flagged), len(flagged) - 1, 1, "none")
    assert metrics.tokens == 110 * (len(flagged) - 2)  # an answer that is no JSON costs nothing
    assert [r.error for r in explain.failures(given).collect()] == ["timeout"]
    assert {r.prediction for r in explain.explained(scores, explain_all.records(finished)).collect()} == {"normal", "anomaly"}


def test_inspection(spark):
    s = spark.createDataFrame([(f"s{i}", 0, ["A b", "C"]) for i in range(9)], "session_id string, label int, lines array<string>")
    assert [(r.session_id, r.decoded) for r in sessions.inspection(s, 2).collect()] == [("s0", "a b c"), ("s1", "a b c")]
