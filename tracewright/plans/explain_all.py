"""The explain-all run in two phases around the external answers (PIP1-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import first_key, key_id
from ..operators.evidence import batch_retrieve, bm25_index, build_evidence
from ..operators.explain import parsed, prompts, results, token_total
from ..operators.metrics import run_metrics
from ..operators.sessions import count_windows, keyed_sessions, with_labels
from ..operators.splits import stratified_split
from ..operators.verify import verify
from ..sources.logs import append_metrics, save_records
from ..sources.scratch import Work
from .runs import Run


def load_sessions(lines: DataFrame, dataset: str, labels: DataFrame | None = None, size: int = 10, step: int = 10, seed: object = 42) -> DataFrame:
    """Split sessions of a data set: windows for BGL, sessions by block key for HDFS."""
    kind = dataset.upper()
    if kind == "BGL":
        s = count_windows(lines, size, step).select("session_id", "label", "lines")
    elif kind == "HDFS":
        keyed = keyed_sessions(lines, first_key(F.col("line")))
        s = with_labels(keyed, labels) if labels is not None else keyed.withColumn("label", F.lit(0))
        s = s.select(key_id(F.col("block_id")).alias("session_id"), "label", "lines")
    else:
        raise ValueError(f"unknown data set: {dataset}")
    return stratified_split(s, seed=seed)


def prepare_prompts(sessions: DataFrame, scores: DataFrame, dataset: str = "", k: int = 5) -> DataFrame:
    """Phase A: flagged sessions with hits, prompt and id mapping."""
    flagged = sessions.join(scores.where("pred = 1").select("session_id", "pred", "prob", "margin", "anomaly_prob"), "session_id")
    evidence = Work(sessions.sparkSession, "evidence").table(build_evidence(sessions, dataset), "evidence")
    hits = batch_retrieve(flagged, evidence, bm25_index(evidence), k, dataset=dataset)
    lists = hits.groupBy(F.col("query_id").alias("session_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", "evidence_id", "text", F.col("label").alias("hit_label")))).alias("hits"))
    none = F.array().cast("array<struct<rank int, score double, evidence_id string, text string, hit_label int>>")
    with_hits = flagged.join(lists, "session_id", "left").withColumn("hits", F.coalesce("hits", none))
    return prompts(with_hits)


def finish_explanations(prepared: DataFrame, responses: DataFrame) -> DataFrame:
    """Phase B: parsed and verified answers; rows with an ``error`` are left out here and are
    counted as failed by ``outcomes``."""
    good = parsed(responses.where("error IS NULL"))
    total = token_total(F.col("total_tokens"), F.col("prompt_tokens"), F.col("completion_tokens"))
    # an answer that could not be parsed counts, with no tokens and no latency
    good = good.withColumn("total_tokens", F.when(F.col("parse_failed"), F.lit(0).cast("bigint")).otherwise(total)).withColumn("latency_ms", F.when(F.col("parse_failed"), F.lit(0.0)).otherwise(F.col("latency_ms")))
    return verify(prepared.join(good.select("session_id", "explanation", "parse_failed", "total_tokens", "latency_ms"), "session_id"))


def outcomes(scores: DataFrame, finished: DataFrame) -> DataFrame:
    done = finished.select("session_id", F.lit(True).alias("explained"), "verified", "total_tokens", "latency_ms")
    return scores.select("session_id", (F.col("pred") == 1).alias("is_anomaly")).join(done, "session_id", "left")


def save_results(finished: DataFrame, scores: DataFrame, path: str, config: dict[str, str] | None = None) -> None:
    """Records as JSON lines in ``path/records``, and the run's figures, with its settings, added to ``path/metrics``."""
    save_records(records(finished), f"{path}/records")
    report = run_report(scores, finished)
    append_metrics(report.select("*", *[F.lit(v).alias(k) for k, v in (config or {}).items()]), f"{path}/metrics")


def explain_in_batches(prepared: DataFrame, responses: DataFrame, path: str, batches: int = 16) -> Run:
    """``finish_explanations`` batch by batch, with records in ``path``; started again, it does the batches that are left."""
    run = Run(prepared.sparkSession, path)
    answered = prepared.join(responses.where("error IS NULL").select("session_id"), "session_id", "left_semi")
    run.resume(answered, "session_id", lambda own: records(finish_explanations(own, responses.join(own.select("session_id"), "session_id", "left_semi"))), batches)
    return run


def records(finished: DataFrame) -> DataFrame:
    """The result record of each explained session."""
    answers = finished.select("session_id", "explanation", "total_tokens", "latency_ms")
    return results(finished.drop("explanation", "total_tokens", "latency_ms"), answers)


def run_report(scores: DataFrame, finished: DataFrame) -> DataFrame:
    return run_metrics(outcomes(scores, finished))
