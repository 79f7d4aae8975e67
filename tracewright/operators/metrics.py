"""Statistics and reports (AGG1-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

from .splits import SPLITS


def _share(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def dataset_stats(sessions: DataFrame) -> DataFrame:
    """A row for each split, also for empty ones."""
    spark = sessions.sparkSession
    got = sessions.groupBy("split").agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("anomaly"), F.avg(F.size("lines")).alias("avg_lines"))
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    all_ = names.join(got, "split", "left").fillna(0, ["total", "anomaly"]).fillna(0.0, ["avg_lines"])
    return all_.select("split", "total", (F.col("total") - F.col("anomaly")).alias("normal"), "anomaly", _share(F.col("anomaly"), F.col("total")).alias("anomaly_ratio"), "avg_lines")


def class_balance(stages: dict[str, DataFrame]) -> DataFrame:
    """Counts and share by stage (before, after ...) and split."""
    out = None
    for name, df in stages.items():
        one = df.groupBy("split").agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("anomaly")).select(F.lit(name).alias("stage"), "split", "total", "anomaly", _share(F.col("anomaly"), F.col("total")).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out


def corpus_stats(evidence: DataFrame) -> DataFrame:
    n = F.col("normalized_length")
    return evidence.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("anomaly"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"), F.coalesce(F.min(n), F.lit(0)).alias("min_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    """One row ``tn, fp, fn, tp`` from ``(label, pred)``."""
    at = lambda y, p: F.count_if((F.col("label") == y) & (F.col("pred") == p))
    return scored.agg(at(0, 0).alias("tn"), at(0, 1).alias("fp"), at(1, 0).alias("fn"), at(1, 1).alias("tp"))


def confusion_table(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").pivot("pred", [0, 1]).count().select("label", F.coalesce("0", F.lit(0)).alias("pred_0"), F.coalesce("1", F.lit(0)).alias("pred_1"))


def _prf(m: DataFrame) -> DataFrame:
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    m = m.select("*", p.alias("precision"), r.alias("recall"))
    return m.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def screener_metrics(scored: DataFrame) -> DataFrame:
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return _prf(confusion(scored)).withColumn("accuracy", _share(F.col("tn") + F.col("tp"), total))


def classification_report(scored: DataFrame) -> DataFrame:
    """Rows Normal, Anomalous, accuracy, macro avg, weighted avg; figures to five decimals."""
    c = confusion(scored)
    sides = c.select(F.explode(F.array(
        F.struct(F.lit("Normal").alias("name"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn")),
        F.struct(F.lit("Anomalous").alias("name"), F.col("tp"), F.col("fp"), F.col("fn")),
    )).alias("s")).select("s.*")
    each = _prf(sides).withColumn("support", F.col("tp") + F.col("fn"))
    n = F.sum("support")
    fields = ("precision", "recall", "f1")
    whole = each.agg(n.alias("support"), _share(F.sum("tp"), n).alias("accuracy"), *[F.avg(f).alias(f"m_{f}") for f in fields], *[_share(F.sum(F.col(f) * F.col("support")), n).alias(f"w_{f}") for f in fields])
    five = lambda c: F.format_string("%.5f", c)
    rows = whole.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("name"), *[five(F.col("accuracy")).alias(f) for f in fields], F.col("support")),
        F.struct(F.lit("macro avg").alias("name"), *[five(F.col(f"m_{f}")).alias(f) for f in fields], F.col("support")),
        F.struct(F.lit("weighted avg").alias("name"), *[five(F.col(f"w_{f}")).alias(f) for f in fields], F.col("support")),
    )).alias("s")).select("s.*")
    return each.select("name", *[five(F.col(f)).alias(f) for f in fields], "support").unionByName(rows)


def margin_stats(scored: DataFrame) -> DataFrame:
    m = F.col("margin")
    return scored.agg(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"))


def same_label_counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, n_hits, n_same, any_anomaly)`` for ``queries(query_id, label)``."""
    h = hits.select("query_id", F.col("label").alias("hit_label"))
    return queries.join(h, "query_id", "left").groupBy("query_id").agg(F.count("hit_label").alias("n_hits"), F.count_if(F.col("hit_label") == F.col("label")).alias("n_same"), F.coalesce(F.max(F.col("hit_label") == 1), F.lit(False)).alias("any_anomaly"))


def retrieval_quality(queries: DataFrame, hits: DataFrame) -> DataFrame:
    each = same_label_counts(queries, hits).withColumn("share", _share(F.col("n_same"), F.col("n_hits")))
    return each.agg(F.avg("share").alias("mean_same_label"), F.stddev_pop("share").alias("std_same_label"), F.avg(F.col("any_anomaly").cast("double")).alias("any_anomaly_rate"))


def same_label_histogram(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return same_label_counts(queries, hits).groupBy("n_same").agg(F.count("*").alias("queries"))


def run_metrics(outcomes: DataFrame) -> DataFrame:
    """One row of rates, token sums and latencies of a run.

    ``outcomes`` has a row for each screened session: ``is_anomaly, explained, verified`` booleans
    (null where that step was not reached), ``total_tokens``, ``latency_ms``.
    """
    triggered, ok = F.count_if("is_anomaly"), F.count_if("explained")
    tokens = F.coalesce(F.sum(F.when(F.col("explained"), F.col("total_tokens"))), F.lit(0))
    latency = F.when(F.col("explained"), F.col("latency_ms").cast("double"))
    p95 = exact_quantiles(outcomes.select(latency.alias("v")), [0.95])[0] or 0.0
    return outcomes.agg(
        F.count("*").alias("sessions"), triggered.alias("anomalies"), ok.alias("explained"), (triggered - ok).alias("failed"),
        _share(triggered, F.count("*")).alias("trigger_rate"), _share(ok, triggered).alias("success_rate"), _share(F.count_if("verified"), ok).alias("verification_rate"),
        tokens.alias("tokens"), _share(tokens, ok).alias("avg_tokens"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("mean_latency"), F.lit(float(p95)).alias("p95_latency"),
    )


def prediction_check(scored: DataFrame) -> DataFrame:
    name = lambda c: F.when(F.col(c) == 1, "Anomalous").otherwise("Normal")
    return scored.select("session_id", name("label").alias("actual"), name("pred").alias("predicted"), (F.col("label") == F.col("pred")).alias("match"))
