"""Session scores and classifiers (SCO1-6, OPT1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import retrieval_tokens
from ..sources.scratch import Work


def score_columns(df: DataFrame, logits: str = "logits") -> DataFrame:
    """``prob`` (softmax), ``pred`` (first of the largest), ``margin``, ``confidence``,
    ``anomaly_prob``, ``is_anomaly`` from two logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    out = df.withColumn("pred", (F.array_position(logits, top) - 1).cast("int")).withColumn("prob", p)
    one, two = F.get("prob", F.lit(0)), F.get("prob", F.lit(1))
    return out.withColumns({"margin": F.abs(two - one), "confidence": F.get("prob", F.col("pred")), "anomaly_prob": two, "is_anomaly": F.col("pred") == 1})


def anomalies(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    return sessions.join(scores.where("pred = 1"), "session_id")


def shaped(df: DataFrame, weight: float = 4.0) -> DataFrame:
    """Sessions as ``tokens``, with the ``weight`` of their label: what every fit reads."""
    return df.withColumn("tokens", retrieval_tokens(F.array_join("lines", " "))).withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))


def fit_classifier(train: DataFrame, val: DataFrame, weight: float = 4.0, features: int = 1 << 16, reg: tuple[float, ...] = (0.001, 0.01, 0.1), patience: int | None = None) -> PipelineModel:
    """Weighted logistic regression over hashed words; the regularisation with the best F1 of
    label 1 on ``val`` is kept.  With ``patience`` the path ends when the loss on ``val`` has not fallen for so many values.

    Sessions are written once as hashed counts, which all fits read; nothing is kept in memory but the blocks of the fit that runs."""
    work = Work(train.sparkSession, "fit")
    hashing = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features)
    seen = work.table(hashing.transform(shaped(train, weight)).select("tf", "label", "weight"), "train")
    held = work.table(hashing.transform(shaped(val, weight)).select("tf", "label"), "val")
    idf = IDF(inputCol="tf", outputCol="features").fit(seen)  # for all values of the path
    ready = idf.transform(seen).select("features", "label", "weight")
    best, least, worse = None, None, 0
    one = vector_to_array("probability")[1]
    loss = -F.ln(F.greatest(F.when(F.col("label") == 1, one).otherwise(1 - one), F.lit(1e-15)))
    for r in reg:
        m = LogisticRegression(labelCol="label", weightCol="weight", regParam=r, maxIter=20).fit(ready)
        tp, fp, fn, cost = m.transform(idf.transform(held)).agg(*[F.count_if((F.col("label") == y) & (F.col("prediction") == p)) for y, p in ((1, 1), (0, 1), (1, 0))], F.avg(loss)).first()
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if best is None or f1 > best[0]:
            best = (f1, m)
        worse = worse + 1 if least is not None and (cost or 0.0) >= least else 0
        least = (cost or 0.0) if least is None else min(least, cost or 0.0)
        if patience is not None and worse >= patience:
            break
    work.clear()
    return PipelineModel([hashing, idf, best[1]])


def score_sessions(model: PipelineModel, sessions: DataFrame) -> DataFrame:
    """``(session_id, label, logits, prob, pred, margin ...)``, one row for each session."""
    t = model.transform(sessions.withColumn("tokens", retrieval_tokens(F.array_join("lines", " "))))
    return score_columns(t.select("session_id", "label", vector_to_array("rawPrediction").alias("logits")))


def score_one(model: PipelineModel, session: DataFrame) -> DataFrame:
    name = F.when(F.col("pred") == 1, "Anomalous").otherwise("Normal")
    lines = session.select("session_id", F.size("lines").alias("length"))
    return score_sessions(model, session).join(lines, "session_id").select("session_id", name.alias("prediction"), F.get("prob", F.lit(0)).alias("normal_prob"), "anomaly_prob", "confidence", "length")


def score_with(sessions: DataFrame, fn: Callable[[Iterator], Iterator]) -> DataFrame:
    """A model of the caller's own: ``fn`` maps pandas batches to (session_id, logits)."""
    return score_columns(sessions.mapInPandas(fn, "session_id string, logits array<double>"))


def sweep(train: DataFrame, val: DataFrame, test: DataFrame, values: list[int], patience: int | None = None) -> DataFrame:
    """Refit for each number of features; macro F1 and accuracy on ``test``.

    One fit after the other, each on all executors, so that only one of them has its counts and blocks at a time.
    """
    from .metrics import classification_report

    work = Work(train.sparkSession, "sweep")
    out = None
    for v in values:
        r = classification_report(score_sessions(fit_classifier(train, val, features=v, patience=patience), test).select("label", "pred"))
        row = r.agg(F.lit(v).alias("k"), F.max(F.when(F.col("name") == "macro avg", F.col("f1"))).cast("double").alias("macro_f1"), F.max(F.when(F.col("name") == "accuracy", F.col("f1"))).cast("double").alias("test_acc"))
        row = work.table(row, f"k{v}")
        out = row if out is None else out.unionByName(row)
    return out


def gated(scores: DataFrame, share: float | None = 0.2, margin: float | None = None) -> DataFrame:
    """Anomalies to explain under a budget: the least margins, or those under a bound."""
    own = scores.where("pred = 1")
    if margin is not None:
        return own.where(F.col("margin") < margin)
    # a histogram of margins finds the bound; only its own cell is ranked
    cells = own.withColumn("_c", F.floor(F.col("margin") * 4096))
    counts = [(r["_c"], r["n"]) for r in cells.groupBy("_c").agg(F.count("*").alias("n")).orderBy("_c").collect()]
    want = -(-sum(n for _, n in counts) * share // 1)
    below = 0
    for c, n in counts:
        if below + n >= want:
            last = cells.where(F.col("_c") == c).orderBy("margin", "session_id").limit(int(want - below))
            return cells.where(F.col("_c") < c).unionByName(last).drop("_c")
        below += n
    return own
