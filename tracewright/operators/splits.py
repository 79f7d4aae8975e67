"""Splits, oversampling and limits (SPL1-6), reproducible from hashes of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import hash_rank

SPLITS = ("train", "val", "test")


def stratified_split(sessions: DataFrame, train: float = 0.7, val: float = 0.15, seed: object = 42, key: str = "session_id") -> DataFrame:
    """Append ``split``: of each label, in hash order, the first ⌊n·train⌋, up to ⌊n·(train+val)⌋, rest."""
    r = hash_rank(sessions, ["label"], key, seed, "_r", "_n")
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + val))
    return r.withColumn("split", F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "val").otherwise("test")).drop("_r", "_n")


def two_stage_split(sessions: DataFrame, train: float = 0.7, test_share: float = 0.5, seed: object = 42, key: str = "session_id") -> DataFrame:
    """Train against the rest, then the rest again by another hash."""
    first = hash_rank(sessions, ["label"], key, seed, "_r", "_n").withColumn("_t", F.col("_r") < F.floor(F.col("_n") * F.lit(train))).drop("_r", "_n")
    second = hash_rank(first, ["label", "_t"], key, f"{seed}/2", "_r", "_n")
    rest = F.when(F.col("_r") < F.floor(F.col("_n") * F.lit(1 - test_share)), "val").otherwise("test")
    return second.withColumn("split", F.when(F.col("_t"), "train").otherwise(rest)).drop("_r", "_n", "_t")


def oversampled(sessions: DataFrame, beta: float = 0.4, seed: object = 42, on_empty: str = "skip", key: str = "session_id") -> DataFrame:
    """Rows of the input and draws with replacement of label 1, until its share is ``beta``.

    Appends ``draw``: null for rows of the input, the draw's number for added ones.  Without label 1:
    the input, or an error if ``on_empty`` says so.
    """
    n, k = sessions.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    same = sessions.withColumn("draw", F.lit(None).cast("bigint"))
    if not k:
        if on_empty == "error":
            raise ValueError("there are no sessions of label 1 to draw from")
        return same
    alpha = k / n
    more = int(beta * (1 - alpha) / (1 - beta) * n) - k
    if more <= 0:
        return same
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("bigint") % k
    draws = sessions.sparkSession.range(more).select(F.col("id").alias("draw")).select("draw", pick.alias("_r"))
    minority = hash_rank(sessions.where("label = 1").withColumn("_one", F.lit(1)), ["_one"], key, seed, "_r").drop("_one")
    return same.unionByName(draws.join(minority, "_r").select(*sessions.columns, "draw"))


def shuffled(sessions: DataFrame, seed: object = 42, key: str = "session_id") -> DataFrame:
    return sessions.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)


def in_split(sessions: DataFrame, split: str | None = None) -> DataFrame:
    return sessions if split is None else sessions.where(F.col("split") == split)


def head(sessions: DataFrame, n: int, key: str = "session_id") -> DataFrame:
    """The first ``n`` sessions, train before val before test, by key."""
    return sessions.orderBy(F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")), key).limit(n)


def head_by_label(sessions: DataFrame, n: int, key: str = "session_id") -> DataFrame:
    from pyspark.sql import Window

    return sessions.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(key))).where(F.col("_k") <= n).drop("_k")
