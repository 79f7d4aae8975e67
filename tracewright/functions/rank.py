"""Distributed rank: no window ever holds more than one of 4096 hash ranges of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, by: Sequence[str], key: str, seed: object = 42, out: str = "rank", size: str | None = None) -> DataFrame:
    """Append the 0-based rank within ``by`` in the order of md5(seed|key), ties by key; and the
    group's size if a name is given.

    Rows are counted by the first three hex digits of the hash, the counts' running sums (a few
    thousand rows for each group) give each range its offset, and rows are numbered in a range.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_b"]
    offsets = counts.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_size"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    joined = hashed.join(offsets, same).drop(*[f"_k_{c}" for c in keys])
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    got = joined.withColumn(out, F.col("_before") + inside - 1)
    return (got.withColumnRenamed("_size", size) if size else got.drop("_size")).drop("_h", "_b", "_before")
