"""A join of rows with a table of counted keys in which no key can fill a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import Work

#: A key with this share of all counted rows is hot; so there are at most this many hot keys.
HOT_KEYS = 10_000


def counted_join(work: Work, rows: DataFrame, table: DataFrame, on: Sequence[str], n: str, spread: Sequence[Column], how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the other columns of ``table`` (one row a key, ``n`` rows of ``rows`` each), inner or left.

    ``table`` must be a written one.  Keys that hold 1 / ``hot_keys`` of all its counted rows or more
    are sent to every task: there are at most ``hot_keys`` of them, whatever the input.  Their rows
    pass the shuffle of the others under a key made of ``spread``, so that each key of the shuffle holds less than
    1 / ``hot_keys`` of the rows.
    """
    on, own = list(on), [c for c in table.columns if c not in (*on, n)]
    total = table.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * hot_keys >= F.lit(total)
    wide = lambda df, p: df.select(*on, *[F.col(c).alias(f"{p}{c}") for c in own], F.lit(True).alias(f"{p}met"))
    hot, rest = wide(table.where(is_hot), "_h_"), wide(table.where(~is_hot), "_r_")
    marked = rows.join(F.broadcast(hot), on, "left")
    cold = F.col("_h_met").isNull()
    keys = [f"_k{i}" for i in range(len(on))]
    away = F.xxhash64(*spread)
    marked = marked.select("*", cold.alias("_cold"), *[F.when(cold, F.col(c)).otherwise(away.cast(rows.schema[c].dataType) if i == 0 else F.lit(None)).alias(k) for i, (c, k) in enumerate(zip(on, keys, strict=True))])
    rest = rest.select(*[F.col(c).alias(f"_t{k}") for c, k in zip(on, keys, strict=True)], *[c for c in rest.columns if c not in on])
    same = [F.col(k).eqNullSafe(F.col(f"_t{k}")) if i else F.col(k) == F.col(f"_t{k}") for i, k in enumerate(keys)]
    met = marked.join(rest, [*same, F.col("_cold") == F.col("_r_met")], "left")
    met = met.where("_h_met OR _r_met") if how == "inner" else met
    return met.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_r_{c}").alias(c) for c in own])
