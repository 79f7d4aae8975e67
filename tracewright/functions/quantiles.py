"""Exact quantiles by distributed selection: what tasks send is bounded whatever the column holds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Work

_MOST = 1.7976931348623157e308


def exact_quantiles(values: DataFrame, probabilities: Sequence[float], cells: int = 1024, few: int = 10_000) -> list[float | None]:
    """The quantiles of the one numeric column of ``values``, linear between neighbours; None without values.

    The range that holds a wanted rank is cut into ``cells`` equal parts, the rows of each are counted, and
    the part with the rank is the next range, until it has ``few`` rows, or one value only.  Each round is
    one aggregation to at most ``cells`` rows a rank, and shares its scan with the other ranks.  Null and NaN are left
    out; infinities count as the largest finite numbers.
    """
    (name,) = values.columns
    v = F.col("v")
    work = Work(values.sparkSession, "quantiles")
    x = F.col(name).cast("double")
    known = values.where(x.isNotNull() & ~F.isnan(x))  # first: greatest() and least() pass over nulls
    table = work.table(known.select(F.greatest(F.least(x, F.lit(_MOST)), F.lit(-_MOST)).alias("v")), "values")
    facts = table.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not facts.n:
        return [None] * len(probabilities)
    places = [(facts.n - 1) * p for p in probabilities]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    at = {r: (facts.lo, facts.hi, 0, facts.n) for r in ranks}  # range, rows below it, rows in it
    while True:
        wide = sorted({x for x in at.values() if x[0] < x[1] and x[3] > few})
        if not wide:
            break
        half = lambda c: c * F.lit(0.5)  # noqa: E731  no overflow between extremes
        cell = lambda lo, hi: F.least(F.floor((half(v) - lo / 2) / (hi / 2 - lo / 2) * cells), F.lit(cells - 1)).cast("int")
        parts = [F.when(v.between(lo, hi), F.struct(F.lit(i).alias("i"), cell(lo, hi).alias("c"))) for i, (lo, hi, _, _) in enumerate(wide)]
        held = table.select("v", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("p"))
        counts = held.groupBy("p.i", "p.c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most cells a range
        for i, (lo, hi, below, n) in enumerate(wide):
            inner = []
            for c in sorted((c for c in counts if c.i == i), key=lambda c: c.c):
                inner.append((c.lo, c.hi, below, c.n))
                below += c.n
            for r in [r for r, x in at.items() if x[:2] == (lo, hi) and x[3] == n]:
                at[r] = next(x for x in inner if x[2] <= r < x[2] + x[3])
    found = {r: x[0] for r, x in at.items() if x[0] == x[1]}
    small = sorted({x for r, x in at.items() if r not in found})
    if small:
        near = table.where(" OR ".join(f"v BETWEEN {lo!r}D AND {hi!r}D" for lo, hi, _, _ in small)).collect()  # at most few a range
        for lo, hi, below, _ in small:
            own = sorted(r.v for r in near if lo <= r.v <= hi)
            found |= {r: own[r - below] for r, x in at.items() if r not in found and x[:3] == (lo, hi, below)}
    work.clear()
    out = []
    for x in places:
        a, b = math.floor(x), math.ceil(x)
        out.append(found[a] if a == b or found[a] == found[b] else (b - x) * found[a] + (x - a) * found[b])
    return out
