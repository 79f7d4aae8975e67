"""Exact quantiles, sessions in segments, batches by length."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions.quantiles import exact_quantiles
from tracewright.operators import sequences, sessions


@pytest.mark.parametrize("few", [4, 50, 10_000])
def test_exact_quantiles(spark, few):
    rng = random.Random(2)
    many = [rng.choice([3.0, 3.0, 3.0, rng.gauss(0, 10), rng.paretovariate(0.5), -1e300, 1e300]) for _ in range(800)]
    for values in (many, [5.0] * 300, [1.0], [1.0, 2.0], [0.1 * i for i in range(301)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(4)
        want = df.where("NOT isnan(x)").agg(F.percentile("x", [0.0, 0.05, 0.5, 0.9, 0.95, 1.0])).first()[0]
        assert exact_quantiles(df, [0.0, 0.05, 0.5, 0.9, 0.95, 1.0], cells=8, few=few) == list(want)
    assert exact_quantiles(df.limit(0), [0.5]) == [None]
    assert exact_quantiles(spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "x double"), [0.5]) == [1.0]


def log(rng, n):
    """A third of all lines have one key; times repeat."""
    return [(rng.choice([1, 2, 2, 3, 5]) * 10 if rng.random() < 0.9 else None, i, f"{'ERR' if rng.random() < 0.02 else '-'} key {'hot' if rng.random() < 0.34 else rng.randint(0, 40)} line {i}") for i in range(n)]


def test_segmented_sessions(spark):
    rows = log(random.Random(4), 3000)
    df = spark.createDataFrame(rows, "ts long, line_no long, line string").repartition(7)
    key = F.regexp_extract("line", r"key (\w+)", 1)
    for time, order in ((None, lambda r: r[1]), (F.col("ts"), lambda r: (r[0], r[1]))):
        want = {}
        for r in sorted((r for r in rows if time is None or r[0] is not None), key=order):
            want.setdefault(r[2].split()[2], []).append(r[2])
        placed = sessions.segmented_sessions(df, key, time, size=50, parts=9)
        got = {}
        for r in sorted(placed.collect(), key=lambda r: r.place):
            got.setdefault(r.block_id, []).append(r.line)
            assert r.segment == r.place // 50
        assert got == want
        cut = {(r.block_id, r.segment): (r.n_lines, r.label, r.lines) for r in sessions.segments(placed).collect()}
        assert cut == {(k, i // 50): (len(x := v[i : i + 50]), int(any(y.startswith("ERR") for y in x)), x) for k, v in want.items() for i in range(0, len(v), 50)}
        total = {r.block_id: r for r in sessions.session_totals(sessions.segments(placed), fan=3).collect()}
        for k, v in want.items():
            level = [hashlib.md5("\n".join(v[i : i + 50]).encode()).hexdigest() for i in range(0, len(v), 50)]
            n = len(level)
            while len(level) > 1:
                level = [hashlib.md5(",".join(x).encode()).hexdigest() if len(x := level[i : i + 3]) > 1 else x[0] for i in range(0, len(level), 3)]
            assert (total[k].n_lines, total[k].n_segments, total[k].digest) == (len(v), n, level[0])


def test_a_hot_key_lies_in_many_tasks(spark):
    lines = spark.range(20_000).select(F.col("id").alias("line_no"), F.concat(F.lit("- key "), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")), F.lit(" x")).alias("line"))
    placed = sessions.segmented_sessions(lines, F.regexp_extract("line", r"key (\w+)", 1), size=100, parts=30)
    hot = placed.where("block_id = 'hot'")
    assert hot.agg(F.max("place")).first()[0] == 6666
    tasks = hot.groupBy(F.spark_partition_id().alias("p")).count()
    pieces = placed.inputFiles()
    held = spark.read.parquet(*pieces).where("block_id = 'hot'").groupBy(F.input_file_name()).count().agg(F.count("*").alias("files"), F.max("count").alias("most")).first()
    assert held.files >= 8 and held.most < 1500 and tasks.count() >= 1


def test_length_batches(spark):
    rng = random.Random(6)
    rows = [(f"s{i}", [1] * rng.choice([1, 5, 8, 9, 16, 17, 40, 300])) for i in range(400)] + [("none", [])]
    df = spark.createDataFrame(rows, "session_id string, input_ids array<int>")
    got = sequences.length_batches(df, budget=128, step=8).collect()
    assert {r.session_id for r in got} == {s for s, _ in rows}
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r)
    for batch in by.values():
        longest = max(len(r.input_ids) for r in batch)
        assert all(r.width == longest and r.padded_ids == r.input_ids + [0] * (longest - len(r.input_ids)) for r in batch)
        assert len(batch) == 1 or sum(len(r.padded_ids) for r in batch) <= 128
        assert longest - min(max(1, len(r.input_ids)) for r in batch) < 8
    assert np.mean([len(b) for b in by.values()]) > 2
