import pytest
from pyspark.sql import functions as F

from tracewright.operators import sessions as W
from tracewright.operators import splits as P
from tracewright.operators.sequences import padded
from tracewright.sources import logs


def some_lines(spark, n):
    return spark.range(n).select(F.col("id").alias("line_no"), F.concat(F.when(F.col("id") % 7 == 3, "ERR").otherwise("-"), F.lit(" m"), F.col("id").cast("string")).alias("line"))


@pytest.mark.parametrize("n,w,s", [(20, 10, 10), (21, 10, 10), (12, 4, 2), (10, 10, 10), (12, 2, 5), (30, 7, 3)])
def test_count_windows(spark, n, w, s):
    got = {r.start_idx: (r.label, r.lines) for r in W.count_windows(some_lines(spark, n), w, s).collect()}
    want = {i: (int(any(j % 7 == 3 for j in range(i, i + w))), [f"m{j}" for j in range(i, i + w)]) for i in range(0, n - w, s)}
    assert got == want


def test_split_sizes(spark):
    rows = [(f"a{i}", 0) for i in range(20)] + [(f"b{i}", 1) for i in range(7)] + [("c", 2)]
    got = P.stratified_split(spark.createDataFrame(rows, "session_id string, label int")).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {(0, "train"): 14, (0, "val"): 3, (0, "test"): 3, (1, "train"): 4, (1, "val"): 1, (1, "test"): 2, (2, "test"): 1}


def test_oversampling(spark):
    rows = [(f"s{i}", int(i < 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "session_id string, label int")
    assert P.oversampled(df).count() == 150
    assert P.oversampled(df, beta=0.05).count() == 100
    assert P.oversampled(df.where("label = 0")).count() == 90
    with pytest.raises(ValueError):
        P.oversampled(df.where("label = 0"), on_empty="error")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"  line {i} " for i in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = logs.read_lines(spark, str(tmp_path / "a.log")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.line) for r in got) == [(i, f"line {i}") for i in range(2000)]
    (tmp_path / "l.csv").write_text("BlockId,Label\nb1,Normal\nb2,Anomaly\nb1,Anomaly\n")
    assert {r.block_id: r.label for r in logs.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {"b1": "Anomaly", "b2": "Anomaly"}
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    logs.save_records(df, str(tmp_path / "rec"))
    assert sorted(tuple(r) for r in spark.read.schema("a int, b string").json(str(tmp_path / "rec")).collect()) == [(1, "x"), (2, None)]
    calls = []
    for _ in range(2):
        logs.load_or_build(spark, str(tmp_path / "t"), lambda: calls.append(1) or df)
    assert len(calls) == 1


def test_the_last_label_counts(spark, tmp_path):
    """Keys come again in later blocks of a file, and in a later file that is smaller and so may be read first."""
    rows = [(f"b{i % 300}", f"L{i}") for i in range(1500)]
    (tmp_path / "a.csv").write_text("BlockId,Label\n" + "".join(f"{k},{v}\n" for k, v in rows))
    (tmp_path / "b.csv").write_text("BlockId,Label\nb7,late\n,none\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    got = {r.block_id: r.label for r in logs.read_labels(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(rows) | {"b7": "late"}


def test_padding(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4, 5],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(padded(F.col("x"), 4)).collect()] == [[1, 2, 0, 0], [1, 2, 3, 4], [0, 0, 0, 0]]
