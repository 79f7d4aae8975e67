"""A run that is stopped on its way gives each record once."""

import pytest
from pyspark.sql import functions as F

from tracewright.plans.runs import Run


def test_a_stopped_run(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("session_id"))
    run, seen = Run(spark, f"{tmp_path}/run"), []

    def work(own):
        seen.append(own.count())
        if len(seen) == 4:
            own.write.text(f"{tmp_path}/run/records/half-written")  # what a lost run leaves behind
            raise RuntimeError("stopped")
        return own.withColumn("twice", F.col("session_id").cast("int") * 2)

    assert run.records("session_id string").collect() == []
    with pytest.raises(RuntimeError):
        run.resume(rows, "session_id", work, batches=8)
    first = {r.session_id for r in run.records("session_id string").collect()}
    assert len(run.committed()) == 3 and 0 < len(first) == sum(seen[:3])
    again = Run(spark, f"{tmp_path}/run")
    assert again.resume(rows, "session_id", work, batches=8) == 5
    got = [(r.session_id, r.twice) for r in again.records("session_id string, twice int").collect()]
    assert sorted(got) == sorted((str(i), 2 * i) for i in range(200))
    assert again.resume(rows, "session_id", work, batches=8) == 0
    # rows that come later
    more = spark.range(250).select(F.col("id").cast("string").alias("session_id"))
    for total in (250, 250):
        again.resume(more, "session_id", work, batches=8)
        assert sorted(int(r.session_id) for r in again.records("session_id string").collect()) == list(range(total))
    # a second attempt at a batch that is committed does not count
    assert not again.commit("0", "other") and again.committed()["0"] != "other"
