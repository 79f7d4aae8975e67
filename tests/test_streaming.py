"""The stream gives the windows that the table gives."""

import random

from tracewright.operators import sessions
from tracewright.streaming import window_labels


def test_windows_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", f"{rng.choice(['-', '-', '-', 'ERR'])} line {i}") for i in range(700)]  # over several five-minute marks
    lines = spark.createDataFrame(rows, "line_no long, ts string, line string").selectExpr("line_no", "CAST(ts AS timestamp) AS ts", "line")
    for k in range(4):
        lines.where(f"line_no % 4 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for size, step in ((10, 10), (10, 4)):
        q = window_labels(stream, size, step).writeStream.format("parquet").option("path", f"{tmp_path}/out{step}").option("checkpointLocation", f"{tmp_path}/ck{step}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None
        got = {r.session_id: (r.label, r.n_lines) for r in spark.read.parquet(f"{tmp_path}/out{step}").collect()}
        want = {r.session_id: (r.label, len(r.lines)) for r in sessions.count_windows(lines, size, step, include_last=True).collect()}
        assert got == want
