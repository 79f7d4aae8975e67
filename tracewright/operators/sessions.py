"""Sessions: strided windows of lines and sessions by a key in the line (SES1-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import anomalous, evidence_id, key_id, label_flag, log_time, long_enough, message, only_key, first_key, retrieval_tokens, window_id  # noqa: F401
from ..sources.scratch import Work


def count_windows(lines: DataFrame, size: int = 10, step: int = 10, include_last: bool = False) -> DataFrame:
    """Windows of ``size`` lines that start at each multiple of ``step`` below N - size.

    ``(session_id, start_idx, label, lines, dataset)`` from ``(line_no, line)`` with dense 0-based
    numbers.  A window that ends exactly at N is dropped unless ``include_last``.  The label is 1
    if any line is anomalous; lines lose their label token.
    """
    no = F.col("line_no")
    total = lines.agg((F.max("line_no") + 1).alias("_total"))
    lo, hi = F.greatest(F.lit(0), F.ceil((no - size + 1) / step)), F.floor(no / step)
    placed = lines.select("line_no", "line", lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi")).where("_lo <= _hi")
    starts = placed.select("line_no", "line", F.explode(F.sequence(F.col("_lo") * step, F.col("_hi") * step, F.lit(step).cast("bigint"))).alias("start_idx"))
    limit = F.col("_total") - size
    kept = starts.join(F.broadcast(total), (F.col("start_idx") <= limit) if include_last else (F.col("start_idx") < limit))
    row = F.struct("line_no", message(F.col("line")).alias("line"))
    agg = kept.groupBy("start_idx").agg(F.max(F.coalesce(anomalous(F.col("line")), F.lit(False)).cast("int")).alias("label"), F.sort_array(F.collect_list(row)).alias("_l"))
    return agg.select(window_id(F.col("start_idx")).alias("session_id"), "start_idx", "label", F.transform("_l", lambda x: x["line"]).alias("lines"), F.lit("BGL").alias("dataset"))


def keyed_sessions(lines: DataFrame, key: Column, time: Column | None = None, max_lines: int | None = None) -> DataFrame:
    """``(block_id, lines)``: lines by key, in file order, or by time and then file order.

    Lines without a key, or without a time where one is asked for, are dropped.  ``max_lines``
    keeps the first lines of a session, cut before lines are gathered.
    """
    rows = lines.select(key.alias("block_id"), *([time.alias("ts")] if time is not None else []), "line_no", "line").where("block_id IS NOT NULL")
    order = ["ts", "line_no"] if time is not None else ["line_no"]
    if time is not None:
        rows = rows.where("ts IS NOT NULL")
    if max_lines is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("block_id").orderBy(*order))).where(F.col("_k") <= max_lines)
    whole = rows.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("_l"))
    return whole.select("block_id", F.transform("_l", lambda x: x["line"]).alias("lines"))


def segmented_sessions(lines: DataFrame, key: Column, time: Column | None = None, size: int = 10_000, parts: int | None = None) -> DataFrame:
    """``(block_id, segment, place, line_no, line)``: sessions of any length as rows; ``place`` is a line's 0-based place
    in its session, in file order or by time and then file order, and ``segment`` is ``place`` div ``size``.

    Lines are dealt by ranges of (key, order) and sorted, so a key of a third of all lines lies in a third of the
    tasks.  Each task's lines of a key are counted where they are; what stands in the tasks before gives
    each of these pieces its offset.  No task and no row holds a session.
    """
    order = ["ts", "line_no"] if time is not None else ["line_no"]
    rows = lines.select(key.alias("block_id"), *([time.alias("ts")] if time is not None else []), "line_no", "line").where("block_id IS NOT NULL")
    rows = rows.where("ts IS NOT NULL") if time is not None else rows
    dealt = rows.repartitionByRange(*([parts] if parts else []), "block_id", *order).sortWithinPartitions("block_id", *order)
    # written, as ranges drawn anew could differ; the id has the task's number above its line's
    dealt = Work(lines.sparkSession, "segments").table(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("_at", 33).alias("_part")
    pieces = dealt.groupBy("block_id", part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("block_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("block_id", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_part", part).join(pieces, ["block_id", "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.select("block_id", F.floor(F.col("place") / size).alias("segment"), "place", "line_no", "line")


def segments(placed: DataFrame) -> DataFrame:
    """``(block_id, segment, n_lines, label, lines)``: a bounded array of lines for each segment; 1 if one of them is anomalous."""
    bad = F.coalesce(anomalous(F.col("line")), F.lit(False)).cast("int")
    whole = placed.groupBy("block_id", "segment").agg(F.count("*").alias("n_lines"), F.max(bad).alias("label"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("_l"))
    return whole.select("block_id", "segment", "n_lines", "label", F.transform("_l", lambda x: x["line"]).alias("lines"))


def session_totals(segmented: DataFrame, fan: int = 1000) -> DataFrame:
    """``(block_id, n_segments, n_lines, label, digest)`` of ``segments``; ``digest`` is the md5 of the lines where there is one
    segment, else that of up to ``fan`` digests, level by level, so that no row gathers more."""
    level = segmented.select("block_id", F.col("segment").alias("_i"), F.lit(1).cast("bigint").alias("n_segments"), "n_lines", "label", F.md5(F.array_join("lines", "\n")).alias("digest"))
    work = Work(segmented.sparkSession, "totals")
    level = work.table(level, "level")
    while (level.agg(F.max("_i")).first()[0] or 0) > 0:
        up = level.groupBy("block_id", F.floor(F.col("_i") / fan).alias("_i")).agg(
            F.sum("n_segments").alias("n_segments"), F.sum("n_lines").alias("n_lines"), F.max("label").alias("label"), F.sort_array(F.collect_list(F.struct("_i", "digest"))).alias("_d")
        )
        joined = F.md5(F.array_join(F.transform("_d", lambda x: x["digest"]), ","))
        level = work.table(up.select("block_id", "_i", "n_segments", "n_lines", "label", F.when(F.size("_d") > 1, joined).otherwise(F.get("_d", F.lit(0))["digest"]).alias("digest")), "level")
    return level.drop("_i")


def strict_keyed_sessions(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines of two tokens or more, with a time and exactly one distinct key, in time order."""
    line = F.col("line")
    return keyed_sessions(lines.where(long_enough(line)), only_key(line, pattern), log_time(line))


def with_labels(sessions: DataFrame, labels: DataFrame, exact: bool = False) -> DataFrame:
    """Left join on ``block_id``; a session without a label is normal (0)."""
    own = labels.select("block_id", F.col("label").alias("_label"))
    return sessions.join(own, "block_id", "left").withColumn("label", label_flag(F.col("_label"), exact)).drop("_label")


def inspection(sessions: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` sessions by id, with their lines' words as one text (AGG12)."""
    first = sessions.orderBy("session_id").limit(n)
    return first.select("session_id", "label", F.size("lines").alias("n_lines"), F.array_join(F.flatten(F.transform("lines", retrieval_tokens)), " ").alias("decoded"))


def shaped(lines: Column, size: int) -> Column:
    """Exactly ``size`` lines: cut, or filled up with empty ones."""
    return F.slice(F.concat(lines, F.array_repeat(F.lit(""), F.greatest(size - F.size(lines), F.lit(0)))), 1, size)


def key_coverage(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: session keys, label keys, and keys of both."""
    a = sessions.select("block_id").distinct().withColumn("_s", F.lit(1))
    b = labels.select("block_id").distinct().withColumn("_l", F.lit(1))
    both = a.join(b, "block_id", "full")
    return both.agg(F.count("_s").alias("session_keys"), F.count("_l").alias("label_keys"), F.count_if(F.col("_s").isNotNull() & F.col("_l").isNotNull()).alias("in_both"))
