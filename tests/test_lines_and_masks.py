import random
import re

from pyspark.sql import functions as F

from tracewright.functions import lines as L
from tracewright.functions import masking as K
from tracewright.functions.rank import hash_rank


def masked(spark, profile, text, custom=()):
    df = spark.createDataFrame([(text,)], "line string")
    r = K.mask_columns(df, "line", K.rules_for(profile, custom), "masked", "stats").first()
    return r.masked, r.stats


def test_masking_goldens(spark):
    text = "170304 112233 88 WARN store.Copier$Worker: Sending piece blk_-42000000000000007 from /192.0.2.17:61000 into /198.51.100.4:50020"
    assert masked(spark, "hdfs", text) == ("<NUM> <NUM> <NUM> WARN store.Copier$Worker: Sending piece <BLOCK> from /<DATANODE> into /<DATANODE>", {"BLOCK": 1, "DATANODE": 2, "NUM": 3})
    text = "- 1300000001 2011.03.13 R47-M0-N9-C:J03-U01 2011-03-13-07.06.41.000017 R47-M0-N9-C:J03-U01 RAS NET FATAL probe: no answer on the link towards 203.0.113.9:40404"
    want = "- <IPV6> <NUM>.<NUM>.<NUM> <NODE> <NUM>-<NUM>-<NUM>-<NUM>.<NUM>.<NUM>.<NUM> <NODE> RAS NET FATAL probe: no answer on the link towards <IPV4>:<PORT>"
    assert masked(spark, "BGL", text) == (want, {"NODE": 2, "IPV4": 1, "IPV6": 1, ":<PORT": 1, "NUM": 10})


def masks_by_hand(text, rules):
    """Each rule on the text that the ones before it left, with Python's own Unicode-aware classes."""
    counts = {}
    for pattern, to in rules:
        text, n = re.subn(pattern, lambda m, to=to: re.sub(r"\\(\d)", lambda d: m.group(int(d[1])), to), text)
        counts[K.stat_key(to)] = counts.get(K.stat_key(to), 0) + n
    return text, {k: n for k, n in counts.items() if n}


def test_masks_by_brute_force(spark):
    rng = random.Random(7)
    bits = [" ", " ", "R01-M1-N3", "-C:J02-U11", "blk_-77", "core.5", "DDR(1,2,3)", "(4,5,6)", "10.1.2.3", ":8080", "/usr/été/x", "http://a.b/c", "me@x.org", "2024-01-02 03:04:05", "0xfeedface", "deadbeef", "Mar  7", "pid=12", "tid 9", "thread: 5", "é", "word", "٣٤٥", "١٢", "1234567", "42", "\u00a0", "size=7", "replicas=2", "/tmp/a_b", "/user/x/y", "user 5 ", "漢字12"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(400)] + ["".join(rng.choices([b for b in bits if b.isascii()], k=12)) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k long, line string")
    for profile, custom in (("", ()), ("bgl", ()), ("HDFS", ()), ("", ((r"user (\d+)", r"user \1"), (r"word", "mot é")))):
        rules = K.rules_for(profile, custom)
        got = {r.k: r for r in K.mask_columns(df, "line", rules, "masked", "stats").withColumn("plain", K.mask(F.col("line"), rules)).collect()}
        assert got.pop(-1).masked is None
        for k, t in enumerate(texts):
            want = masks_by_hand(t, rules)
            assert (got[k].masked, got[k].stats) == want and got[k].plain == want[0], t


def test_filters_below_masks_do_not_repeat_them(spark):
    df = K.mask_columns(spark.createDataFrame([("a 42 b",)], "line string"), "line", K.rules_for("BGL"), "masked", "stats")
    assert df.where("masked LIKE '%NUM%'").count() == 1  # ends at once: no step refers to the one before it more than once


def test_literals_of_patterns():
    assert [K.literal_of(p) for p in (r"\bcore\.\d+", r"a|bc", r"https?:\/\/x", r"(?i)abc", r"\d+", r"[ab]cd?e", r"(unclosed")] == ["core.", "", "http", "", "", "c", ""]


def test_mask_accidents(spark):
    assert masked(spark, "", "http://a/b size 67108864 x 7 42 defaced")[0] == "http:<PATH> size <IPV6> x 7 <NUM> <IPV6>"
    assert masked(spark, "", "cost 5", ((r"cost (\d)", r"$\1"),))[0] == "cost 5"[:0] + "$5"


def test_line_functions(spark):
    rows = [("- abc def",), ("ERR x",), ("",), ("one",)]
    got = spark.createDataFrame(rows, "line string").select(L.anomalous(F.col("line")), L.message(F.col("line")), L.long_enough(F.col("line"))).collect()
    assert [tuple(r) for r in got] == [(False, "abc def", True), (True, "x", True), (None, "", False), (True, "one", False)]
    x = spark.createDataFrame([("081109 203518 35 INFO blk_-1 and blk_-1",), ("a b blk_1 blk_2",), ("no key",)], "line string")
    got = x.select(L.first_key(F.col("line")), L.only_key(F.col("line")), L.log_time(F.col("line")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("blk_-1", "blk_-1", "2008-11-09 20:35:18"), ("blk_1", None, None), (None, None, None)]
    assert [r[0] for r in spark.createDataFrame([("Anomaly",), ("normal",), ("1",), (None,)], "x string").select(L.label_flag(F.col("x"))).collect()] == [1, 0, 1, 0]


def test_hash_rank_is_dense(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    for g in range(3):
        ranks = sorted(r["rank"] for r in hash_rank(df, ["g"], "k").where(f"g = {g}").collect())
        assert ranks == list(range(len(ranks)))
