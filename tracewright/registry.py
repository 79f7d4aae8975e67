"""All registered queries over the driver's tables, and the DuckDB SQL of each that SQL can say.

The event table stands in for a window log and, by user, for a keyed log; documents and labels for
labelled sessions.  Every query reads its whole tables.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lines as L
from .functions import masking as K
from .operators import dense as D
from .operators import evidence as E
from .operators import explain as X
from .operators import metrics as M
from .operators import scoring as S
from .operators import sequences as Q
from .operators import sessions as W
from .operators import splits as P
from .operators import verify as V
from .plans import explain_all as A
from .sources import logs as O
from .sources.scratch import Work

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
USER = r"user (\d+)"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


# ---------------------------------------------------------------- the tables as logs


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    s = lambda c: c.cast("string")
    tag = F.when((F.col("event_type") == "error") & (F.col("value") > 150), "ERR").otherwise("-")
    host = F.concat(F.lit("10."), s(F.col("user_id") % 256), F.lit(".7."), s(F.col("event_id") % 256), F.lit(":"), s(50010 + F.col("event_id") % 10))
    line = F.concat(tag, F.lit(" "), F.col("event_type"), F.lit(" user "), s(F.col("user_id")), F.lit(" from /"), host, F.lit(" size "), s(F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint")))
    return e.select(F.col("event_id").alias("line_no"), "ts", "user_id", line.alias("line"))


LINES = """lines AS (SELECT event_id AS line_no, ts, user_id, CASE WHEN event_type = 'error' AND value > 150 THEN 'ERR' ELSE '-' END || ' ' || event_type || ' user ' || user_id::VARCHAR
  || ' from /10.' || (user_id % 256)::VARCHAR || '.7.' || (event_id % 256)::VARCHAR || ':' || (50010 + event_id % 10)::VARCHAR || ' size ' || floor(coalesce(value, 0))::BIGINT::VARCHAR AS line FROM events)"""


def windows_sql(size: int, step: int) -> str:
    return f"""{LINES}, total AS (SELECT max(line_no) + 1 AS n FROM lines),
wl AS (SELECT start_idx, line_no, line FROM lines, total, LATERAL (SELECT unnest(range(greatest(0, ((line_no - {size} + {step}) // {step}))::BIGINT, line_no // {step} + 1)) * {step} AS start_idx)
  WHERE line_no - start_idx < {size} AND start_idx < n - {size}),
win AS (SELECT printf('BGL_%08d', start_idx) AS session_id, start_idx, max((line[1] <> '-')::INT) AS label,
  list(substr(line, instr(line, ' ') + 1) ORDER BY line_no) AS ls FROM wl GROUP BY start_idx)"""


def windows(spark: SparkSession, d: str, size: int = 10, step: int = 10) -> DataFrame:
    return W.count_windows(event_lines(spark, d), size, step)


def split_windows(spark: SparkSession, d: str) -> DataFrame:
    return P.stratified_split(windows(spark, d))


SPLIT = """r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || session_id), session_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM win),
spl AS (SELECT * EXCLUDE (rk, n), CASE WHEN rk < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r)"""
SPLIT_WINDOWS = f"{windows_sql(10, 10)}, {SPLIT}"


def document_sessions(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("block_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))


def quality_labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("block_id"), F.when(F.col("quality") == 0, "Anomaly").otherwise("Normal").alias("label"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labels as a classifier's table: quality is the truth, toxic the prediction."""
    m = F.col("doc_id") % 100 / 100.0
    return spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("session_id"), F.col("quality").alias("label"), F.col("toxic").alias("pred"), m.alias("margin"))


PRED = "p AS (SELECT doc_id::VARCHAR AS session_id, quality AS label, toxic AS pred, (doc_id % 100) / 100.0::DOUBLE AS margin FROM labels)"


# ---------------------------------------------------------------- lines


@query("line_fields", rf"""WITH {LINES} SELECT line_no, line[1] <> '-' AS anomalous, substr(line, instr(line, ' ') + 1) AS message,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(line, '[\]\[)(=,;]', ' ', 'g'), ' '),
    lambda w: CASE WHEN upper(w) = w AND lower(w) <> w THEN lower(w) ELSE w END), ' '), '([A-Z]+)', ' \1', 'g'), '([A-Z][a-z]+)', ' \1', 'g'), ' +', ' ', 'g'))) AS cleaned,
  len(string_split(line, ' '))::INT AS n_tokens, len(string_split(line, ' ')) >= 2 AS long_enough FROM lines""")  # fmt: skip
def line_fields(spark, d):
    x = F.col("line")
    return event_lines(spark, d).select("line_no", L.anomalous(x).alias("anomalous"), L.message(x).alias("message"), L.cleaned(x).alias("cleaned"), F.size(L.tokens(x)).alias("n_tokens"), L.long_enough(x).alias("long_enough"))


@query("line_keys", f"""WITH {LINES} SELECT line_no, regexp_extract(line, 'user ([0-9]+)', 1) AS first_key, regexp_extract(line, 'user ([0-9]+)', 1) AS only_key,
  'HDFS_' || user_id::VARCHAR AS session_id, 'E_HDFS_' || user_id::VARCHAR AS evidence_id FROM lines""")  # fmt: skip
def line_keys(spark, d):
    x = F.col("line")
    sid = L.key_id(L.first_key(x, USER))
    return event_lines(spark, d).select("line_no", L.first_key(x, USER).alias("first_key"), L.only_key(x, USER).alias("only_key"), sid.alias("session_id"), L.evidence_id(sid).alias("evidence_id"))


@query("line_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def line_times(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyMMdd HHmmss"), F.lit(" INFO block"))
    return e.select("event_id", F.date_format(L.log_time(line), "yyyy-MM-dd HH:mm:ss").alias("at"))


# ---------------------------------------------------------------- sessions


def _window_rows(size, step, spark, d):
    return windows(spark, d, size, step).select("session_id", "start_idx", "label", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


for _w, _s in ((10, 10), (10, 4), (4, 6)):
    query(f"count_windows_{_w}_{_s}", f"WITH {windows_sql(_w, _s)} SELECT session_id, start_idx, label, len(ls)::INT AS n_lines, array_to_string(ls, chr(10)) AS text FROM win")(partial(_window_rows, _w, _s))


@query("keyed_sessions", f"WITH {LINES} SELECT user_id::VARCHAR AS block_id, count(*)::INT AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY user_id")
def keyed(spark, d):
    return W.keyed_sessions(event_lines(spark, d), L.first_key(F.col("line"), USER)).select("block_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


@query("timed_sessions", f"WITH {LINES} SELECT user_id::VARCHAR AS block_id, count(*)::INT AS n_lines, string_agg(line, chr(10) ORDER BY ts, line_no) AS text FROM lines GROUP BY user_id")
def timed(spark, d):
    return W.keyed_sessions(event_lines(spark, d), L.only_key(F.col("line"), USER), F.col("ts")).select("block_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


_SEG = f"""{LINES}, pl AS (SELECT user_id::VARCHAR AS block_id, line, row_number() OVER (PARTITION BY user_id ORDER BY ts, line_no) - 1 AS place FROM lines),
sg AS (SELECT block_id, place // 16 AS segment, count(*) AS n_lines, max((line[1] <> '-')::INT) AS label, md5(string_agg(line, chr(10) ORDER BY place)) AS digest FROM pl GROUP BY ALL)"""


def user_segments(spark, d) -> DataFrame:
    return W.segments(W.segmented_sessions(event_lines(spark, d), L.first_key(F.col("line"), USER), F.col("ts"), size=16))


@query("session_segments", f"WITH {_SEG} SELECT block_id, segment, n_lines, label, digest FROM sg")
def session_segments(spark, d):
    return user_segments(spark, d).select("block_id", "segment", "n_lines", "label", F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("session_totals", f"""WITH {_SEG}, u1 AS (SELECT block_id, segment // 16 AS i, count(*) AS n_segments, sum(n_lines)::BIGINT AS n_lines, max(label) AS label, CASE WHEN count(*) > 1 THEN md5(string_agg(digest, ',' ORDER BY segment)) ELSE max(digest) END AS digest FROM sg GROUP BY ALL)
SELECT block_id, sum(n_segments)::BIGINT AS n_segments, sum(n_lines)::BIGINT AS n_lines, max(label) AS label, CASE WHEN count(*) > 1 THEN md5(string_agg(digest, ',' ORDER BY i)) ELSE max(digest) END AS digest FROM u1 GROUP BY block_id""")
def totals_of_sessions(spark, d):
    return W.session_totals(user_segments(spark, d), fan=16)


@query("labelled_sessions", """SELECT d.doc_id::VARCHAR AS block_id, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_lines, coalesce(CASE WHEN quality = 0 THEN 1 ELSE 0 END, 0) AS label
  FROM documents d LEFT JOIN labels USING (doc_id)""")  # fmt: skip
def labelled(spark, d):
    return W.with_labels(document_sessions(spark, d), quality_labels(spark, d)).select("block_id", F.size("lines").alias("n_lines"), "label")


@query("shaped_sessions", f"WITH {windows_sql(4, 6)} SELECT session_id, array_to_string(ls || ['', ''], '|') AS padded, array_to_string(ls[1:3], '|') AS cut FROM win")
def shaped(spark, d):
    x = F.col("lines")
    return windows(spark, d, 4, 6).select("session_id", F.array_join(W.shaped(x, 6), "|").alias("padded"), F.array_join(W.shaped(x, 3), "|").alias("cut"))


@query("key_coverage", """SELECT (SELECT count(DISTINCT user_id) FROM events) AS session_keys, (SELECT count(DISTINCT c_custkey) FROM customer) AS label_keys,
  (SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) AS in_both""")  # fmt: skip
def coverage_of_keys(spark, d):
    s = event_lines(spark, d).select(F.col("user_id").cast("string").alias("block_id"))
    return W.key_coverage(s, spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("block_id")))


# ---------------------------------------------------------------- masking


def _mask_sql(source: str, key: str, text: str, rules, m: str = "m", out: str = "masked") -> str:
    """One step for each rule; n<i> counts its matches on the text before it."""
    parts = [f"{m}0 AS (SELECT {key}, {text} AS t FROM {source})"]
    for i, (pattern, to) in enumerate(rules):
        p, t = pattern.replace("'", "''"), to.replace("'", "''")
        parts.append(f"{m}{i + 1} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, '{p}')) AS n{i}, regexp_replace(t, '{p}', '{t}', 'g') AS t FROM {m}{i})")
    keys: dict[str, list[int]] = {}
    for i, (_, to) in enumerate(rules):
        keys.setdefault(K.stat_key(to), []).append(i)
    stat = " || ".join(f"CASE WHEN {'+'.join(f'n{i}' for i in at)} > 0 THEN '{k}=' || ({'+'.join(f'n{i}' for i in at)})::VARCHAR || ' ' ELSE '' END" for k, at in sorted(keys.items()))
    return ", ".join(parts) + f", {out} AS (SELECT {key}, t AS masked, {stat} AS stats FROM {m}{len(rules)})"


def _stats_text(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"), F.lit(" "))), "")


OWN = ((r"user (\d+)", r"user <U\1>"),)


def _masked(dataset, custom, spark, d):
    got = K.mask_columns(event_lines(spark, d), "line", K.rules_for(dataset, custom), "masked", "stats")
    return got.select("line_no", "masked", _stats_text(F.col("stats")).alias("stats"))


for _d, _c in (("generic", ()), ("bgl", ()), ("hdfs", ()), ("custom", OWN)):
    query(f"masked_lines_{_d}", f"WITH {LINES}, {_mask_sql('lines', 'line_no', 'line', K.rules_for(_d, _c))} SELECT line_no, masked, stats FROM masked")(partial(_masked, _d, _c))


@query("masked_sessions", f"""WITH {windows_sql(10, 10)}, wlines AS (SELECT session_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM win), {_mask_sql('wlines', 'session_id, i', 'line', K.rules_for('BGL'))},
g AS (SELECT session_id, string_agg(masked, chr(10) ORDER BY i) AS masked FROM masked GROUP BY session_id)
SELECT session_id, masked, length(array_to_string(ls, chr(10)))::INT AS original_length, length(masked)::INT AS normalized_length,
  round(1 - length(masked) / length(array_to_string(ls, chr(10)))::DOUBLE, 9) AS compression_ratio FROM g JOIN win USING (session_id)""")  # fmt: skip
def masked_sessions(spark, d):
    got = E.masked_sessions(windows(spark, d), "BGL")
    return got.select("session_id", "masked", "original_length", "normalized_length", F.round("compression_ratio", 9).alias("compression_ratio"))


@query("masked_session_stats", f"""WITH {windows_sql(10, 10)}, wlines AS (SELECT session_id, unnest(ls) AS line FROM win), {_mask_sql('wlines', 'session_id', 'line', K.rules_for('HDFS'))},
e AS (SELECT session_id, unnest(string_split(trim(stats), ' ')) AS kv FROM masked WHERE stats <> '')
SELECT session_id, string_split(kv, '=')[1] AS placeholder, sum(string_split(kv, '=')[2]::INT)::INT AS n FROM e GROUP BY ALL""")  # fmt: skip
def masked_session_stats(spark, d):
    got = E.masked_sessions(windows(spark, d), "HDFS", stats=True)
    return got.select("session_id", F.explode("param_stats").alias("placeholder", "n"))


# ---------------------------------------------------------------- splits


@query("stratified_split", f"WITH {SPLIT_WINDOWS} SELECT session_id, label, split FROM spl")
def split(spark, d):
    return split_windows(spark, d).select("session_id", "label", "split")


@query("two_stage_split", f"""WITH {windows_sql(10, 10)}, a AS (SELECT session_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || session_id), session_id) - 1 < floor(count(*) OVER (PARTITION BY label) * 0.7::DOUBLE) AS t FROM win),
b AS (SELECT *, row_number() OVER (PARTITION BY label, t ORDER BY md5('42/2|' || session_id), session_id) - 1 < floor(count(*) OVER (PARTITION BY label, t) * 0.5::DOUBLE) AS v FROM a)
SELECT session_id, label, CASE WHEN t THEN 'train' WHEN v THEN 'val' ELSE 'test' END AS split FROM b""")  # fmt: skip
def two_stage(spark, d):
    return P.two_stage_split(windows(spark, d)).select("session_id", "label", "split")


@query("oversampled_train", f"""WITH {SPLIT_WINDOWS}, tr AS (SELECT * FROM spl WHERE split = 'train'), c AS (SELECT count(*) AS n, count_if(label = 1) AS k FROM tr),
mn AS (SELECT session_id, row_number() OVER (ORDER BY md5('42|' || session_id), session_id) - 1 AS rk FROM tr WHERE label = 1),
dr AS (SELECT i AS draw, ('0x' || substr(md5('42|' || i::VARCHAR), 1, 8))::BIGINT % k AS rk FROM c, LATERAL (SELECT unnest(range(greatest(0, floor(0.4::DOUBLE * (1 - k / n::DOUBLE) / (1 - 0.4::DOUBLE) * n)::BIGINT - k)::BIGINT)) AS i))
SELECT session_id, label, NULL::BIGINT AS draw FROM tr UNION ALL SELECT session_id, 1, draw FROM dr JOIN mn USING (rk)""")  # fmt: skip
def oversample(spark, d):
    return P.oversampled(P.in_split(split_windows(spark, d), "train")).select("session_id", "label", "draw")


@query("shuffled_sessions", f"WITH {windows_sql(10, 10)} SELECT session_id, label FROM win ORDER BY md5('7|' || session_id), session_id")
def shuffle(spark, d):
    return P.shuffled(windows(spark, d), 7).select("session_id", "label")


@query("first_sessions", f"WITH {SPLIT_WINDOWS} SELECT session_id, split FROM spl ORDER BY list_position(['train', 'val', 'test'], split), session_id LIMIT 100")
def first_sessions(spark, d):
    return P.head(split_windows(spark, d), 100).select("session_id", "split")


@query("first_sessions_by_label", f"WITH {windows_sql(10, 10)} SELECT session_id, label FROM win QUALIFY row_number() OVER (PARTITION BY label ORDER BY session_id) <= 5")
def first_by_label(spark, d):
    return P.head_by_label(windows(spark, d), 5).select("session_id", "label")


# ---------------------------------------------------------------- sequences

_TOK = "list_filter(regexp_split_to_array(lower(l), '\\s+'), lambda t: t <> '')"
TOKENIZED = f"""tok AS (SELECT session_id, label, list_transform(ls, lambda l: list_transform({_TOK}, lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % 1000 + 3)::INT) || [2]) AS per FROM win),
seq AS (SELECT session_id, label, [1] || flatten(per) AS ids, [0] || flatten(list_transform(range(1, len(per) + 1), lambda i: list_transform(per[i], lambda x: (i - 1)::INT))) AS seg FROM tok)"""


@query("token_ids", f"WITH {windows_sql(10, 10)}, {TOKENIZED} SELECT session_id, label AS session_label, array_to_string(ids[1:60], ',') AS ids, array_to_string(seg[1:60], ',') AS segments FROM seq")
def token_ids(spark, d):
    t = Q.model_inputs(Q.with_ids(windows(spark, d), 1000, 60).withColumn("label", F.struct("session_id", "label")))
    join = lambda c: F.array_join(c, ",")
    return t.select("session_label.session_id", F.col("session_label.label").alias("session_label"), join("input_ids").alias("ids"), join("segment_ids").alias("segments"))


@query("padded_ids", f"""WITH {windows_sql(10, 10)}, {TOKENIZED}, pad AS (SELECT session_id, (ids || list_transform(range(greatest(0, 90 - len(ids))), lambda x: 0))[1:90] AS p, seg FROM seq)
SELECT session_id, array_to_string(p, ',') AS padded, list_sum(list_transform(p, lambda x: (x <> 0)::INT))::BIGINT AS used, array_to_string(list_transform(seg, lambda x: least(x, 4)), ',') AS clamped FROM pad""")  # fmt: skip
def padded_ids(spark, d):
    t = Q.with_ids(windows(spark, d), 1000).withColumn("p", Q.padded(F.col("input_ids"), 90))
    used = F.aggregate(Q.mask_of(F.col("p")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select("session_id", F.array_join("p", ",").alias("padded"), used.alias("used"), F.array_join(Q.clamped(F.col("segment_ids"), 5), ",").alias("clamped"))


@query("length_profile", f"""WITH {windows_sql(10, 10)}, {TOKENIZED} SELECT floor(quantile_cont(len(ids)::DOUBLE, 0.9))::INT AS p90, floor(quantile_cont(len(ids)::DOUBLE, 0.95))::INT AS p95, max(len(ids))::INT AS max_len,
  round(avg(len(ids)), 6) AS mean_len, max(list_max(seg) + 1)::INT AS max_segments FROM seq""")  # fmt: skip
def length_profile(spark, d):
    t = Q.with_ids(windows(spark, d), 1000)
    return Q.length_profile(t).withColumn("mean_len", F.round("mean_len", 6)).crossJoin(Q.max_segments(t))


@query("length_batches", f"""WITH {windows_sql(10, 10)}, {TOKENIZED}, k AS (SELECT session_id, len(ids) AS n, greatest(ceil(len(ids) / 8.0), 1)::INT AS k FROM seq),
r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY md5('42|' || session_id), session_id) - 1) // greatest(2048 // (k * 8), 1) AS b FROM k)
SELECT session_id, k::VARCHAR || '_' || b::VARCHAR AS batch, max(n) OVER (PARTITION BY k, b)::INT AS width, (max(n) OVER (PARTITION BY k, b) - n)::INT AS padding FROM r""")
def length_batches(spark, d):
    t = Q.length_batches(Q.with_ids(windows(spark, d), 1000), budget=2048, step=8)
    return t.select("session_id", "batch", "width", (F.size("padded_ids") - F.size("input_ids")).alias("padding"))


@query("vocabulary", f"WITH {windows_sql(10, 10)}, t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(array_to_string(ls, ' ')), '\\s+'), lambda t: t <> '')) AS term FROM win), c AS (SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 500) SELECT term, (row_number() OVER (ORDER BY n DESC, term) + 2)::INT AS id FROM c")
def vocabulary(spark, d):
    return Q.vocabulary(windows(spark, d), 500)


# ---------------------------------------------------------------- scores


def scored_windows(spark, d):
    i = F.col("start_idx")
    logits = F.array((i % 7).cast("double"), (i % 11 / 2.0).cast("double"))
    return S.score_columns(windows(spark, d).select("session_id", "start_idx", "label", logits.alias("logits")))


SCORED = """lg AS (SELECT session_id, start_idx, label, (start_idx % 7)::DOUBLE AS a, (start_idx % 11) / 2.0::DOUBLE AS b FROM win),
sc AS (SELECT session_id, start_idx, label, (b > a)::INT AS pred, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p0, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p1 FROM lg)"""


@query("score_columns", f"WITH {windows_sql(10, 10)}, {SCORED} SELECT session_id, pred, round(abs(p1 - p0), 9) AS margin, round(CASE WHEN pred = 1 THEN p1 ELSE p0 END, 9) AS confidence, round(p1, 9) AS anomaly_prob, pred = 1 AS is_anomaly FROM sc")
def score_columns(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return scored_windows(spark, d).select("session_id", "pred", r("margin"), r("confidence"), r("anomaly_prob"), "is_anomaly")


@query("anomalies", f"WITH {windows_sql(10, 10)}, {SCORED} SELECT session_id, len(ls)::INT AS n_lines FROM win JOIN sc USING (session_id) WHERE pred = 1")
def anomalies(spark, d):
    return S.anomalies(windows(spark, d).select("session_id", "lines"), scored_windows(spark, d).select("session_id", "pred")).select("session_id", F.size("lines").alias("n_lines"))


@query("gated_anomalies", f"WITH {windows_sql(10, 10)}, {SCORED}, an AS (SELECT session_id, round(abs(p1 - p0), 9) AS margin FROM sc WHERE pred = 1) SELECT session_id, margin FROM an QUALIFY row_number() OVER (ORDER BY margin, session_id) <= ceil(0.2 * (SELECT count(*) FROM an))")
def gated_anomalies(spark, d):
    return S.gated(scored_windows(spark, d).withColumn("margin", F.round("margin", 9))).select("session_id", "margin")


@query("classified_sessions")
def classified(spark, d):
    train, val, test = labelled_parts(spark, d)
    m = S.fit_classifier(train, val)
    return S.score_sessions(m, test).select("session_id", "label", "pred", "margin", "confidence")


# ---------------------------------------------------------------- evidence and retrieval

EVIDENCE = f"""{SPLIT_WINDOWS}, tl AS (SELECT session_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM spl WHERE split = 'train'), {_mask_sql('tl', 'session_id, i', 'line', K.rules_for('BGL'))},
ev AS (SELECT 'E_' || session_id AS evidence_id, session_id, row_number() OVER (ORDER BY md5('corpus|' || session_id), session_id) - 1 AS doc_idx, text, label, len(ls)::INT AS num_lines,
  length(array_to_string(ls, chr(10)))::INT AS original_length, length(text)::INT AS normalized_length
  FROM (SELECT session_id, string_agg(masked, chr(10) ORDER BY i) AS text FROM masked GROUP BY session_id) JOIN spl USING (session_id))"""
_RT = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda t: t <> '')"


def bm25_sql(docs: str) -> str:
    return f"""tk AS MATERIALIZED (SELECT evidence_id, {_RT.format('text')} AS t FROM {docs}), dt AS (SELECT evidence_id, unnest(t) AS term, len(t) AS dl FROM tk),
tf AS MATERIALIZED (SELECT evidence_id, term, dl, count(*) AS tf FROM dt GROUP BY ALL), cn AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), rw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, cn),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw),
post AS (SELECT evidence_id, term, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM tf JOIN idf USING (term), cn)"""


def top_sql(docs: str, queries: str, k: int, exclude: bool) -> str:
    """All documents for each query, scored or 0, ranked."""
    drop = "AND session_id <> query_id" if exclude else ""
    return f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_RT.format('query')}) AS term FROM {queries}) GROUP BY ALL),
scr AS (SELECT query_id, evidence_id, round(sum(qtf * w), 6) AS score FROM qt JOIN post USING (term) GROUP BY ALL),
al AS (SELECT q.query_id, e.*, coalesce(score, 0) AS score FROM {queries} q CROSS JOIN {docs} e LEFT JOIN scr s ON s.query_id = q.query_id AND s.evidence_id = e.evidence_id),
top AS (SELECT query_id, evidence_id, session_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx)::INT AS rank FROM al WHERE score >= 0 {drop} QUALIFY rank <= {k})"""


def evidence_of(spark, d):
    return E.build_evidence(split_windows(spark, d), "BGL")


@query("evidence", f"WITH {EVIDENCE} SELECT evidence_id, doc_idx, text, label, num_lines, original_length, normalized_length FROM ev")
def evidence(spark, d):
    return evidence_of(spark, d).select("evidence_id", "doc_idx", "text", "label", "num_lines", "original_length", "normalized_length")


@query("evidence_lookup", f"WITH {EVIDENCE} SELECT evidence_id, doc_idx FROM ev WHERE label = 1")
def evidence_lookup(spark, d):
    return E.lookup(evidence_of(spark, d), label=1).select("evidence_id", "doc_idx")


@query("corpus_stats", f"WITH {EVIDENCE} SELECT count(*) AS total, count_if(label = 0) AS normal, count_if(label = 1) AS anomaly, round(avg(normalized_length), 6) AS avg_length, min(normalized_length) AS min_length, max(normalized_length) AS max_length FROM ev")
def corpus_stats(spark, d):
    return M.corpus_stats(evidence_of(spark, d)).withColumn("avg_length", F.round("avg_length", 6))


def document_evidence(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sid = F.col("doc_id").cast("string")
    return docs.select(L.evidence_id(sid).alias("evidence_id"), sid.alias("session_id"), F.col("doc_id").alias("doc_idx"), F.coalesce("text", F.lit("")).alias("text"), (F.col("lang") == "en").cast("int").alias("label"))


DOC_EV = "dev AS (SELECT 'E_' || doc_id::VARCHAR AS evidence_id, doc_id::VARCHAR AS session_id, doc_id AS doc_idx, coalesce(text, '') AS text, (lang = 'en')::INT AS label FROM documents)"
BENCH_Q = "bq AS (SELECT 'B' || item_id::VARCHAR AS query_id, text AS query FROM benchmark)"


def benchmark_queries(spark, d) -> DataFrame:
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("array<string>").alias("exclude"))


def benchmark_hits(spark, d, k=5):
    ev = document_evidence(spark, d)
    return E.retrieve(benchmark_queries(spark, d), ev, E.bm25_index(ev), k, digits=6)


#: Each distinct text is cut once; a term counts as often as its texts do.
@query("bm25_terms", r"""WITH dis AS (SELECT lower(coalesce(text, '')) AS t, count(*) AS copies FROM documents GROUP BY ALL), u AS (SELECT copies, unnest(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS term FROM dis),
dfs AS (SELECT term, sum(copies)::BIGINT AS df FROM u GROUP BY term), c AS (SELECT count(*) AS n FROM documents), rw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, c), m AS (SELECT 0.25::DOUBLE * avg(raw) AS low FROM rw)
SELECT term, df, round(CASE WHEN raw < 0 THEN low ELSE raw END, 6) AS idf FROM rw, m""")
def bm25_terms(spark, d):
    return E.bm25_index(document_evidence(spark, d))["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_top", f"WITH {DOC_EV}, {BENCH_Q}, {bm25_sql('dev')}, {top_sql('dev', 'bq', 5, False)} SELECT query_id, rank, evidence_id, score FROM top")
def bm25_top(spark, d):
    return benchmark_hits(spark, d).select("query_id", "rank", "evidence_id", "score")


def chat_sessions(spark, d) -> DataFrame:
    """Conversations as split sessions; every third one counts as anomalous."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select("turn", F.coalesce("text", F.lit("")).alias("line"), "conv_id")
    s = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("t"))
    # ids are split, and lines are shuffled only once, to their conversation
    ids = c.select("conv_id").distinct().select("conv_id", F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("conv_id") % 3 == 0).cast("int").alias("label"))
    return s.join(P.stratified_split(ids), "conv_id").select("session_id", F.transform("t", lambda x: x["line"]).alias("lines"), "label", "split")


CHAT = f"win AS (SELECT 'C' || conv_id::VARCHAR AS session_id, (conv_id % 3 = 0)::INT AS label, list(coalesce(text, '') ORDER BY turn, coalesce(text, '')) AS ls FROM conversations GROUP BY conv_id), {SPLIT}"


def session_hits(spark, d, k=5):
    work = Work(spark, "chats")
    s = work.table(chat_sessions(spark, d), "sessions")
    ev = work.table(E.build_evidence(s, "BGL"), "evidence")
    q = P.in_split(s, "val").select(F.col("session_id").alias("query_id"), E.query_text(F.col("lines"), "BGL").alias("query"), F.array("session_id").alias("exclude"), "label")
    return q, E.retrieve(q, ev, E.bm25_index(ev), k, digits=6)


SESSION_TOP = f"""{EVIDENCE.replace(SPLIT_WINDOWS, CHAT)}, qs AS (SELECT session_id, array_to_string(ls, chr(10)) AS line, label AS qlabel FROM spl WHERE split = 'val'),
{_mask_sql('qs', 'session_id', 'line', K.rules_for('BGL'), 'qm', 'qmasked')},
wq AS (SELECT session_id AS query_id, masked AS query, qlabel FROM qmasked JOIN qs USING (session_id)), {bm25_sql('ev')}, {top_sql('ev', 'wq', 5, True)}"""


@query("session_retrieval", f"WITH {SESSION_TOP} SELECT query_id, rank, evidence_id, score FROM top")
def session_retrieval(spark, d):
    return session_hits(spark, d)[1].select("query_id", "rank", "evidence_id", "score")


@query("retrieval_quality", f"""WITH {SESSION_TOP}, e AS (SELECT query_id, count(label) AS n, count_if(label = qlabel) AS same, coalesce(max(label), 0) AS an FROM wq LEFT JOIN top USING (query_id) GROUP BY query_id)
SELECT round(avg(CASE WHEN n > 0 THEN same / n::DOUBLE ELSE 0 END), 9) AS mean_same_label, round(stddev_pop(CASE WHEN n > 0 THEN same / n::DOUBLE ELSE 0 END), 9) AS std_same_label, round(avg(an), 9) AS any_anomaly_rate FROM e""")  # fmt: skip
def retrieval_quality(spark, d):
    q, hits = session_hits(spark, d)
    m = M.retrieval_quality(q.select("query_id", "label"), hits)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("same_label_histogram", f"WITH {SESSION_TOP}, e AS (SELECT query_id, count_if(label = qlabel) AS n_same FROM wq LEFT JOIN top USING (query_id) GROUP BY query_id) SELECT n_same, count(*) AS queries FROM e GROUP BY n_same")
def same_label_histogram(spark, d):
    q, hits = session_hits(spark, d)
    return M.same_label_histogram(q.select("query_id", "label"), hits)


# ---------------------------------------------------------------- explanations


def answers(spark, d) -> DataFrame:
    """An answer of each kind for each window: fenced, wrapped in prose, incomplete, no JSON."""
    w = windows(spark, d).select("session_id", "start_idx", "label")
    k = F.col("start_idx") / 10 % 4
    body = F.concat(F.lit('{"prediction": "anomaly", "summary": "Session '), F.col("session_id"), F.lit(' failed", "claims": [{"claim": "Repeated error events by one user", "evidence_ids": ["E1", "E'), (F.col("start_idx") % 7).cast("string"), F.lit('"]}, {"claim": "short", "evidence_ids": []}], "insufficient_evidence": false}'))
    fence = F.lit("`" * 3)
    text = F.when(k == 0, F.concat(fence, F.lit("json\n"), body, F.lit("\n"), fence)).when(k == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(k == 2, F.lit('{"summary": "nothing found"}')).otherwise("no answer")
    model = F.when(F.col("start_idx") % 3 == 0, "gpt-4o-mini").when(F.col("start_idx") % 3 == 1, "gpt-4-turbo").otherwise("llama3.2")
    i = F.col("start_idx")
    return w.select("session_id", "start_idx", "label", text.alias("content"), model.alias("model"), (i % 1000).alias("prompt_tokens"), (i % 300).alias("completion_tokens"), F.when(i % 2 == 0, i % 1000 + i % 300).alias("total_tokens"), (i % 97).cast("double").alias("latency_ms"))


ANSWERS = """body AS (SELECT session_id, start_idx, label, '{"prediction": "anomaly", "summary": "Session ' || session_id || ' failed", "claims": [{"claim": "Repeated error events by one user", "evidence_ids": ["E1", "E' || (start_idx % 7)::VARCHAR || '"]}, {"claim": "short", "evidence_ids": []}], "insufficient_evidence": false}' AS b FROM win),
ans AS (SELECT session_id, start_idx, label, CASE (start_idx // 10) % 4 WHEN 0 THEN '```json' || chr(10) || b || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || b || ' Done.' WHEN 2 THEN '{"summary": "nothing found"}' ELSE 'no answer' END AS content,
  CASE start_idx % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4-turbo' ELSE 'llama3.2' END AS model, start_idx % 1000 AS pt, start_idx % 300 AS ct, CASE WHEN start_idx % 2 = 0 THEN start_idx % 1000 + start_idx % 300 END AS tt FROM body),
js AS (SELECT *, regexp_extract(content, '(?s)(\\{.*\\})', 1) AS j FROM ans),
px AS (SELECT *, j = '' AS bad FROM js),
pa AS (SELECT *, CASE WHEN bad THEN NULL ELSE j::JSON END AS x FROM px),
pr AS (SELECT session_id, start_idx, bad, coalesce(x->>'$.prediction', 'anomaly') AS prediction, CASE WHEN bad THEN 'JSON parse error: ' || content[1:100] ELSE coalesce(x->>'$.summary', '') END AS summary,
  coalesce(json_array_length(x->'$.claims'), 0)::INT AS n_claims, CASE WHEN bad THEN true ELSE coalesce((x->>'$.insufficient_evidence')::BOOLEAN, false) END AS insufficient,
  CASE WHEN json_array_length(x->'$.claims') > 0 THEN list_distinct(['E1', x->>'$.claims[0].evidence_ids[1]']) ELSE [] END AS ids FROM pa)"""


@query("parsed_answers", f"""WITH {windows_sql(10, 10)}, {ANSWERS} SELECT session_id, bad AS parse_failed, prediction, summary, n_claims, insufficient, array_to_string(list_sort(ids), ',') AS cited,
  CASE WHEN n_claims > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS coverage FROM pr""")  # fmt: skip
def parsed_answers(spark, d):
    p = X.parsed(answers(spark, d))
    x = F.col("explanation")
    return p.select("session_id", "parse_failed", x["prediction"].alias("prediction"), x["summary"].alias("summary"), F.size(x["claims"]).alias("n_claims"), x["insufficient_evidence"].alias("insufficient"), F.array_join(F.array_sort(X.cited_ids(x)), ",").alias("cited"), X.coverage(x).alias("coverage"))


@query("answer_costs", f"""WITH {windows_sql(10, 10)}, {ANSWERS} SELECT session_id, coalesce(tt, pt + ct) AS tokens,
  round(CASE model WHEN 'gpt-4o-mini' THEN pt / 1e6 * 2.5 + ct / 1e6 * 10 WHEN 'gpt-4-turbo' THEN pt / 1e6 * 10 + ct / 1e6 * 30 ELSE 0 END, 9)::DOUBLE AS cost_usd FROM ans""")  # fmt: skip
def answer_costs(spark, d):
    c = X.costs(answers(spark, d))
    return c.select("session_id", X.token_total(F.col("total_tokens"), F.col("prompt_tokens"), F.col("completion_tokens")).alias("tokens"), F.round("cost_usd", 9).alias("cost_usd"))


def _records(spark, d):
    """Answers with three made-up hits each: the first says error, the others do not."""
    hit = lambda i, t: F.struct(F.lit(1.0 / i).alias("score"), F.concat(F.lit(f"E_{i}_"), F.col("session_id")).alias("evidence_id"), F.lit(t).alias("text"))
    hits = F.array(hit(1, "an error event"), hit(2, "all quiet here"), hit(3, "nothing to see"))
    r = X.parsed(answers(spark, d)).withColumn("hits", hits)
    return r.withColumn("id_mapping", X.id_mapping(F.col("hits")))


VERIFY = """vf AS (SELECT session_id, bad, n_claims, start_idx % 7 AS e, summary = '' OR n_claims = 0 AS f1, n_claims > 0 AND start_idx % 7 NOT IN (1, 2, 3) AS f2, n_claims = 0 AS w2, 2 AS dummy,
  CASE WHEN n_claims > 0 THEN (1 + (start_idx % 7 = 1)::INT) / 2.0 END AS ov FROM pr)"""


@query("verified_answers", f"""WITH {windows_sql(10, 10)}, {ANSWERS}, {VERIFY} SELECT session_id, 5 AS total_checks, (f1::INT + f2::INT + 1) AS failed_checks, (w2::INT + (n_claims > 0)::INT) AS warnings,
  5 - (f1::INT + f2::INT + 1) - (w2::INT + (n_claims > 0)::INT) AS passed_checks, false AS verified FROM vf""")  # fmt: skip
def verified_answers(spark, d):
    return V.verify(_records(spark, d)).select("session_id", "total_checks", "failed_checks", "warnings", "passed_checks", "verified")


@query("issue_counts", f"""WITH {windows_sql(10, 10)}, {ANSWERS}, {VERIFY}, i AS (SELECT 'structure' AS "check", CASE WHEN f1 THEN 'fail' ELSE 'pass' END AS s FROM vf UNION ALL SELECT 'evidence_ids', CASE WHEN f2 THEN 'fail' WHEN w2 THEN 'warning' ELSE 'pass' END FROM vf
  UNION ALL SELECT 'coverage', 'fail' FROM vf UNION ALL SELECT 'keyword_match', 'pass' FROM vf UNION ALL SELECT 'empty_claims', CASE WHEN n_claims > 0 THEN 'warning' ELSE 'pass' END FROM vf)
SELECT "check", count_if(s = 'pass') AS pass, count_if(s = 'fail') AS fail, count_if(s = 'warning') AS warning FROM i GROUP BY 1""")  # fmt: skip
def issue_counts(spark, d):
    return V.issue_counts(V.verify(_records(spark, d)))


@query("verification_summary", f"WITH {windows_sql(10, 10)} SELECT count(*) AS total, 0::BIGINT AS passed, 0.0::DOUBLE AS pass_rate FROM win")
def verification_summary(spark, d):
    return V.summary(V.verify(_records(spark, d)))


@query("prompts", f"""WITH {windows_sql(10, 10)} SELECT session_id, 'E1=E_1_' || session_id || ',E2=E_2_' || session_id || ',E3=E_3_' || session_id AS mapping,
  '[E1] (score: 1.00)' || chr(10) || 'Original ID: E_1_' || session_id || chr(10) || 'an er...' || chr(10) || chr(10) || '[E2] (score: 0.50)' || chr(10) || 'Original ID: E_2_' || session_id || chr(10) || 'all q...' || chr(10) || chr(10)
  || '[E3] (score: 0.33)' || chr(10) || 'Original ID: E_3_' || session_id || chr(10) || 'nothi...' || chr(10) AS evidence, array_to_string(ls[1:4], chr(10)) || chr(10) || '... (6 more lines)' AS log FROM win""")  # fmt: skip
def prompt_parts(spark, d):
    r = _records(spark, d).select("session_id", "hits", "id_mapping").join(windows(spark, d).select("session_id", "lines"), "session_id")
    m = F.array_join(F.transform(F.array_sort(F.map_entries("id_mapping")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return r.select("session_id", m.alias("mapping"), X.evidence_block(F.col("hits"), 5).alias("evidence"), X.log_block(F.col("lines"), 4).alias("log"))


# ---------------------------------------------------------------- reports


@query("dataset_stats", f"""WITH {SPLIT_WINDOWS} SELECT s AS split, count(session_id) AS total, count_if(label = 0) AS normal, count_if(label = 1) AS anomaly, round(coalesce(count_if(label = 1) / nullif(count(session_id), 0)::DOUBLE, 0), 9) AS anomaly_ratio,
  coalesce(avg(len(ls)), 0)::DOUBLE AS avg_lines FROM (SELECT unnest(['train', 'val', 'test']) AS s) LEFT JOIN spl ON split = s GROUP BY s""")  # fmt: skip
def dataset_stats(spark, d):
    return M.dataset_stats(split_windows(spark, d)).withColumn("anomaly_ratio", F.round("anomaly_ratio", 9))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return dataset_stats(spark, d)


@query("class_balance", f"""WITH {SPLIT_WINDOWS}, tr AS (SELECT label FROM spl WHERE split = 'train'), c AS (SELECT count(*) AS n, count_if(label = 1) AS k FROM tr), g AS (SELECT n, k, greatest(0, floor(0.4::DOUBLE * (1 - k / n::DOUBLE) / (1 - 0.4::DOUBLE) * n)::BIGINT - k) AS more FROM c)
SELECT 'before' AS stage, 'train' AS split, n AS total, k AS anomaly, round(k / n::DOUBLE, 9) AS ratio FROM g UNION ALL SELECT 'after', 'train', n + more, k + more, round((k + more) / (n + more)::DOUBLE, 9) FROM g""")  # fmt: skip
def class_balance(spark, d):
    t = P.in_split(split_windows(spark, d), "train")
    return M.class_balance({"before": t, "after": P.oversampled(t)}).withColumn("ratio", F.round("ratio", 9))


_CONF = "c AS (SELECT count_if(label = 0 AND pred = 0) AS tn, count_if(label = 0 AND pred = 1) AS fp, count_if(label = 1 AND pred = 0) AS fn, count_if(label = 1 AND pred = 1) AS tp FROM p)"
_R = "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS rc"


@query("screener_metrics", f"""WITH {PRED}, {_CONF}, r AS ({_R} FROM c) SELECT tn, fp, fn, tp, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9) AS f1, round((tn + tp) / (tn + fp + fn + tp)::DOUBLE, 9) AS accuracy FROM r""")
def screener_metrics(spark, d):
    m = M.screener_metrics(predictions(spark, d))
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in m.dtypes])


@query("confusion_table", f"WITH {PRED} SELECT label, count_if(pred = 0) AS pred_0, count_if(pred = 1) AS pred_1 FROM p GROUP BY label")
def confusion_table(spark, d):
    return M.confusion_table(predictions(spark, d))


@query("classification_report", f"""WITH {PRED}, {_CONF}, s AS (SELECT 'Normal' AS name, tn AS tp, fn AS fp, fp AS fn FROM c UNION ALL SELECT 'Anomalous', tp, fp, fn FROM c), q AS ({_R} FROM s), e AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f, tp + fn AS n FROM q),
o AS (SELECT name, pr, rc, f, n FROM e UNION ALL SELECT 'accuracy', sum(tp) / sum(n)::DOUBLE, sum(tp) / sum(n)::DOUBLE, sum(tp) / sum(n)::DOUBLE, sum(n)::BIGINT FROM e UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f), sum(n)::BIGINT FROM e
UNION ALL SELECT 'weighted avg', sum(pr * n) / sum(n), sum(rc * n) / sum(n), sum(f * n) / sum(n), sum(n)::BIGINT FROM e) SELECT name, printf('%.5f', pr) AS precision, printf('%.5f', rc) AS recall, printf('%.5f', f) AS f1, n AS support FROM o""")  # fmt: skip
def report(spark, d):
    return M.classification_report(predictions(spark, d))


@query("margin_stats", f"WITH {PRED} SELECT round(avg(margin), 9) AS mean, round(stddev_pop(margin), 9) AS std, min(margin) AS min, max(margin) AS max FROM p")
def margin_stats(spark, d):
    m = M.margin_stats(predictions(spark, d))
    return m.select(F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "min", "max")


@query("prediction_check", f"WITH {PRED} SELECT session_id, CASE label WHEN 1 THEN 'Anomalous' ELSE 'Normal' END AS actual, CASE pred WHEN 1 THEN 'Anomalous' ELSE 'Normal' END AS predicted, label = pred AS match FROM p")
def prediction_check(spark, d):
    return M.prediction_check(predictions(spark, d))


@query("run_metrics", f"""WITH {windows_sql(10, 10)}, o AS (SELECT label = 1 AS a, CASE WHEN label = 1 AND start_idx % 3 > 0 THEN true END AS x, start_idx % 2 = 0 AS v, start_idx % 500 AS t, (start_idx % 97)::DOUBLE AS l FROM win)
SELECT count(*) AS sessions, count_if(a) AS anomalies, count_if(x) AS explained, count_if(a) - count_if(x) AS failed, round(count_if(a) / count(*)::DOUBLE, 9) AS trigger_rate, round(coalesce(count_if(x) / nullif(count_if(a), 0)::DOUBLE, 0), 9) AS success_rate,
  round(coalesce(count_if(x AND v) / nullif(count_if(x), 0)::DOUBLE, 0), 9) AS verification_rate, coalesce(sum(t) FILTER (WHERE x), 0)::BIGINT AS tokens, round(coalesce(avg(t) FILTER (WHERE x), 0)::DOUBLE, 9) AS avg_tokens,
  round(coalesce(avg(l) FILTER (WHERE x), 0), 9) AS mean_latency, round(coalesce(quantile_cont(l, 0.95) FILTER (WHERE x), 0), 9) AS p95_latency FROM o""")  # fmt: skip
def run_metrics(spark, d):
    i, a = F.col("start_idx"), F.col("label") == 1
    x = F.when(a & (i % 3 > 0), True)
    o = windows(spark, d).select(a.alias("is_anomaly"), x.alias("explained"), F.when(x, i % 2 == 0).alias("verified"), (i % 500).alias("total_tokens"), (i % 97).cast("double").alias("latency_ms"))
    m = M.run_metrics(o)
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in m.dtypes])


@query("session_inspection", f"WITH {windows_sql(10, 10)} SELECT session_id, label, len(ls)::INT AS n_lines, lower(array_to_string(ls, ' ')) AS decoded FROM win ORDER BY session_id LIMIT 5")
def session_inspection(spark, d):
    return W.inspection(windows(spark, d))


@query("explain_all_run", f"""WITH {SPLIT_WINDOWS}, {SCORED}, {ANSWERS}, o AS (SELECT sc.pred = 1 AS a, CASE WHEN sc.pred = 1 AND sc.start_idx % 13 <> 0 THEN true END AS x,
  CASE WHEN pr.bad THEN 0 ELSE coalesce(tt, pt + ct) END AS t, CASE WHEN pr.bad THEN 0 ELSE sc.start_idx % 97 END::DOUBLE AS l, false AS v  -- no answer of these covers 0.8 of its claims
  FROM sc JOIN spl ON spl.session_id = sc.session_id AND split = 'test' JOIN pr ON pr.session_id = sc.session_id JOIN ans ON ans.session_id = sc.session_id)
SELECT count(*) AS sessions, count_if(a) AS anomalies, count_if(x) AS explained, count_if(a) - count_if(x) AS failed, round(count_if(a) / count(*)::DOUBLE, 9) AS trigger_rate, round(coalesce(count_if(x) / nullif(count_if(a), 0)::DOUBLE, 0), 9) AS success_rate,
  round(coalesce(count_if(x AND v) / nullif(count_if(x), 0)::DOUBLE, 0), 9) AS verification_rate, coalesce(sum(t) FILTER (WHERE x), 0)::BIGINT AS tokens, round(coalesce(sum(t) FILTER (WHERE x) / nullif(count_if(x), 0)::DOUBLE, 0), 9) AS avg_tokens,
  round(coalesce(avg(l) FILTER (WHERE x), 0), 9) AS mean_latency, round(coalesce(quantile_cont(l, 0.95) FILTER (WHERE x), 0), 9) AS p95_latency FROM o""")
def explain_all_run(spark, d):
    """Both phases over the whole log; the answers are those of ``answers``."""
    s = Work(spark, "windows").table(split_windows(spark, d), "sessions")
    scores = scored_windows(spark, d)
    test = P.in_split(s, "test").select("session_id")
    scores = scores.join(test, "session_id", "left_semi")
    prepared = A.prepare_prompts(s, scores, "BGL")
    given = answers(spark, d).withColumn("error", F.when(F.col("start_idx") % 13 == 0, "timeout"))
    m = A.run_report(scores, A.finish_explanations(prepared, given))
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in m.dtypes])


# ---------------------------------------------------------------- sources and sinks


def _path(spark, name: str) -> str:
    """A place in the shared folder for what a query writes and reads again."""
    return Work(spark, name).root


@query("log_files", f"WITH {LINES} SELECT user_id % 4 AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY line_no) - 1 AS line_no, line FROM lines")
def log_files(spark, d):
    """The log as four text files, read with the lines' places in their files."""
    path = _path(spark, "log")
    rows = event_lines(spark, d).withColumn("part", F.col("user_id") % 4)
    rows.repartition(4, "part").sortWithinPartitions("part", "line_no").select("part", F.concat(F.lit("  "), "line", F.lit("\t ")).alias("line")).write.partitionBy("part").text(path)
    got = O.read_lines(spark, f"{path}/part=*")
    return got.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"), "line_no", "line")


@query("label_file", "SELECT doc_id::VARCHAR AS block_id, CASE WHEN quality = 0 THEN 'Anomaly' ELSE 'Normal' END AS label FROM labels")
def label_file(spark, d):
    path = _path(spark, "labels")
    quality_labels(spark, d).select(F.col("block_id").alias("BlockId"), F.col("label").alias("Label")).write.csv(path, header=True)
    return O.read_labels(spark, path)


@query("built_once", f"WITH {EVIDENCE} SELECT evidence_id, doc_idx, text, label, num_lines, 1 AS builds FROM ev")
def built_once(spark, d):
    """The evidence, built and written at the first call, read at the second."""
    path, calls = _path(spark, "evidence"), []
    for _ in range(2):
        got = O.load_or_build(spark, path, lambda: calls.append(1) or evidence_of(spark, d))
    return got.select("evidence_id", "doc_idx", "text", "label", "num_lines", F.lit(len(calls)).alias("builds"))


@query("stored_index", ORACLES["bm25_top"])
def stored_index(spark, d):
    path, ev = _path(spark, "index"), document_evidence(spark, d)
    O.save_index(E.bm25_index(ev), path)
    return E.retrieve(benchmark_queries(spark, d), ev, O.load_index(spark, path), digits=6).select("query_id", "rank", "evidence_id", "score")


@query("saved_records", f"""WITH {windows_sql(10, 10)}, {ANSWERS} SELECT session_id, label, 'E_1_' || session_id AS first_evidence, prediction, n_claims FROM pr JOIN (SELECT session_id, label FROM win) USING (session_id)""")
def saved_records(spark, d):
    """Result records as JSON lines, read again."""
    path = _path(spark, "records")
    O.save_records(explained_records(spark, d), path)
    got = spark.read.schema("session_id string, label int, evidence_ids array<string>, explanation struct<prediction string, claims array<struct<claim string>>>, created_at string").json(path)
    ok = got.where("created_at IS NOT NULL")
    return ok.select("session_id", "label", F.get("evidence_ids", F.lit(0)).alias("first_evidence"), F.col("explanation.prediction").alias("prediction"), F.size("explanation.claims").alias("n_claims"))


@query("appended_metrics", ORACLES["run_metrics"].replace("SELECT count(*) AS sessions", "SELECT unnest(['first', 'second']) AS run, count(*) AS sessions"))
def appended_metrics(spark, d):
    """The figures of two runs in one file of JSON lines."""
    path = _path(spark, "metrics")
    for run in ("first", "second"):
        O.append_metrics(run_metrics(spark, d).withColumn("run", F.lit(run)), path)
    kinds = ", ".join(f"{c} {'string' if c == 'run' else t}" for c, t in [*run_metrics(spark, d).dtypes, ("run", "string")])
    return spark.read.schema(kinds).json(path)


@query("saved_report", ORACLES["classification_report"])
def saved_report(spark, d):
    path = _path(spark, "report")
    O.save_report(report(spark, d), path)
    return spark.read.csv(path, header=True, schema="name string, precision string, recall string, f1 string, support bigint")


# ---------------------------------------------------------------- loaders


@query("loaded_windows", f"WITH {SPLIT_WINDOWS} SELECT session_id, label, split, len(ls)::INT AS n_lines FROM spl")
def loaded_windows(spark, d):
    return A.load_sessions(event_lines(spark, d), "bgl").select("session_id", "label", "split", F.size("lines").alias("n_lines"))


def block_lines(spark, d) -> DataFrame:
    """The log with a time and one block key in front; each 11th line has two keys, each 13th none."""
    i = F.col("line_no")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyMMdd HHmmss")
    key = F.concat(F.lit("blk_-"), F.col("user_id").cast("string"))
    keys = F.when(i % 13 == 0, "no block").when(i % 11 == 0, F.concat(key, F.lit(" and blk_7"))).otherwise(key)
    return event_lines(spark, d).select("line_no", F.concat(stamp, F.lit(" INFO "), keys, F.lit(" "), "line").alias("line"))


BLOCKS = f"""{LINES}, bl AS (SELECT line_no, ts, CASE WHEN line_no % 13 <> 0 THEN 'blk_-' || user_id::VARCHAR END AS block_id, line_no % 11 = 0 AND line_no % 13 <> 0 AND user_id <> -7 AS two,
  strftime(ts, '%y%m%d %H%M%S') || ' INFO ' || CASE WHEN line_no % 13 = 0 THEN 'no block' WHEN line_no % 11 = 0 THEN 'blk_-' || user_id::VARCHAR || ' and blk_7' ELSE 'blk_-' || user_id::VARCHAR END || ' ' || line AS line FROM lines)"""


def block_labels(spark, d) -> DataFrame:
    u = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return u.where("user_id % 2 = 0").select(F.concat(F.lit("blk_-"), F.col("user_id").cast("string")).alias("block_id"), F.when(F.col("user_id") % 6 == 0, "Anomaly").otherwise("Normal").alias("label"))


@query("loaded_blocks", f"""WITH {BLOCKS}, win AS (SELECT 'HDFS_' || block_id AS session_id, (-replace(block_id, 'blk_', '')::BIGINT % 6 = 0)::INT AS label, list(line ORDER BY line_no) AS ls FROM bl WHERE block_id IS NOT NULL GROUP BY block_id), {SPLIT}
SELECT session_id, label, split, len(ls)::INT AS n_lines, md5(array_to_string(ls, chr(10))) AS digest FROM spl""")
def loaded_blocks(spark, d):
    s = A.load_sessions(block_lines(spark, d), "HDFS", block_labels(spark, d))
    return s.select("session_id", "label", "split", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("strict_sessions", f"WITH {BLOCKS} SELECT block_id, count(*)::INT AS n_lines, md5(string_agg(line, chr(10) ORDER BY date_trunc('second', ts), line_no)) AS digest FROM bl WHERE block_id IS NOT NULL AND NOT two GROUP BY block_id")
def strict_sessions(spark, d):
    s = W.strict_keyed_sessions(block_lines(spark, d), L.BLOCK_KEY)
    return s.select("block_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("vocabulary_ids", f"""WITH {windows_sql(10, 10)}, t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(array_to_string(ls, ' ')), '\\s+'), lambda t: t <> '')) AS term FROM win),
c AS (SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 500), v AS (SELECT term, (row_number() OVER (ORDER BY n DESC, term) + 2)::INT AS id FROM c),
m AS (SELECT map(list(term), list(id)) AS ids FROM v), per AS (SELECT session_id, flatten(list_transform(ls, lambda l: list_transform({_TOK}, lambda t: coalesce(ids[t], 0)) || [2])) AS p FROM win, m)
SELECT session_id, '1,' || array_to_string(p, ',') AS ids FROM per""")
def vocabulary_ids(spark, d):
    w = windows(spark, d)
    return Q.with_vocabulary_ids(w, Q.vocabulary(w, 500)).select("session_id", F.array_join("input_ids", ",").alias("ids"))


@query("masked_arrays", f"""WITH {windows_sql(10, 10)}, wlines AS (SELECT session_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM win), {_mask_sql('wlines', 'session_id, i', 'line', K.rules_for('HDFS'))}
SELECT session_id, count(*)::INT AS n_lines, string_agg(masked, '|' ORDER BY i) AS masked, sum(length(masked) + 1)::INT - 1 AS normalized_length FROM masked GROUP BY session_id""")
def masked_arrays(spark, d):
    got = E.masked_sessions(windows(spark, d), "HDFS", join=False)
    return got.select("session_id", F.size("masked").alias("n_lines"), F.array_join("masked", "|").alias("masked"), "normalized_length")


# ---------------------------------------------------------------- scores and hits of a caller's own


def _error_logits(batches):
    """A model of one's own: how many lines of a session speak of errors."""
    import numpy as np
    import pandas as pd

    for b in batches:
        n = np.array([sum("error" in line for line in lines) for lines in b["lines"]], float)
        yield pd.DataFrame({"session_id": b["session_id"], "logits": list(np.stack([np.full(len(n), 1.5), n], 1))})


@query("scored_with", f"""WITH {windows_sql(10, 10)}, lg AS (SELECT session_id, len(list_filter(ls, lambda l: contains(l, 'error')))::DOUBLE AS b FROM win)
SELECT session_id, (b > 1.5)::INT AS pred, round(abs(exp(b - greatest(1.5, b)) - exp(1.5 - greatest(1.5, b))) / (exp(b - greatest(1.5, b)) + exp(1.5 - greatest(1.5, b))), 9) AS margin FROM lg""")
def scored_with(spark, d):
    s = S.score_with(windows(spark, d).select("session_id", "lines"), _error_logits)
    return s.select("session_id", "pred", F.round("margin", 9).alias("margin"))


@query("evidence_picks", f"WITH {EVIDENCE} SELECT 'ids' AS how, evidence_id, doc_idx FROM ev WHERE evidence_id IN ('E_BGL_00000010', 'E_BGL_00000020', 'E_BGL_00000030', 'E_none') UNION ALL SELECT 'position', evidence_id, doc_idx FROM ev WHERE doc_idx = 3")
def evidence_picks(spark, d):
    ev = evidence_of(spark, d)
    found = {"ids": E.lookup(ev, ids=["E_BGL_00000010", "E_BGL_00000020", "E_BGL_00000030", "E_none"]), "position": E.lookup(ev, position=3)}
    a, b = (v.select(F.lit(k).alias("how"), "evidence_id", "doc_idx") for k, v in found.items())
    return a.unionByName(b)


@query("batch_hits", ORACLES["session_retrieval"])
def batch_hits(spark, d):
    """The hits of a method by name, each session's own document left out."""
    work = Work(spark, "chats")
    s = work.table(chat_sessions(spark, d), "sessions")
    ev = work.table(E.build_evidence(s, "BGL"), "evidence")
    hits = E.retriever("bm25")(P.in_split(s, "val"), ev, E.bm25_index(ev), 5, dataset="BGL", digits=6)
    return hits.select("query_id", "rank", "evidence_id", "score")


@query("fused_hits", f"""WITH {DOC_EV}, {BENCH_Q}, {bm25_sql('dev')}, {top_sql('dev', 'bq', 5, False)}, rk AS (SELECT query_id, evidence_id, rank FROM top UNION ALL SELECT query_id, evidence_id, 6 - rank FROM top WHERE rank <= 3),
sm AS (SELECT query_id, evidence_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk GROUP BY ALL), o AS (SELECT query_id, evidence_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, evidence_id)::INT AS rank FROM sm)
SELECT query_id, evidence_id, score, rank FROM o WHERE rank <= 5""")
def fused_hits(spark, d):
    """BM25's ranking fused with one that turns its first three around."""
    hits = benchmark_hits(spark, d).select("query_id", "rank", "evidence_id")
    return E.fuse([hits, hits.where("rank <= 3").withColumn("rank", 6 - F.col("rank"))]).withColumn("score", F.round("score", 9))


# ---------------------------------------------------------------- runs and sweeps


@query("resumed_run", f"WITH {windows_sql(10, 10)}, {SCORED} SELECT session_id, 1::BIGINT AS records, 'anomaly' AS prediction FROM sc WHERE pred = 1 AND start_idx % 13 <> 0")
def resumed_run(spark, d):
    """Records of a run that was stopped after the first half of its sessions, and started again."""
    path = _path(spark, "run")
    work = Work(spark, "prepared")
    prepared = work.table(X.prompts(flagged_records(spark, d).where("pred = 1")), "prompts")
    given = work.table(answers(spark, d).withColumn("error", F.when(F.col("start_idx") % 13 == 0, "timeout")), "answers")
    half = prepared.where(F.xxhash64("session_id") < 0)
    A.explain_in_batches(half, given, path, 2)
    run = A.explain_in_batches(prepared, given, path, 2)
    got = run.records("session_id string, explanation struct<prediction string>")
    return got.groupBy("session_id").agg(F.count("*").alias("records"), F.max("explanation.prediction").alias("prediction"))


def labelled_parts(spark, d) -> list[DataFrame]:
    """Documents as labelled sessions, in parts; ids are labelled and split, and texts are shuffled only once, to them."""
    docs = document_sessions(spark, d)
    work = Work(spark, "labelled")
    ids = W.with_labels(docs.select("block_id"), quality_labels(spark, d)).withColumnRenamed("block_id", "session_id")
    ids = work.table(P.stratified_split(ids).dropDuplicates(["session_id"]), "ids")
    s = work.table(docs.withColumnRenamed("block_id", "session_id").join(ids, "session_id"), "sessions")
    work.drop(ids)
    return [P.oversampled(P.in_split(s, "train")).drop("draw"), P.in_split(s, "val"), P.in_split(s, "test")]


@query("sweep_report")
def sweep_report(spark, d):
    """A sweep over the number of features, as a CSV file that is read again."""
    path = _path(spark, "sweep")
    O.save_report(S.sweep(*labelled_parts(spark, d), [1 << 10, 1 << 12, 1 << 14], patience=1), path)
    return spark.read.csv(path, header=True, schema="k int, macro_f1 double, test_acc double")


@query("classifier_agreement", """WITH win AS (SELECT d.doc_id::VARCHAR AS session_id, coalesce(CASE WHEN quality = 0 THEN 1 ELSE 0 END, 0) AS label FROM documents d LEFT JOIN labels USING (doc_id)), """ + SPLIT + """
SELECT count(*) AS sessions, count(*) AS proper, count(*) AS agreeing FROM spl WHERE split = 'test'""")
def classifier_agreement(spark, d):
    """Of the held-out sessions, those with probabilities that add up to 1, and those that a single prediction agrees on."""
    train, val, test = labelled_parts(spark, d)
    m = S.fit_classifier(train, val, features=1 << 12, reg=(0.01,))
    scored = S.score_sessions(m, test)
    single = S.score_one(m, test).select("session_id", F.col("prediction").alias("_p"), F.col("anomaly_prob").alias("_a"), "normal_prob")
    both = scored.join(single, "session_id")
    name = F.when(F.col("pred") == 1, "Anomalous").otherwise("Normal")
    sums = F.abs(F.col("normal_prob") + F.col("_a") - 1) < 1e-9
    return both.agg(F.count("*").alias("sessions"), F.count_if(sums & F.col("_a").between(0, 1)).alias("proper"), F.count_if((name == F.col("_p")) & (F.col("anomaly_prob") == F.col("_a"))).alias("agreeing"))


# ---------------------------------------------------------------- vectors


def embedding_rows(spark, d) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    sid = F.col("vec_id").cast("string")
    return v.select(L.evidence_id(sid).alias("evidence_id"), sid.alias("session_id"), F.col("vec_id").alias("doc_idx"), F.col("embedding").alias("vector"))


@query("dense_hits", """WITH s AS (SELECT q.vec_id AS q, e.vec_id AS v, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT q::VARCHAR AS query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, v)::INT AS rank, 'E_' || v::VARCHAR AS evidence_id, score FROM s QUALIFY rank <= 5""")
def dense_hits(spark, d):
    """Every fiftieth vector as a query against all others."""
    rows = embedding_rows(spark, d)
    q = rows.where("doc_idx % 50 = 0").select(F.col("session_id").alias("query_id"), "vector", F.array("session_id").alias("exclude"))
    return D.dense_retrieve(q, D.dense_index(rows), 5).select("query_id", "rank", "evidence_id", "score")


_TV = f"""(SELECT id, b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS w FROM (SELECT id, h, h % 64 AS b FROM (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM (SELECT {{id}} AS id, unnest({_RT.format('{text}')}) AS term FROM {{source}}))) GROUP BY id, b)"""


def text_cosine_sql(queries: str, docs: str, drop: str, k: int, out: str = "dtop") -> str:
    """The best documents by the cosine of hashed term counts."""
    n = lambda c: f"SELECT id, sqrt(sum(w * w)) AS n FROM {c} GROUP BY id HAVING sum(w * w) > 0"
    return f"""qv AS MATERIALIZED {_TV.format(id='query_id', text='query', source=queries)}, ev_ AS MATERIALIZED {_TV.format(id='evidence_id', text='text', source=docs)}, qn AS ({n('qv')}), en AS ({n('ev_')}),
dt_ AS (SELECT q.id AS query_id, e.id AS evidence_id, sum(q.w * e.w) AS dot FROM qv q JOIN ev_ e USING (b) GROUP BY ALL),
ds AS (SELECT qn.id AS query_id, en.id AS evidence_id, round(coalesce(dot, 0) / (qn.n * en.n), 6) AS score FROM qn CROSS JOIN en LEFT JOIN dt_ ON dt_.query_id = qn.id AND dt_.evidence_id = en.id),
{out} AS (SELECT query_id, evidence_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx)::INT AS rank FROM ds JOIN {docs} USING (evidence_id) WHERE {drop} QUALIFY rank <= {k})"""


@query("text_vector_hits", f"WITH {DOC_EV}, {BENCH_Q}, {text_cosine_sql('bq', 'dev', 'true', 5)} SELECT query_id, rank, evidence_id, score FROM dtop")
def text_vector_hits(spark, d):
    """Benchmark items as queries against all documents, by vectors of their texts."""
    ev = E.evidence_vectors(document_evidence(spark, d))
    b = benchmark_queries(spark, d)
    q = b.join(D.text_vectors(b, "query_id", F.col("query")), "query_id").select("query_id", "vector", "exclude")
    return D.dense_retrieve(q, D.dense_index(ev), 5).select("query_id", "rank", "evidence_id", "score")


SESSION_TOP_20 = SESSION_TOP.replace("QUALIFY rank <= 5", "QUALIFY rank <= 20")


@query("hybrid_hits", f"""WITH {SESSION_TOP_20}, {text_cosine_sql('wq', 'ev', 'session_id <> query_id', 20)}, rk AS (SELECT query_id, evidence_id, rank FROM top UNION ALL SELECT query_id, evidence_id, rank FROM dtop),
sm AS (SELECT query_id, evidence_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk GROUP BY ALL)
SELECT query_id, evidence_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id)::INT AS rank FROM sm QUALIFY rank <= 5""")
def hybrid_hits(spark, d):
    """Conversations held out, against the others, by terms and by vectors."""
    work = Work(spark, "chats")
    s = work.table(chat_sessions(spark, d), "sessions")
    ev = work.table(E.build_evidence(s, "BGL"), "evidence")
    hits = E.retriever("hybrid")(P.in_split(s, "val"), ev, None, 5, dataset="BGL", digits=6)
    return hits.select("query_id", "evidence_id", F.round("score", 9).alias("score"), "rank")


# ---------------------------------------------------------------- explanations end to end


def flagged_records(spark, d) -> DataFrame:
    """Every window with its score and three hits, as the prompt builder takes them."""
    w = windows(spark, d).join(scored_windows(spark, d).select("session_id", "pred", "prob", "margin", "anomaly_prob"), "session_id")
    return w.join(_records(spark, d).select("session_id", "hits"), "session_id")


@query("full_prompts", f"""WITH {windows_sql(10, 10)}, {SCORED}, x AS (SELECT session_id, ls, printf('%.2f%%', p1 * 100) AS probability, printf('%.4f', abs(p1 - p0)) AS margin FROM win JOIN sc USING (session_id))
SELECT session_id, 'This session was flagged as anomalous.' || chr(10) || chr(10) || 'Session ID: ' || session_id || chr(10) || 'Anomaly probability: ' || probability || chr(10) || 'Margin: ' || margin || chr(10) || chr(10)
  || 'Log:' || chr(10) || array_to_string(ls[1:6], chr(10)) || chr(10) || '... (4 more lines)' || chr(10) || chr(10) || 'Evidence:' || chr(10)
  || '[E1] (score: 1.00)' || chr(10) || 'Original ID: E_1_' || session_id || chr(10) || 'an error event' || chr(10) || chr(10) || '[E2] (score: 0.50)' || chr(10) || 'Original ID: E_2_' || session_id || chr(10) || 'all quiet here' || chr(10)
  || chr(10) || chr(10) || 'Answer with one JSON object: prediction, summary, claims (claim, evidence_ids), insufficient_evidence.' AS prompt, 2 AS n_ids FROM x""")
def full_prompts(spark, d):
    got = X.prompts(flagged_records(spark, d), max_lines=6, max_items=2)
    return got.select("session_id", "prompt", F.size("id_mapping").alias("n_ids"))


def explained_records(spark, d) -> DataFrame:
    f = X.prompts(flagged_records(spark, d))
    return X.results(f, X.parsed(answers(spark, d)).select("session_id", "explanation", "total_tokens", "latency_ms"))


@query("explained_sessions", f"""WITH {windows_sql(10, 10)}, {SCORED}, {ANSWERS} SELECT session_id, CASE WHEN pred = 0 THEN 'normal' ELSE prediction END AS prediction, CASE WHEN pred = 0 THEN 'No anomaly was detected.' ELSE summary END AS summary,
  CASE WHEN pred = 0 THEN 0 ELSE 3 END AS evidence_count FROM sc JOIN (SELECT session_id, prediction, summary FROM pr) USING (session_id)""")
def explained_sessions(spark, d):
    scored = scored_windows(spark, d)
    return X.explained(scored, explained_records(spark, d).join(scored.where("pred = 1").select("session_id"), "session_id", "left_semi"))


@query("failed_answers", f"WITH {windows_sql(10, 10)} SELECT session_id, 'timeout' AS error FROM win WHERE start_idx % 13 = 0")
def failed_answers(spark, d):
    return X.failures(answers(spark, d).withColumn("error", F.when(F.col("start_idx") % 13 == 0, "timeout")))


#: By kind of answer: its claims as (claim, cited ids).
KINDS = (
    (("An error event was logged", ("E1",)), ("All was quiet here before", ("E2",))),  # passes everything
    (("An error event was logged", ("E1",)), ("Memory exhausted somewhere", ("E2", "E3"))),  # a claim that its evidence does not hold
    (("An error event was logged", ("E1", "E9")),),  # an unknown id
    (("An error event was logged", ("E1",)), ("Nothing cited for this", ())),  # half covered
    (("An error event was logged", ("E1", "E2", "E3")), ("too few", ("E2",))),  # a third of the citations match; a short claim
    (("Everything exhausted overall", ()),),  # nothing cited at all
)


def checked_records(spark, d) -> DataFrame:
    """Complete answers of six kinds, with the hits of ``_records``."""
    kind = (F.col("start_idx") / 10).cast("bigint") % len(KINDS)
    claim = lambda c, ids: F.struct(F.lit(c).alias("claim"), F.array(*map(F.lit, ids)).cast("array<string>").alias("evidence_ids"), F.lit(None).cast("string").alias("confidence"))
    claims = F.element_at(F.array(*[F.array(*[claim(*c) for c in k]) for k in KINDS]), (kind + 1).cast("int"))
    x = F.struct(F.lit("anomaly").alias("prediction"), F.lit("Something failed").alias("summary"), claims.alias("claims"), F.lit(False).alias("insufficient_evidence"))
    return _records(spark, d).withColumn("explanation", x)


def _kinds_sql() -> str:
    """The claims as a DuckDB table (kind, i, claim, ids)."""
    rows = [f"({k}, {i}, '{c}', {list(ids)!r}::VARCHAR[])" for k, claims in enumerate(KINDS) for i, (c, ids) in enumerate(claims)]
    return f"kc(kind, i, claim, ids) AS (VALUES {', '.join(rows)})"


_STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)
CHECKED = f"""{_kinds_sql()}, hit(id, text) AS (VALUES ('E1', 'an error event'), ('E2', 'all quiet here'), ('E3', 'nothing to see')),
kw AS (SELECT kind, i, claim, ids, list_filter(list_distinct(regexp_extract_all(lower(claim), '\\b[a-z]{{4,}}\\b')), lambda w: w NOT IN ({_STOP})) AS words FROM kc),
ci AS (SELECT kind, i, words, unnest(ids) AS id FROM kw), mt AS (SELECT ci.kind, ci.i, count(*) AS n, count_if(len(list_filter(words, lambda w: contains(coalesce(text, ''), w))) > 0) AS m, len(any_value(words)) AS k FROM ci LEFT JOIN hit USING (id) GROUP BY ci.kind, ci.i),
lw AS (SELECT kind, count_if(k > 0 AND m / n::DOUBLE < 0.3) AS low FROM mt GROUP BY kind),
kk AS (SELECT kind, count(*) AS claims, count_if(len(ids) > 0) AS cited, count_if(length(trim(claim)) < 10) AS short, list_distinct(flatten(list(ids))) AS all_ids FROM kc GROUP BY kind),
ks AS (SELECT kind, coalesce(low, 0) AS low, len(list_filter(all_ids, lambda e: e NOT IN ('E1', 'E2', 'E3'))) > 0 AS f_ids, len(all_ids) = 0 AS w_ids, cited / claims::DOUBLE < 0.8 AS f_cov, short > 0 AS w_short FROM kk LEFT JOIN lw USING (kind)),
cv AS (SELECT session_id, ks.* FROM win JOIN ks ON ks.kind = (start_idx // 10) % {len(KINDS)}),
ct AS (SELECT session_id, 4 + greatest(low, 1) AS total_checks, f_ids::INT + f_cov::INT AS failed_checks, w_ids::INT + low + w_short::INT AS warnings FROM cv)"""


@query("checked_answers", f"WITH {windows_sql(10, 10)}, {CHECKED} SELECT session_id, total_checks::INT AS total_checks, failed_checks::INT AS failed_checks, warnings::INT AS warnings, (total_checks - failed_checks - warnings)::INT AS passed_checks, failed_checks = 0 AS verified FROM ct")
def checked_answers(spark, d):
    return V.verify(checked_records(spark, d)).select("session_id", "total_checks", "failed_checks", "warnings", "passed_checks", "verified")


@query("checked_issue_counts", f"""WITH {windows_sql(10, 10)}, {CHECKED}, i AS (SELECT 'structure' AS "check", 'pass' AS s, 1 AS n FROM cv UNION ALL SELECT 'evidence_ids', CASE WHEN f_ids THEN 'fail' WHEN w_ids THEN 'warning' ELSE 'pass' END, 1 FROM cv
  UNION ALL SELECT 'coverage', CASE WHEN f_cov THEN 'fail' ELSE 'pass' END, 1 FROM cv UNION ALL SELECT 'keyword_match', CASE WHEN low > 0 THEN 'warning' ELSE 'pass' END, greatest(low, 1) FROM cv UNION ALL SELECT 'empty_claims', CASE WHEN w_short THEN 'warning' ELSE 'pass' END, 1 FROM cv)
SELECT "check", coalesce(sum(n) FILTER (WHERE s = 'pass'), 0)::BIGINT AS pass, coalesce(sum(n) FILTER (WHERE s = 'fail'), 0)::BIGINT AS fail, coalesce(sum(n) FILTER (WHERE s = 'warning'), 0)::BIGINT AS warning FROM i GROUP BY 1""")
def checked_issue_counts(spark, d):
    return V.issue_counts(V.verify(checked_records(spark, d)))


@query("checked_summary", f"WITH {windows_sql(10, 10)}, {CHECKED} SELECT count(*) AS total, count_if(failed_checks = 0) AS passed, round(count_if(failed_checks = 0) / count(*)::DOUBLE, 9) AS pass_rate FROM ct")
def checked_summary(spark, d):
    return V.summary(V.verify(checked_records(spark, d))).withColumn("pass_rate", F.round("pass_rate", 9))
