"""Prompts, parsed explanations and their costs (EXP1-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "prediction string, summary string, claims array<struct<claim string, evidence_ids array<string>, confidence string>>, insufficient_evidence boolean, _bad string"

# USD for a million prompt and completion tokens; the first key that a model's name holds counts.
PRICES = ((1, "gpt-4o", 2.5, 10.0), (2, "gpt-4o-mini", 0.15, 0.6), (3, "gpt-4-turbo", 10.0, 30.0), (4, "gpt-4", 30.0, 60.0), (5, "gpt-3.5-turbo", 0.5, 1.5))

SYSTEM = "You explain why a log session was flagged as an anomaly. Cite an evidence id for every claim, use nothing but the evidence, say so if it is not enough, and answer with JSON only."
TEMPLATE = """This session was flagged as anomalous.

Session ID: {session_id}
Anomaly probability: {probability}
Margin: {margin}

Log:
{log}

Evidence:
{evidence}

Answer with one JSON object: prediction, summary, claims (claim, evidence_ids), insufficient_evidence."""


def evidence_block(hits: Column, most: int = 500) -> Column:
    """The hits as text; ``hits`` is an array of (score, evidence_id, text)."""
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)
    one = lambda h, i: F.concat(F.format_string("[E%d] (score: %.2f)\n", i + 1, h["score"]), F.lit("Original ID: "), h["evidence_id"], F.lit("\n"), cut(h["text"]), F.lit("\n"))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, one), "\n")).otherwise("No evidence retrieved.")


def log_block(lines: Column, most: int = 20) -> Column:
    more = F.when(F.size(lines) > most, F.array(F.concat(F.lit("... ("), (F.size(lines) - most).cast("string"), F.lit(" more lines)")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(lines, 1, most), more), "\n")


def prompts(flagged: DataFrame, template: str = TEMPLATE, max_lines: int = 20, max_items: int = 5, max_chars: int = 500) -> DataFrame:
    """Append ``system``, ``prompt`` and ``id_mapping`` to ``(session_id, lines, anomaly_prob, margin, hits)``."""
    used = F.slice("hits", 1, max_items)
    values = {
        "session_id": F.col("session_id"), "probability": F.format_string("%.2f%%", F.col("anomaly_prob") * 100), "margin": F.format_string("%.4f", "margin"),
        "log": log_block(F.col("lines"), max_lines), "evidence": evidence_block(used, max_chars),
    }
    parts: list[Column] = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        parts.append(values[piece[1:-1]] if piece.startswith("{") and piece[1:-1] in values else F.lit(piece))
    return flagged.withColumns({"system": F.lit(SYSTEM), "prompt": F.concat(*parts), "id_mapping": id_mapping(F.col("hits"), max_items)})


def id_mapping(hits: Column, max_items: int = 5) -> Column:
    return F.map_from_entries(F.transform(F.slice(hits, 1, max_items), lambda h, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("key"), h["evidence_id"].alias("value"))))


def json_part(content: Column) -> Column:
    """From the first brace to the last, fences and prose left out; the text itself without braces."""
    inner = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(F.trim(content))


def parsed(responses: DataFrame) -> DataFrame:
    """Append ``explanation`` and ``parse_failed`` from ``content``; missing and null fields get
    defaults, and text that is no JSON gives the failure record."""
    raw = F.from_json(json_part(F.col("content")), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = responses.withColumn("_x", raw)
    x = F.col("_x")
    bad = x.isNull() | x["_bad"].isNotNull()
    claim = lambda c: F.struct(F.coalesce(c["claim"], F.lit("")).alias("claim"), F.coalesce(c["evidence_ids"], F.array().cast("array<string>")).alias("evidence_ids"), c["confidence"].alias("confidence"))
    none = F.array().cast("array<struct<claim string, evidence_ids array<string>, confidence string>>")
    fields = F.struct(
        F.when(bad, "anomaly").otherwise(F.coalesce(x["prediction"], F.lit("anomaly"))).alias("prediction"),
        F.when(bad, F.concat(F.lit("JSON parse error: "), F.substring(F.coalesce("content", F.lit("")), 1, 100))).otherwise(F.coalesce(x["summary"], F.lit(""))).alias("summary"),
        F.when(bad, none).otherwise(F.coalesce(F.transform(x["claims"], claim), none)).alias("claims"),
        F.when(bad, True).otherwise(F.coalesce(x["insufficient_evidence"], F.lit(False))).alias("insufficient_evidence"),
    )
    return df.withColumn("explanation", fields).withColumn("parse_failed", bad).drop("_x")


def cited_ids(explanation: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(explanation["claims"], lambda c: c["evidence_ids"])))


def coverage(explanation: Column) -> Column:
    n = F.size(explanation["claims"])
    return F.when(n > 0, F.size(F.filter(explanation["claims"], lambda c: F.size(c["evidence_ids"]) > 0)) / n).otherwise(F.lit(0.0))


def token_total(total: Column, prompt: Column, completion: Column) -> Column:
    return F.coalesce(total, F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))


def costs(responses: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Append ``cost_usd``: the first price, by ``ord``, whose key is in the model's name; else 0.

    ``prices(ord, key, input, output)`` is in USD for a million tokens and is small by nature.
    """
    if prices is None:
        prices = responses.sparkSession.createDataFrame(list(PRICES), "ord int, key string, input double, output double")
    models = responses.select("model").distinct()
    found = models.join(F.broadcast(prices), F.col("model").contains(F.col("key"))).groupBy("model").agg(F.min_by(F.struct("input", "output"), "ord").alias("_p"))
    usd = F.coalesce(F.col("prompt_tokens"), F.lit(0)) / 1e6 * F.col("_p.input") + F.coalesce(F.col("completion_tokens"), F.lit(0)) / 1e6 * F.col("_p.output")
    return responses.join(F.broadcast(found), "model", "left").withColumn("cost_usd", F.coalesce(usd, F.lit(0.0))).drop("_p").select(*responses.columns, "cost_usd")


def failures(responses: DataFrame) -> DataFrame:
    """``(session_id, error)`` of the calls that gave no answer."""
    return responses.where("error IS NOT NULL").select("session_id", "error")


def results(flagged: DataFrame, answers: DataFrame) -> DataFrame:
    """One nested record for each explained session."""
    return flagged.join(answers, "session_id").select(
        "session_id", "label", F.struct("pred", "prob", "margin").alias("screener"), F.transform("hits", lambda h: h["evidence_id"]).alias("evidence_ids"), "id_mapping", "explanation",
        F.struct("total_tokens", "latency_ms").alias("metrics"), F.current_timestamp().alias("created_at"),
    )


def explained(scored: DataFrame, records: DataFrame) -> DataFrame:
    """A row for each session: normal ones get a fixed record, the others their explanation."""
    normal = scored.where("pred = 0").select("session_id", F.lit("normal").alias("prediction"), F.lit("No anomaly was detected.").alias("summary"), F.lit(0).alias("evidence_count"))
    rest = records.select("session_id", F.col("explanation.prediction").alias("prediction"), F.col("explanation.summary").alias("summary"), F.size("evidence_ids").alias("evidence_count"))
    return normal.unionByName(rest)
