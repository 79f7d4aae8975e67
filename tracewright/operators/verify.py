"""Rule checks of explanations against their evidence (VER1-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .explain import cited_ids, coverage

# Words that say nothing about a claim.
STOPWORDS = ("this", "that", "with", "from", "have", "been", "were", "they", "their", "which", "there", "about", "would", "could", "should", "these", "those", "being", "other")


def _issue(check: Column | str, status: Column | str, message: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(check).alias("check"), lit(status).alias("status"), lit(message).alias("message"))


def structure(x: Column) -> Column:
    empty = F.concat(*[F.when(c, F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for n, c in (("prediction", x["prediction"] == ""), ("summary", x["summary"] == ""), ("claims", F.size(x["claims"]) == 0))])
    return F.when(F.size(empty) > 0, _issue("structure", "fail", F.concat(F.lit("missing: "), F.array_join(empty, ", ")))).otherwise(_issue("structure", "pass", "complete"))


def valid_ids(x: Column, mapping: Column) -> Column:
    ids = cited_ids(x)
    unknown = F.array_sort(F.array_except(ids, F.map_keys(mapping)))
    return (
        F.when(F.size(unknown) > 0, _issue("evidence_ids", "fail", F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))))
        .when(F.size(ids) == 0, _issue("evidence_ids", "warning", "none cited"))
        .otherwise(_issue("evidence_ids", "pass", "all known"))
    )


def covered(x: Column, least: float = 0.8) -> Column:
    c = coverage(x)
    return F.when(c < least, _issue("coverage", "fail", F.format_string("%.2f", c))).otherwise(_issue("coverage", "pass", F.format_string("%.2f", c)))


def keywords(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z]{4,}\b"), 0)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS)))


def overlap(x: Column, hits: Column, least: float = 0.3) -> Column:
    """Warnings for claims whose cited evidence holds none of their keywords; one pass without any.

    ``hits`` are all retrieved ones; ``E<i>`` is the i-th.  Repeated citations count again, and unknown ones
    as misses.  Claims without citations or keywords are skipped.
    """
    text_of = lambda e: F.get(hits, F.when(F.regexp_like(e, F.lit("^E[1-9][0-9]{0,8}$")), F.substring(e, 2, 9).try_cast("int") - 1))["text"]
    match = lambda e, words: F.coalesce(F.exists(words, lambda w: F.contains(F.lower(text_of(e)), w)), F.lit(False))
    ratio = lambda c: F.size(F.filter(c["evidence_ids"], lambda e: match(e, keywords(c["claim"])))) / F.size(c["evidence_ids"])
    judged = F.transform(x["claims"], lambda c, i: F.when((F.size(c["evidence_ids"]) > 0) & (F.size(keywords(c["claim"])) > 0), F.struct(i.alias("i"), ratio(c).alias("r"))))
    low = F.filter(judged, lambda j: j.isNotNull() & (j["r"] < least))
    warnings = F.transform(low, lambda j: _issue(F.concat(F.lit("keyword_match_claim_"), j["i"].cast("string")), "warning", F.format_string("%.2f", j["r"])))
    return F.when(F.size(warnings) > 0, warnings).otherwise(F.array(_issue("keyword_match", "pass", "claims match")))


def short_claims(x: Column, least: int = 10) -> Column:
    short = F.filter(F.transform(x["claims"], lambda c, i: F.when(F.length(F.trim(c["claim"])) < least, i)), lambda i: i.isNotNull())
    return F.when(F.size(short) > 0, _issue("empty_claims", "warning", F.concat(F.lit("claims "), F.array_join(F.transform(short, lambda i: i.cast("string")), ", ")))).otherwise(_issue("empty_claims", "pass", "none"))


def verify(records: DataFrame, check_keywords: bool = True) -> DataFrame:
    """Append ``issues``, the counts by status, ``verified`` (no failure) and ``pass_rate`` to
    ``(explanation, id_mapping, hits)``."""
    x = F.col("explanation")
    parts = [F.array(structure(x), valid_ids(x, F.col("id_mapping")), covered(x)), *([overlap(x, F.col("hits"))] if check_keywords else []), F.array(short_claims(x))]
    df = records.withColumn("issues", F.concat(*parts))
    count = lambda s: F.size(F.filter("issues", lambda i: i["status"] == s))
    df = df.withColumns({"total_checks": F.size("issues"), "passed_checks": count("pass"), "failed_checks": count("fail"), "warnings": count("warning")})
    return df.withColumns({"verified": F.col("failed_checks") == 0, "pass_rate": F.col("passed_checks") / F.col("total_checks")})


def summary(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("total"), F.count_if("verified").alias("passed"), F.coalesce(F.avg(F.col("verified").cast("double")), F.lit(0.0)).alias("pass_rate"))


def issue_counts(verified: DataFrame) -> DataFrame:
    each = verified.select(F.explode("issues").alias("i")).select(F.substring_index("i.check", "_claim_", 1).alias("check"), "i.status")
    t = each.groupBy("check").pivot("status", ["pass", "fail", "warning"]).count()
    return t.select("check", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in ("pass", "fail", "warning")])
