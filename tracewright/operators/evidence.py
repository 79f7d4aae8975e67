"""Evidence corpus, BM25 retrieval (RET1-9), and retrieval by vectors and by both (OPT2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import evidence_id, retrieval_tokens
from ..functions.masking import compression_ratio, mask, mask_columns, rules_for
from ..functions.rank import hash_rank
from ..sources.scratch import Work
from .bm25 import best_scores, best_texts, bm25_index, bm25_scores, grown_index, query_terms, retrieve  # noqa: F401
from .dense import DenseIndex, dense_index, dense_retrieve, text_vectors


def masked_sessions(sessions: DataFrame, dataset: str = "", stats: bool = False, custom=(), join: bool = True) -> DataFrame:
    """Append ``masked`` (lines masked one by one, joined by newlines, or, with ``join`` off, an array of
    them), ``original_length``, ``normalized_length``, ``compression_ratio`` and, if asked, ``param_stats`` over all lines."""
    rules = rules_for(dataset, custom)
    lines = sessions.select("session_id", F.posexplode("lines").alias("_i", "_line"))
    got = mask_columns(lines, "_line", rules, "_m", "_s" if stats else None)
    whole = got.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("masked"))
    # measured before the join, so that lines nobody asks for do not move
    sized = sessions.withColumn("_length", F.length(F.array_join("lines", "\n")))
    out = sized.join(whole, "session_id", "left").withColumn("masked", F.coalesce("masked", F.array().cast("array<string>")))
    joined = F.array_join("masked", "\n")
    out = out.withColumn("original_length", F.col("_length")).drop("_length").withColumn("normalized_length", F.length(joined))
    out = out.withColumn("masked", joined) if join else out
    out = out.withColumn("compression_ratio", compression_ratio(F.col("original_length"), F.col("normalized_length")))
    if stats:
        # an outer generator: for others Spark infers a filter, which would make all counts twice
        each = got.select("session_id", F.explode_outer("_s").alias("k", "v")).where("k IS NOT NULL").groupBy("session_id", "k").agg(F.sum("v").cast("int").alias("v"))
        maps = each.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("param_stats"))
        out = out.join(maps, "session_id", "left").withColumn("param_stats", F.coalesce("param_stats", F.create_map().cast("map<string,int>")))
    return out


def build_evidence(sessions: DataFrame, dataset: str = "", stats: bool = False) -> DataFrame:
    """Masked train sessions; ``doc_idx`` is the order of the hashes of session ids."""
    train = sessions.where("split = 'train'").withColumn("num_lines", F.size("lines"))
    # a corpus position for each id: counts of hash ranges, then ranks inside them; texts do not move for it
    ids = hash_rank(train.select("session_id", F.lit(1).alias("_all")), ["_all"], "session_id", "corpus", "doc_idx").drop("_all")
    placed = masked_sessions(train, dataset, stats).join(ids, "session_id")
    return placed.select(
        evidence_id(F.col("session_id")).alias("evidence_id"), "session_id", "doc_idx", F.col("masked").alias("text"), "label", F.lit(dataset).alias("dataset"),
        "num_lines", "original_length", "normalized_length", *(["param_stats"] if stats else []),
    )


def lookup(evidence: DataFrame, ids: list[str] | None = None, label: int | None = None, position: int | None = None) -> DataFrame:
    if ids is not None:
        evidence = evidence.where(F.col("evidence_id").isin(ids))
    if label is not None:
        evidence = evidence.where(F.col("label") == label)
    return evidence if position is None else evidence.where(F.col("doc_idx") == position)


def query_text(lines: Column, dataset: str = "") -> Column:
    """A session as a query: its lines joined, then masked as one string."""
    return mask(F.array_join(lines, "\n"), rules_for(dataset))


def batch_retrieve(sessions: DataFrame, evidence: DataFrame, index: dict[str, DataFrame], k: int = 5, exclude_self: bool = True, dataset: str = "", digits: int | None = None) -> DataFrame:
    own = F.array("session_id") if exclude_self else F.lit(None).cast("array<string>")
    return retrieve(sessions.select(F.col("session_id").alias("query_id"), query_text(F.col("lines"), dataset).alias("query"), own.alias("exclude")), evidence, index, k, digits=digits)


def evidence_vectors(evidence: DataFrame, dim: int = 64) -> DataFrame:
    """Evidence with its ``vector``: the one it has (of a model of your own), or that of its text."""
    if "vector" in evidence.columns:
        return evidence
    return evidence.join(text_vectors(evidence, "evidence_id", F.col("text"), dim), "evidence_id")


def dense_batch_retrieve(sessions: DataFrame, evidence: DataFrame, index: DenseIndex | None = None, k: int = 5, exclude_self: bool = True, dataset: str = "", dim: int = 64, **options) -> DataFrame:
    """``batch_retrieve`` by the cosine of vectors: ``vector`` columns if both sides have them, else those of the texts."""
    own = F.array("session_id") if exclude_self else F.lit(None).cast("array<string>")
    index = index or dense_index(evidence_vectors(evidence, dim))
    q = sessions
    if "vector" not in sessions.columns:
        texts = sessions.select("session_id", query_text(F.col("lines"), dataset).alias("query"))
        q = sessions.select("session_id").join(text_vectors(texts, "session_id", F.col("query"), dim), "session_id")
    hits = dense_retrieve(q.select(F.col("session_id").alias("query_id"), "vector", own.alias("exclude")), index, k, **options)
    return hits.join(evidence.select("evidence_id", "text", "label"), "evidence_id").select("query_id", "rank", "evidence_id", "session_id", "score", "text", "label")


def hybrid_batch_retrieve(sessions: DataFrame, evidence: DataFrame, index: tuple[dict[str, DataFrame], DenseIndex] | None = None, k: int = 5, exclude_self: bool = True, dataset: str = "", depth: int = 4, digits: int | None = None) -> DataFrame:
    """BM25's and the vectors' best ``depth * k`` documents by reciprocal-rank fusion."""
    terms, vectors = index or (bm25_index(evidence), dense_index(evidence_vectors(evidence)))
    lists = [batch_retrieve(sessions, evidence, terms, depth * k, exclude_self, dataset, digits=digits), dense_batch_retrieve(sessions, evidence, vectors, depth * k, exclude_self, dataset)]
    return fuse(lists, k).join(evidence.select("evidence_id", "session_id", "text", "label"), "evidence_id").select("query_id", "rank", "evidence_id", "session_id", "score", "text", "label")


def retriever(method: str = "bm25"):
    """The retrieval function of a method."""
    methods = {"bm25": batch_retrieve, "dense": dense_batch_retrieve, "hybrid": hybrid_batch_retrieve}
    if method not in methods:
        raise ValueError(f"unknown retrieval method: {method}")
    return methods[method]


def fuse(rankings: list[DataFrame], k: int = 5, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, rank, evidence_id)`` lists."""
    rows = None
    for r in rankings:
        r = r.select("query_id", "rank", "evidence_id")
        rows = r if rows is None else rows.unionByName(r)
    total = rows.groupBy("query_id", "evidence_id").agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "evidence_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
