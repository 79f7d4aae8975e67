"""A bounded sample of labelled texts to fit a small model on.

The bounds are on rows and on bytes: ids are chosen first (those of the least hashes), their texts are written
once, and sizes alone decide how many of them a class may bring, so that what one task is given is
bounded before any text moves to it.  Texts are taken whole; one that alone is larger than the whole sample cannot be taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import Work


def labelled_sample(work: Work, documents: DataFrame, labels: DataFrame, rows: int, sample_bytes: int, by_class: bool = False) -> DataFrame:
    """``(doc_id, label, text, o)`` of at most ``rows`` ids and ``sample_bytes`` of text in all, or, with
    ``by_class``, of either label 0 and 1.  ``o`` is a hash to order by.

    Of several labels of an id the largest counts, of several texts the least; null is the empty text.
    """
    own = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).withColumn("o", F.xxhash64("doc_id"))
    least = lambda df: df.orderBy("o", "doc_id").limit(rows)
    chosen = least(own.where("label = 0")).unionByName(least(own.where("label = 1"))) if by_class else least(own)
    text = F.coalesce("text", F.lit(""))
    found = documents.select("doc_id", text.alias("text")).where(F.octet_length("text") <= sample_bytes).join(F.broadcast(chosen), "doc_id")
    found = work.table(found.groupBy("doc_id", "label", "o").agg(F.min("text").alias("text")), "sample")
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label" if by_class else F.lit(0)).orderBy("o", "doc_id"))
    fits = found.select("doc_id", upto.alias("_upto")).where(F.col("_upto") <= sample_bytes).select("doc_id")
    return found.join(F.broadcast(fits), "doc_id", "left_semi")
