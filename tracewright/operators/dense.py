"""Dense and hybrid retrieval (OPT2): exact top-k by cosine over vectors in cells, and vectors of texts.

Rows join the nearest of at most ``cells`` centres, which are fitted on ``sample`` rows.  A cell of more than
``block`` rows is dealt over several blocks.  A query looks first into its ``probes`` nearest cells; its k-th
best score there, and each cell's radius, then say which other cells can still hold a better row, and only
these are looked into.  So results are exact; without the second look (``exact=False``) they are those of a
multi-probe index, whose recall depends on the data.  In a block, queries and rows are one matrix product.

Vectors that are null, hold null or non-finite components, or are all zero have no direction: such rows are not
indexed and such queries have no hits.  Equal (rounded) scores come by ``doc_idx``.  Vectors must have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import retrieval_tokens
from ..sources.scratch import Work


def unit(vector: Column) -> Column:
    """The vector at length 1, as doubles; null if it has no direction."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    good = (size > 0) & (size < float("inf")) & ~F.isnan(size)
    return F.when(good, F.transform(v, lambda x: x / size))


def text_vectors(df: DataFrame, key: str, text: Column, dim: int = 64) -> DataFrame:
    """``(key, vector)``: signed counts of terms by a hash into ``dim`` places; a row for each key with a term."""
    h = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint")
    terms = df.select(key, F.explode(retrieval_tokens(text)).alias("term"))
    terms = terms.select(key, (h % dim).cast("int").alias("_at"), F.when(F.floor(h / dim) % 2 == 0, 1).otherwise(-1).alias("_s"))
    sums = [F.coalesce(F.sum(F.when(F.col("_at") == i, F.col("_s"))), F.lit(0)).cast("double") for i in range(dim)]
    return terms.groupBy(key).agg(F.array(*sums).alias("vector"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centres(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Up to ``n`` unit centres of unit rows, by k-means on the sphere from evenly spread rows."""
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(n, len(c))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


@dataclass
class DenseIndex:
    """``rows (evidence_id, session_id, doc_idx, vector, cell, block)`` and, for each cell, its centre, radius and blocks."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray


def dense_index(vectors: DataFrame, cells: int = 256, block: int = 8192, sample: int = 4096) -> DenseIndex:
    """Index ``vectors(evidence_id, session_id, doc_idx, vector)``; all rows are indexed, the centres are fitted on ``sample`` of them."""
    work = Work(vectors.sparkSession, "dense")
    rows = vectors.select("evidence_id", "session_id", "doc_idx", unit(F.col("vector")).alias("vector")).where("vector IS NOT NULL")
    n = rows.count()
    few = rows.orderBy(F.xxhash64("evidence_id"), "evidence_id").limit(sample).toArrow()
    centres = _centres(_matrix(few.column("vector")), max(1, min(cells, -(-n // block)))) if n else np.zeros((1, 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"))
            cell = (x @ centres.T).argmax(axis=1)
            far = np.linalg.norm(x - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    kinds = dict(rows.dtypes)
    kept = work.table(rows.mapInArrow(placed, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", cell int, far double"), "placed")
    count, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in kept.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most ``cells`` rows
        count[r.cell], radius[r.cell] = r.n, r.far
    blocks = -(-count // block)
    deal = F.broadcast(vectors.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(blocks)], "cell int, blocks int"))
    dealt = kept.join(deal, "cell").select("evidence_id", "session_id", "doc_idx", "vector", "cell", F.pmod(F.xxhash64("evidence_id"), F.col("blocks")).cast("int").alias("block"))
    return DenseIndex(dealt, centres, radius, blocks)


def dense_retrieve(queries: DataFrame, index: DenseIndex, k: int = 5, probes: int = 8, exact: bool = True, min_score: float | None = None, digits: int = 6, chunk: int = 16_384) -> DataFrame:
    """``(query_id, rank, evidence_id, score)`` of the best ``k`` rows for ``queries(query_id, vector, exclude)``; ``exclude`` is an array of session ids or null."""
    if not index.blocks.sum():
        kinds = dict(queries.dtypes) | dict(index.rows.dtypes)
        return queries.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, rank int, evidence_id {kinds['evidence_id']}, session_id {kinds['session_id']}, score double")
    work = Work(queries.sparkSession, "dense")
    most = k + max(0, queries.agg(F.max(F.size("exclude"))).first()[0] or 0)
    asked = queries.select("query_id", unit(F.col("vector")).alias("vector")).where("vector IS NOT NULL").withColumn("floor", F.lit(-2.0))
    asked = work.table(asked, "queries")
    hits = work.table(_looked(asked, index, most, 0, probes, digits, chunk), "first")
    if exact and probes < len(index.centres):
        floor = hits.where(F.col("rank") == most).select("query_id", F.col("score").alias("floor"))
        again = asked.drop("floor").join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        more = _looked(again, index, most, probes, len(index.centres), digits, chunk)
        hits = hits.drop("rank").unionByName(more.drop("rank"))
    hits = hits if min_score is None else hits.where(F.col("score") >= min_score)
    excluded = queries.select("query_id", F.explode("exclude").alias("session_id")).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx")
    kept = hits.join(excluded, ["query_id", "session_id"], "left_anti").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kept = work.table(kept, "kept")
    work.keep(kept)
    return kept.select("query_id", "rank", "evidence_id", "session_id", "score")


def _looked(asked: DataFrame, index: DenseIndex, most: int, first: int, last: int, digits: int, chunk: int) -> DataFrame:
    """The best ``most`` rows in each query's cells from the ``first`` to the ``last`` nearest, as far as a cell can reach its floor."""
    centres, radius, blocks = index.centres, index.radius, index.blocks
    slack = 10.0**-digits
    chunks = max(1, -(-asked.count() // chunk))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, floor = _matrix(b.column("vector")), b.column("floor").to_numpy()
            away = np.sqrt(np.maximum(0, 2 - 2 * q @ centres.T)) if q.size else np.zeros((len(q), len(centres)))
            order = np.argsort(away, axis=1, kind="stable")[:, first:last]
            least = np.maximum(0, np.take_along_axis(away, order, 1) - radius[order])
            can = (1 - least * least / 2 >= floor[:, None] - slack) & (blocks[order] > 0)
            to = [[{"cell": int(c), "blocks": int(blocks[c])} for c in o[x]] for o, x in zip(order, can, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.struct([("cell", pa.int32()), ("blocks", pa.int32())])))], names=[*b.schema.names, "to"])

    kind = dict(asked.dtypes)["query_id"]
    goes = asked.mapInArrow(sent, f"query_id {kind}, vector array<double>, floor double, to array<struct<cell int, blocks int>>")
    goes = goes.select("query_id", "vector", "floor", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), F.inline("to").alias("cell", "blocks"))
    goes = goes.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = index.rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    kinds = dict(index.rows.dtypes)
    names = ["query_id", "evidence_id", "session_id", "doc_idx", "score"]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, place = _matrix(left.column("vector")), left.column("doc_idx").to_numpy()
            for lo in range(0, right.num_rows, 512):
                b = right.slice(lo, 512)
                score = np.round(_matrix(b.column("vector")) @ x.T, digits)
                least = np.maximum(b.column("floor").to_numpy(), -np.partition(-score, min(most, len(x)) - 1, axis=1)[:, min(most, len(x)) - 1])
                at, row = np.nonzero(score >= least[:, None])
                order = np.lexsort((place[row], -score[at, row], at))
                at, row = at[order], row[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at) < most
                at, row = at[keep], row[keep]
                own = left.take(pa.array(row))
                out.append(pa.table([b.column("query_id").take(pa.array(at)), *(own.column(c) for c in names[1:4]), pa.array(score[at, row])], names=names))
        none = pa.table({c: pa.array([], left.schema.field(c).type if c in kinds else right.schema.field(c).type if c == "query_id" else pa.float64()) for c in names})
        return pa.concat_tables(out) if out else none

    keys = ["cell", "block", "chunk"]
    tiles = int(min(10_000, max(1, blocks.sum()) * chunks))
    met = rows.repartition(tiles, *keys).groupBy(*keys).cogroup(goes.repartition(tiles, *keys).groupBy(*keys)).applyInArrow(tile, f"query_id {kind}, " + ", ".join(f"{c} {kinds[c]}" for c in names[1:4]) + ", score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
