"""Hard-negative mining with cover trees over norm-augmented vectors.

A candidate x becomes (x, sqrt(M^2 - |x|^2)), M the largest norm: all candidates then lie on one sphere, and a
ball around c with radius R bounds the inner product of an anchor q with all that it covers: <q, c> - |q| R
to <q, c> + |q| R.

The top level of the tree is made on the driver, by farthest-first order, from ``sample`` rows: at most ``cells``
centres.  Every row joins its nearest centre; a cell's covering radius is measured over all
its rows.  A cell of more than ``block`` rows is dealt over several blocks by id, so that no
cell, nor a vector that a third of the rows share, fills a task.  In a task, a block's rows get the lower levels: farthest-first
order again, each level being the centres that were at least half as far apart as those of the level above, each
centre a child of the nearest one above it, with its own covering radius; leaves hold about ``leaf`` rows.

Anchors are dealt in chunks of ``chunk``, and go to the blocks of those cells whose bounds can meet them.  In a
block they descend best-first: level by level nodes are left out whose bound is under the anchor's k-th
best score so far, or outside of all its windows; leaves come in the order of their bounds, and their rows are
verified exactly.  The scores in the sample give each anchor its first k-th best.  Blocks' results are merged by anchor.

Searches come in two kinds: the ``positives`` best rows of the anchor's own label, then, in
the window of scores that each positive sets, the ``negatives`` best rows of other labels.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no
part; exact repeats of a row count once; rows of one id with other labels or vectors are rows of
their own, never "other rows" to each other; shorter vectors are filled up with zeros; equal scores come by
smaller id; scaled components beyond +-2^28 count as that; a positive without rows in its window gives no
row, and so does one with a negative score, whose window is empty; empty tables give none; columns other
than vec_id, embedding and label are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import bounded_batches
from ._work import Work

_LOW = np.iinfo(np.int64).min


@dataclass(frozen=True)
class MiningParams:
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    sample: int = 2048
    cells: int = 256
    block: int = 8192
    chunk: int = 16_384
    leaf: int = 256


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _norms(v: np.ndarray) -> np.ndarray:
    f = v.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", f, f))


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    f = v.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", f, f)))])


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products; floats hold them wherever they are under 2^53."""
    if most * most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def farthest_first(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(chosen, gaps, owner)``: up to ``n`` rows, each the farthest from those before it, the distance that
    it had then, and for each row the place of its nearest chosen one.  Equal rows are never both chosen."""
    chosen, gaps = [0], [np.inf]
    dist, owner = np.linalg.norm(x - x[0], axis=1), np.zeros(len(x), np.int64)
    while len(chosen) < n:
        far = int(np.argmax(dist))
        if dist[far] <= 1e-9:
            break
        chosen.append(far)
        gaps.append(float(dist[far]))
        new = np.linalg.norm(x - x[far], axis=1)
        near = new < dist
        dist[near], owner[near] = new[near], len(chosen) - 1
    return np.array(chosen), np.array(gaps), owner


@dataclass
class CoverTree:
    """``levels``: from the root down, ``(nodes, parent, radius)``: places of centres, the place of each one's parent in
    the level above, and covering radii; ``leaves``: the rows of each centre of the last level."""

    centres: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    leaves: list[np.ndarray]

    @classmethod
    def build(cls, x: np.ndarray, leaf: int) -> CoverTree:
        chosen, gaps, owner = farthest_first(x, max(1, -(-len(x) // leaf)))
        k = len(chosen)
        # a level has the centres that were at least so far apart: the order is one of nested nets
        sizes, scale = [1], gaps[1] if k > 1 else 0.0
        while sizes[-1] < k:
            scale /= 2
            size = int((gaps >= scale).sum())
            if size > sizes[-1]:
                sizes.append(size)
        c = x[chosen]
        levels, above = [], np.zeros(1, np.int64)
        line = [above]  # by level: each centre's parent
        for prev, size in zip(sizes, sizes[1:], strict=False):
            up = np.arange(size)
            if size > prev:
                d = np.linalg.norm(c[prev:size, None] - c[None, :prev], axis=2)
                up[prev:] = d.argmin(axis=1)
            line.append(up)
        at = owner  # each row's centre in the level that is being measured
        for size, up in zip(reversed(sizes), reversed(line), strict=True):
            radius = np.zeros(size)
            np.maximum.at(radius, at, np.linalg.norm(x - c[at], axis=1))
            levels.append((np.arange(size), up, radius))
            at = up[at]
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(k + 1))
        return cls(c, levels[::-1], [order[bounds[i] : bounds[i + 1]] for i in range(k)])


class Best:
    """The best ``k`` (score falling, id rising) for each anchor and window, and what still can enter."""

    def __init__(self, seeds: np.ndarray, k: int) -> None:
        self.seeds, self.k = seeds, k  # (anchors, windows): scores under these cannot enter
        self.floor = seeds.copy()
        none = np.zeros(0, np.int64)
        self.at, self.score, self.id = none, none, none

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        at, score, ids = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.score, self.id = at[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        floor = self.floor.reshape(-1)
        floor[self.at[full]] = np.maximum(floor[self.at[full]], self.score[full])


def search(tree: CoverTree, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, windows: tuple[np.ndarray, np.ndarray], seeds: np.ndarray, k: int, same: bool, most: float) -> Best:
    """Best-first descent of all anchors ``q`` in one block's tree.  ``windows``: (anchors, windows) least and most scores."""
    best, n = Best(seeds, k), len(q)
    low, high = windows
    norm, flat = _norms(q), q.astype(np.float64)
    dots = flat @ tree.centres[:, :-1].T
    slack = 1e-6 * (1 + norm * most)

    def open_nodes(radius: np.ndarray, at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upper = dots[at][:, : len(radius)] + norm[at, None] * radius + slack[at, None]
        lower = upper - 2 * (norm[at, None] * radius + slack[at, None])
        can = np.zeros(upper.shape, bool)
        for w in range(low.shape[1]):
            can |= (upper >= np.maximum(best.floor[at, w], low[at, w])[:, None]) & (lower <= high[at, w][:, None]) & (low[at, w] <= high[at, w])[:, None]
        return can, upper

    every, alive, upper = slice(0, n), np.ones((n, 1), bool), None
    for _, parent, radius in tree.levels:
        can, upper = open_nodes(radius, every)
        alive = alive[:, parent] & can
    order = np.argsort(np.where(alive, -upper, np.inf), axis=1, kind="stable")
    radius, count = tree.levels[-1][2], alive.sum(axis=1)
    for turn in range(order.shape[1]):
        todo = np.flatnonzero(count > turn)
        if not len(todo):
            break
        leaf = order[todo, turn]
        can, _ = open_nodes(radius, todo)  # floors have risen since
        go = can[np.arange(len(todo)), leaf]
        todo, leaf = todo[go], leaf[go]
        found = []
        for x in np.unique(leaf):
            own, rows = todo[leaf == x], tree.leaves[x]
            score = products(q[own], v[rows], most)
            fits = (labels[rows] == q_labels[own, None]) == same
            fits &= ids[rows] != q_ids[own, None]
            for w in range(low.shape[1]):
                least = np.maximum(low[own, w], best.floor[own, w])
                a, r = np.nonzero(fits & (score >= least[:, None]) & (score <= high[own, w][:, None]))
                found.append((own[a] * low.shape[1] + w, score[a, r], ids[rows[r]]))
        if found:
            best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))
    return best


def _distinct(v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The first of each group of equal rows; equal rows have equal ids."""
    order = np.argsort(ids, kind="stable")
    seen, keep = {}, []
    same = np.zeros(len(ids), bool)
    same[1:] = ids[order][1:] == ids[order][:-1]
    again = same | np.append(same[1:], False)
    keep = list(order[~again])
    for i in order[again]:
        if seen.setdefault((int(ids[i]), int(labels[i]), v[i].tobytes()), i) == i:
            keep.append(i)
    return np.sort(np.array(keep, np.int64))


def scaled(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, v)``: the rows that take part, components as integers."""
    e = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    e = e.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    most = float(1 << 28)
    v = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256).cast("double"), F.lit(most)), F.lit(-most)).cast("int"))
    return e.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


class Index:
    """The top level of the tree, and all rows in blocks by it."""

    def __init__(self, rows: DataFrame, p: MiningParams) -> None:
        self.p, self.work = p, Work(rows.sparkSession, "negatives")
        bounded_batches(rows.sparkSession)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("least"), F.max(square).alias("most")).first()
        self.n, self.dim = facts.n, max(1, facts.dim or 1)
        self.most = float(np.sqrt(facts.most or 0.0)) + 1e-6
        if facts.n and facts.least < self.dim:
            rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(self.dim) - F.size("v"))))
        self.empty = not facts.n
        if self.empty:
            return
        few = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(p.sample).toArrow()
        v, ids, labels = _matrix(few.column("v").combine_chunks(), self.dim), few.column("vec_id").to_numpy(), few.column("label").to_numpy()
        one = _distinct(v, ids, labels)
        self.sample = v[one], ids[one], labels[one]
        x = augmented(self.sample[0], self.most)
        self.centres = x[farthest_first(x, min(p.cells, -(-self.n // p.block)))[0]]
        placed = self.work.table(self._placed(rows), "placed")
        self.cells = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}  # at most p.cells
        self.blocks = {c: -(-n // p.block) for c, (n, _) in self.cells.items()}
        deal = rows.sparkSession.createDataFrame(list(self.blocks.items()), "cell int, blocks int")
        self.deal = F.broadcast(deal)  # at most p.cells rows
        self.rows = placed.join(self.deal, "cell").select("vec_id", "label", "v", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
        self.placed = placed

    def _placed(self, rows: DataFrame) -> DataFrame:
        centres, most, dim = self.centres, self.most, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 4096):
                    b = whole.slice(lo, 4096)
                    x = augmented(_matrix(b.column("v"), dim), most)
                    d = np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T)
                    cell = d.argmin(axis=1)
                    exact = np.linalg.norm(x - centres[cell], axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(exact)], names=[*b.schema.names, "cell", "d"])

        return rows.mapInArrow(run, "vec_id long, label long, v array<int>, cell int, d double")

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """``(anchor_id, row, w, rank, score, vec_id)`` of the best ``k`` rows in each window ``w`` of each anchor
        ``(anchor_id, row, label, v, low, high)``; ``low`` and ``high`` are arrays, as long as each other."""
        p, dim, most = self.p, self.dim, self.most
        chunks = max(1, -(-anchors.count() // p.chunk))
        cells = sorted(self.cells)
        radius, centres, sample = np.array([self.cells[c][1] for c in cells]), self.centres[cells], self.sample

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    b = whole.slice(lo, 512)
                    q, q_ids, q_labels, low, high = _anchors(b, dim)
                    seeds = _seeds(sample, q, q_ids, q_labels, low, high, k, same, most)
                    norm = _norms(q)
                    slack = 1e-6 * (1 + norm * most)
                    reach = norm[:, None] * radius + slack[:, None]
                    mid = q.astype(np.float64) @ centres[:, :-1].T
                    can = np.zeros(mid.shape, bool)
                    for w in range(low.shape[1]):
                        can |= (mid + reach >= np.maximum(seeds[:, w], low[:, w])[:, None]) & (mid - reach <= high[:, w][:, None]) & (low[:, w] <= high[:, w])[:, None]
                    out = pa.Table.from_batches([b]).append_column("seeds", pa.array(list(seeds), pa.list_(pa.int64()))).append_column("cells", pa.array([[cells[c] for c in np.flatnonzero(x)] for x in can], pa.list_(pa.int32())))
                    yield from out.to_batches()

        kinds = "anchor_id long, row long, label long, v array<int>, low array<long>, high array<long>"
        goes = anchors.mapInArrow(sent, f"{kinds}, seeds array<long>, cells array<int>")
        chunk = F.pmod(F.xxhash64("anchor_id", F.lit(3)), F.lit(chunks)).cast("int").alias("chunk")
        goes = goes.select("*", F.explode("cells").alias("cell")).drop("cells").join(self.deal, "cell")
        goes = goes.select("*", chunk, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        rows = self.rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        tiles, keys = min(10_000, sum(self.blocks.values()) * chunks), ["cell", "block", "chunk"]

        def tile(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                v, ids, labels = _matrix(left.column("v").combine_chunks(), dim), left.column("vec_id").to_numpy(), left.column("label").to_numpy()
                one = _distinct(v, ids, labels)
                v, ids, labels = v[one], ids[one], labels[one]
                tree = CoverTree.build(augmented(v, most), p.leaf)
                for lo in range(0, right.num_rows, 1024):
                    b = right.slice(lo, 1024).combine_chunks()
                    q, q_ids, q_labels, low, high = _anchors(b, dim)
                    found = search(tree, v, ids, labels, q, q_ids, q_labels, (low, high), np.array(b.column("seeds").to_pylist(), np.int64).reshape(low.shape), k, same, most)
                    at, w = np.divmod(found.at, low.shape[1])
                    out.append((q_ids[at], b.column("row").to_numpy()[at], w, found.score, found.id))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["anchor_id", "row", "w", "score", "vec_id"])

        met = rows.repartition(tiles, *keys).groupBy(*keys).cogroup(goes.repartition(tiles, *keys).groupBy(*keys)).applyInArrow(tile, "anchor_id long, row long, w int, score long, vec_id long")
        order = Window.partitionBy("anchor_id", "row", "w").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _anchors(b, dim: int) -> tuple[np.ndarray, ...]:
    col = lambda c: b.column(c).combine_chunks() if isinstance(b.column(c), pa.ChunkedArray) else b.column(c)
    n = b.num_rows
    bounds = [np.array(col(c).to_pylist(), np.int64).reshape(n, -1) for c in ("low", "high")]
    return _matrix(col("v"), dim), col("anchor_id").to_numpy(), col("label").to_numpy(), *bounds


def _seeds(sample: tuple[np.ndarray, ...], q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, most: float) -> np.ndarray:
    """For each anchor and window, the k-th best score among the sample's rows; the k-th best of all is no less."""
    v, ids, labels = sample
    score = products(q, v, most)
    fits = ((labels == q_labels[:, None]) == same) & (ids != q_ids[:, None])
    out = np.full(low.shape, _LOW, np.int64)
    if len(v) >= k:
        for w in range(low.shape[1]):
            inside = np.where(fits & (score >= low[:, w, None]) & (score <= high[:, w, None]), score, _LOW)
            out[:, w] = np.partition(inside, len(v) - k, axis=1)[:, len(v) - k]
    return out


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(embeddings: DataFrame, params: MiningParams = MiningParams(), anchors_every: int = 50) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    p, spark = params, embeddings.sparkSession
    index = Index(scaled(embeddings), p)
    if index.empty:
        return spark.createDataFrame([], _OUT)
    every = F.array(F.lit(_LOW + 1).cast("long")), F.array(F.lit(-_LOW - 1).cast("long"))
    anchors = index.placed.where(F.col("vec_id") % anchors_every == 0).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("row"), "label", "v").distinct()
    anchors = index.work.table(anchors, "anchors")
    pos = index.best(anchors.select("*", every[0].alias("low"), every[1].alias("high")), p.positives, True)
    pos = index.work.table(pos.select("anchor_id", "row", "rank", "score", "vec_id"), "positives")
    # n is inside where low * s <= 100 n <= high * s
    low, high = F.expr(f"-((-score * {p.low} - pmod(-score * {p.low}, 100)) div 100)"), F.expr(f"(score * {p.high} - pmod(score * {p.high}, 100)) div 100")
    bounds = pos.groupBy("anchor_id", "row").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("b"))
    # as many windows for each anchor: what is not there is an empty one
    fill = lambda c, x: F.transform(F.sequence(F.lit(0), F.lit(p.positives - 1)), lambda i: F.coalesce(F.get("b", i)[c], F.lit(x).cast("long")))
    asked = anchors.join(bounds, ["anchor_id", "row"]).select("anchor_id", "row", "label", "v", fill("low", 1).alias("low"), fill("high", 0).alias("high"))
    neg = index.best(index.work.table(asked, "asked"), p.negatives, False)
    each = pos.select("anchor_id", "row", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = neg.join(each, ["anchor_id", "row", "w"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
