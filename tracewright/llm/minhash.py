"""MinHash near-dedup with HyperMinHash sketches.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; words are runs of anything
but the blanks x20 and x09-x0D; fewer than 5 words make one shingle).  Two documents are linked
if the sets' Jaccard similarity is 0.75 or more, and a component is what links connect.

1. One pass makes for each document the size and a 128-bit digest of its set and a HyperMinHash
   sketch: of the least hash in each of 256 buckets, the count of leading zeros and ten mantissa
   bits, 512 bytes in all whatever the text's length; and a key of 32 bits for each band.
2. Documents of one digest are copies; from here on only the least id of each such class counts.
3. Five buckets each make 52 bands (the last shares four with the one before it, so
   that all 256 are in a band).  A band's key is of the whole least hashes, not of the registers: most bands of a set of few
   shingles hold one of them, and registers of about twelve bits would bring together sets that share nothing, the more the more documents there are.  Of large sets a pair at the threshold shares no band with a chance
   of (1 - 0.75^5)^51, about 1e-6, and a pair above it with less.  Sets of few shingles leave most
   registers empty, and two sets could differ in just the bands that they fill; so sets of up to
   ``exact`` shingles, and those that can be linked with one, also have a bucket for each of their
   least hashes, as many as two linked sets cannot miss each other by.  That makes candidates of small sets complete.
4. In each band bucket every member is compared with the member that shares most bands with
   others (in a family of copies with edits that is the original), not with every other one.
   Estimated Jaccard, corrected for chance collisions of registers, drops pairs that are six
   standard deviations below the threshold; the rest are confirmed on the full sets.
5. A bucket whose members are now in one component is done.  In small ones the few leftover
   pairs are confirmed as before.  In the others, a member can have a link into another component only if enough of its shingles occur in another component; that
   count is a shingle aggregation, and it rules out almost all members exactly.  The remaining
   rows outside a family's main component are compared with the family's rows in blocks.

Nothing is capped and no bucket is dropped.  Buckets are aggregated and joined, never gathered.

Defined results: null and empty texts (no words) have 0 shingles and are their own component; an
empty table gives none; repeated rows come back as often as they came; a document id that comes
with several texts counts as one document with all of them; a null id keeps a null component; a
text of any length is one row of one task; columns other than doc_id and text are ignored,
whatever their names.  Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns
from ._text import LOWER, Slice, gram_hashes, mix, signed, span_hashes, spans, text_slices
from ._work import Work
from .graph import components

_U = np.uint64
REGISTERS = 256
MANTISSA = 10
EMPTY = 0xFFFF
NONE = 1 << 52


@dataclass(frozen=True)
class NearParams:
    """``small`` is the most rows whose ids are broadcast; beyond it the join is shuffled;
    in buckets of up to ``small_bucket`` members all leftover pairs are listed; ``block`` is about how many shingles one side of a block of the last step holds;
    a pair whose smaller set has at most ``exact`` shingles is found for certain."""

    words: int = 5
    percent: int = 75
    band_rows: int = 5
    sigmas: float = 6.0
    small: int = 1_000_000
    block: int = 100_000
    small_bucket: int = 16
    exact: int = 32


SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("regs", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("least", T.BinaryType())]


def shingle_sets(part: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their bounds."""
    low = LOWER[part.data]
    w = spans(Slice(part.first, low, part.offsets))
    h = span_hashes(low, w.start, w.end)
    g, at = gram_hashes(h, w.bounds, k)
    owner = np.searchsorted(w.bounds, at, "right") - 1
    n = w.counts()
    for j in range(1, k):
        short = np.flatnonzero(n == j)
        if len(short):
            gj, atj = gram_hashes(h, w.bounds, j)
            sel = np.searchsorted(atj, w.bounds[short])
            g, owner = np.append(g, gj[sel] + _U(j)), np.append(owner, short)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(part) + 1))


def _span_sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def minima(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row for each document: the least of the upper 52 bits in each bucket; 1 << 52 in an empty one."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    least = np.full(n * REGISTERS, NONE, np.int64)
    np.minimum.at(least, owner * REGISTERS + (g & _U(REGISTERS - 1)).astype(np.int64), (g >> _U(12)).astype(np.int64))
    return least.reshape(n, REGISTERS)


def registers(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of 16-bit registers for each document: leading zeros, then mantissa bits."""
    return _short(minima(g, bounds))


def _short(least: np.ndarray) -> np.ndarray:
    m, e = np.frexp(least.astype(np.float64))
    cell = np.clip((m * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
    return np.where(least == NONE, EMPTY, ((52 - e) << MANTISSA) | cell).astype(np.uint16)


def _starts(p: NearParams) -> np.ndarray:
    return np.unique([*range(0, REGISTERS - p.band_rows + 1, p.band_rows), REGISTERS - p.band_rows])


def band_keys(least: np.ndarray, p: NearParams) -> np.ndarray:
    """One row of 32-bit keys for each document, 0 for a band without a hash."""
    starts = _starts(p)
    key, full = np.zeros((len(least), len(starts)), np.uint64), np.zeros((len(least), len(starts)), bool)
    for i in range(p.band_rows):
        x = least[:, starts + i]
        key = mix(key + x.astype(np.uint64) + _U(1))
        full |= x != NONE
    return np.where(full, np.maximum(key >> _U(32), _U(1)), _U(0)).astype(np.uint32)


def least_hashes(g: np.ndarray, bounds: np.ndarray, p: NearParams) -> list[bytes]:
    """Of each set that can be linked with one of ``exact`` shingles or fewer, the n - ceil(n x
    percent / 100) + 1 least hashes: two linked sets have one of these in common."""
    n = np.diff(bounds)
    many = np.where(n * p.percent <= p.exact * 100, n - -(-n * p.percent // 100) + 1, 0)
    return [g[a : a + k].tobytes() for a, k in zip(bounds[:-1], np.minimum(many, n), strict=True)]


def sketches(documents: DataFrame, p: NearParams) -> DataFrame:
    def batch(texts: pa.Array) -> list:
        out: list[list] = [[], [], [], [], [], []]
        for s in text_slices(texts):
            g, b = shingle_sets(s, p.words)
            low = minima(g, b)
            out[0].append(np.diff(b))
            out[1].append(signed(_span_sums(mix(g ^ _U(0xA5A5A5A5A5A5A5A5)), b)))
            out[2].append(signed(_span_sums(mix(g ^ _U(0x5BD1E9955BD1E995)), b)))
            out[3] += [r.tobytes() for r in _short(low)]
            out[4] += [k.tobytes() for k in band_keys(low, p)]
            out[5] += least_hashes(g, b, p)
        return [*(np.concatenate(x) if x else [] for x in out[:3]), *out[3:]]

    return append_columns(documents, "text", SKETCH, lambda: batch, drop_text=True)


def _regs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), REGISTERS)


def bands(sketched: DataFrame, p: NearParams) -> DataFrame:
    """``(bucket, id)``: a row for each band that has a hash, and for each least hash of small sets."""
    n_bands = len(_starts(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                key = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint32).reshape(len(b), n_bands)
                full = key > 0
                bucket = mix(key.astype(np.uint64) + np.arange(n_bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
                least = b.column("least").to_pylist()
                own = b.column("id").to_numpy(zero_copy_only=False)
                keys = np.concatenate([bucket[full], mix(np.frombuffer(b"".join(least), np.uint64) + _U(n_bands))])
                ids = np.concatenate([np.repeat(own, full.sum(1)), np.repeat(own, [len(x) // 8 for x in least])])
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(ids)], names=["bucket", "id"])

    return sketched.select("id", "keys", "least").mapInArrow(run, "bucket long, id long")


def estimated_jaccard(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard from equal registers less those expected to be equal by chance; and the registers
    in use, which give the estimate's spread."""
    used = ((x != EMPTY) | (y != EMPTY)).sum(1).astype(float)
    same = ((x == y) & (x != EMPTY)).sum(1)
    a, b = nx / REGISTERS, ny / REGISTERS
    top = 2.0 ** -np.arange(53)
    low = top / 2
    cell = low / (1 << MANTISSA)
    ab = (a + b)[:, None]
    chance = ((a * b)[:, None] / ab * cell * (np.exp(-ab * low) - np.exp(-ab * top))).sum(1)
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0, 1), used


def _estimate(p: NearParams):
    floor = p.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                j, used = estimated_jaccard(_regs(b.column("ra")), _regs(b.column("rb")), b.column("na").to_numpy(), b.column("nb").to_numpy())
                ok = j >= floor - p.sigmas * np.sqrt(floor * (1 - floor) / np.maximum(used, 1))
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirm(p: NearParams):
    """Keep the pairs whose full sets are similar enough; sets are kept while a side repeats."""

    def sets_of(texts: list[str]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        distinct = list(dict.fromkeys(texts))
        for s in text_slices(pa.array(distinct, pa.large_string())):
            g, b = shingle_sets(s, p.words)
            out |= {distinct[s.first + i]: g[b[i] : b[i + 1]] for i in range(len(s))}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ta, tb = b.column("ta").to_pylist(), b.column("tb").to_pylist()
                sets = sets_of([*ta, *tb])
                ok = []
                for x, y in zip(ta, tb, strict=True):
                    x, y = sets[x], sets[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= p.percent * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _block_links(percent: int, width: int = 4096):
    """Of two blocks of sets, links between rows of different components: for each row of the
    first one link into each component of the second that it is linked with."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if x.empty or y.empty:
            return none
        sides = []
        for f in (x, y):
            g = [np.frombuffer(v, np.uint64) for v in f["grams"]]
            n = np.array([len(v) for v in g])
            sides.append((np.concatenate(g), np.repeat(np.arange(len(g)), n), n))
        (gx, rx, nx), (gy, ry, ny) = sides
        vocabulary = np.intersect1d(gx, gy)
        both = np.zeros((len(nx), len(ny)), np.float32)
        cx, cy = np.searchsorted(vocabulary, gx), np.searchsorted(vocabulary, gy)
        inx, iny = vocabulary.take(cx, mode="clip") == gx, vocabulary.take(cy, mode="clip") == gy
        rx, cx, ry, cy = rx[inx], cx[inx], ry[iny], cy[iny]
        ox, oy = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
        rx, cx, ry, cy = rx[ox], cx[ox], ry[oy], cy[oy]
        for lo in range(0, len(vocabulary), width):
            m = []
            for r, c, rows in ((rx, cx, len(nx)), (ry, cy, len(ny))):
                s, e = np.searchsorted(c, [lo, lo + width])
                dense = np.zeros((rows, width), np.float32)
                dense[r[s:e], c[s:e] - lo] = 1
                m.append(dense)
            both += m[0] @ m[1].T
        linked = 100 * both >= percent * (nx[:, None] + ny[None, :] - both)
        i, j = np.nonzero(linked & (x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]))
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "i": i, "c": y["comp"].to_numpy()[j]}).drop_duplicates(["i", "c"])[["a", "b"]] if len(i) else none

    return run


class _Search:
    """The tables of one run."""

    def __init__(self, work: Work, documents: DataFrame, sketch: DataFrame, p: NearParams) -> None:
        self.work, self.documents, self.sketch, self.p = work, documents, sketch, p

    def few(self, ids: DataFrame) -> DataFrame:
        """Broadcast a list of ids only if it is short enough."""
        return F.broadcast(ids) if ids.count() <= self.p.small else ids

    def texts(self, ids: DataFrame) -> DataFrame:
        """Texts of the given ids, written down: the documents are scanned once for them."""
        need = self.work.table(ids.distinct(), "need")
        return self.work.table(self.documents.select(F.col("doc_id").alias("id"), "text").join(self.few(need), "id", "left_semi"), "texts")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs(a, b)``: sizes, then sketches, then full sets."""
        s = self.sketch
        left = s.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
        right = s.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
        sized = pairs.join(left, "a").join(right, "b").where(F.col("na") * 100 >= F.col("nb") * self.p.percent).where(F.col("nb") * 100 >= F.col("na") * self.p.percent)
        likely = self.work.table(sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimate(self.p), "a long, b long").distinct(), "likely")
        t = self.texts(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))))
        both = likely.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        links = self.work.table(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(self.p), "a long, b long").distinct(), "links")
        self.work.drop(t)
        return links

    def ranked(self, shared: DataFrame) -> DataFrame:
        """``(bucket, id, n, n_shingles, pop)``: ``pop`` sums the sizes of the member's buckets."""
        popular = shared.groupBy("id").agg(F.sum("n").alias("pop")).join(self.sketch.select("id", "n_shingles").distinct(), "id")
        return self.work.table(shared.join(popular, "id"), "ranked")

    def stars(self, ranked: DataFrame) -> DataFrame:
        """In each bucket every member with the one that shares most buckets, unless their sizes
        rule a link out: ``(a, b)``."""
        pc = self.p.percent
        best = F.max_by(F.struct(F.col("id").alias("leader"), F.col("n_shingles").alias("nl")), F.struct("pop", "id"))
        leaders = self.work.table(ranked.groupBy("bucket").agg(best.alias("l")).select("bucket", "l.*"), "leaders")
        size = F.col("n_shingles")
        met = ranked.join(leaders, "bucket").where((F.col("id") != F.col("leader")) & (size * 100 >= F.col("nl") * pc) & (F.col("nl") * 100 >= size * pc))
        return met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()

    def open_buckets(self, ranked: DataFrame, comp: DataFrame) -> DataFrame:
        """The rows of buckets that still hold several components, less those of two members."""
        mine = ranked.where("n > 2").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        spread = mine.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n_shingles").alias("least")).where("lo != hi")
        return self.work.table(mine.join(spread.select("bucket", "least"), "bucket"), "open")

    def leftover_pairs(self, open_: DataFrame, met: DataFrame) -> DataFrame:
        """The pairs of small buckets that have not met: at most ``small_bucket`` for each row."""
        pc = self.p.percent
        x = open_.where(F.col("n") <= self.p.small_bucket)
        y = x.select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n_shingles").alias("nb"))
        pairs = x.join(y, "bucket").where("id < b AND comp != cb").where(F.col("n_shingles") * 100 >= F.col("nb") * pc).where(F.col("nb") * 100 >= F.col("n_shingles") * pc)
        return self.work.table(pairs.select(F.col("id").alias("a"), "b").distinct().join(met, ["a", "b"], "left_anti"), "pairs")

    def across(self, open_: DataFrame) -> DataFrame:
        """Links between members of one larger bucket that are in different components."""
        open_ = open_.where(F.col("n") > self.p.small_bucket)
        # how many shingles of a member occur in some other component
        people = open_.groupBy("id", "comp", "n_shingles").agg(F.min("least").alias("least"))
        t = self.texts(people.select("id"))
        words = self.p.words

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, comps = b.column("id").to_numpy(), b.column("comp").to_numpy()
                for s in text_slices(b.column("text")):
                    g, at = shingle_sets(s, words)
                    own = s.first + np.repeat(np.arange(len(s)), np.diff(at))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(ids[own]), pa.array(comps[own])], names=["g", "id", "comp"])

        grams = people.select("id", "comp").join(t, "id").mapInArrow(explode, "g long, id long, comp long")
        common = grams.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("g")
        support = grams.join(common, "g").groupBy("id").agg(F.count("*").alias("s"))
        pc = self.p.percent
        # a partner has at least this many shingles: the least of the buckets, and the size rule
        partner = F.greatest("least", F.ceil(F.col("n_shingles") * pc / 100), "s")
        able = people.join(support, "id").where(F.col("s") * 100 >= pc * (F.col("n_shingles") + partner - F.col("s"))).select("id")
        live = self.work.table(open_.drop("least").join(able, "id", "left_semi"), "live")
        return self.between(live, t)

    def between(self, live: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between components: ``(a, b)``, at least one for each two that have any.

        Members that share a bucket, directly or through others, are a family.  In each family
        the rows outside its main component are laid against all rows, in blocks of bounded size
        that are dealt evenly; a block counts common shingles as a matrix product and gives links
        only, so that no list of pairs comes into being however large a family is.
        """
        hub = live.groupBy("bucket").agg(F.min("id").alias("hub"))
        family = components(self.work, live.join(hub, "bucket").select(F.col("id").alias("a"), F.col("hub").alias("b")))
        rows = live.select("id", "comp", "n_shingles").distinct().join(family.select("id", F.col("comp").alias("family")), "id")
        rows = self.work.table(rows, "rows")
        weight = rows.groupBy("family", "comp").agg(F.sum(F.col("n_shingles") + 64).alias("w"))  # rows cost, too
        size = weight.groupBy("family").agg(F.max_by("comp", F.struct("w", "comp")).alias("main"), F.sum("w").alias("all"), (F.sum("w") - F.max("w")).alias("rest"), F.count("*").alias("k")).where("k > 1")
        blocks = lambda w: F.ceil(F.col(w) / self.p.block).cast("int")
        dealt = rows.join(size, "family").withColumns({"ni": blocks("rest"), "nj": blocks("all")})
        words = self.p.words

        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in text_slices(b.column("text")):
                    g, at = shingle_sets(s, words)
                    part = b.slice(s.first, len(s)).select(["family", "id", "comp", "main", "ni", "nj"])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[at[i] : at[i + 1]].tobytes() for i in range(len(s))], pa.binary())], names=[*part.schema.names, "grams"])

        sets = self.work.table(dealt.join(texts, "id").mapInArrow(to_sets, "family long, id long, comp long, main long, ni int, nj int, grams binary"), "sets")
        of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        query = sets.where("comp != main").select("family", of("ni").alias("i"), upto("nj").alias("j"), "id", "comp", "grams")
        data = sets.select("family", upto("ni").alias("i"), of("nj").alias("j"), "id", "comp", "grams")
        keys = ["family", "i", "j"]
        return query.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_block_links(self.p.percent), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``documents``."""
    p = params
    spark = documents.sparkSession
    work = Work(spark, "near")
    documents = documents.select("doc_id", "text")
    rows = work.table(sketches(documents, p), "sketch")
    copies = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = work.table(copies, "classes")
    reps = rows.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "regs", "keys", "least")
    sketch = work.table(reps, "reps")
    slim = work.table(rows.select("doc_id", "n_shingles", "d1", "d2"), "slim")
    work.drop(rows)
    banded = bands(sketch, p)
    many = work.table(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "many")
    shared = work.table(banded.join(many, "bucket").distinct(), "shared")
    search = _Search(work, documents, sketch, p)
    ranked = search.ranked(shared)
    work.drop(shared)
    first = work.table(search.stars(ranked), "pairs")
    links = search.confirmed(first)
    comp = work.table(components(work, links), "comp")
    still = search.open_buckets(ranked, comp)
    if not still.isEmpty():
        more = search.confirmed(search.leftover_pairs(still, first)).unionByName(work.table(search.across(still), "across"))
        if not more.isEmpty():  # the components so far are stars already
            comp = work.table(components(work, comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more)), "comp")
    work.keep(slim, classes, comp)
    named = slim.join(classes, ["d1", "d2"], "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("comp", "rep")).otherwise(F.col("doc_id")))
    return named.select("doc_id", "n_shingles", group.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
