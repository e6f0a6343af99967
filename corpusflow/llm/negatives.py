"""Hard negatives by exact search in k-means inverted lists with stored radii."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read_table, staged

#: Centres are fitted on about this many rows, chosen by a hash of vec_id; all rows are indexed.
FIT_ROWS = 20_000
#: Lists are as many as a quarter of the root of the rows, up to this, so that centres stay small.
MOST_LISTS = 1024
#: Tasks that share one list while the index is built, so that a hot list is split.
SALTS = 16
#: Bytes of the vectors of one cell, the part of a list that is read at once.
CELL_BYTES = 1 << 16
#: Anchors that are sent to all tasks at a time.
ANCHORS = 16_384
#: Requests whose scores with a cell are in memory at a time.
STRIPE = 2048


@dataclass
class Requests:
    """What one pass looks for. Request i belongs to anchor `of[i]` and wants the k
    rows of the anchor's label (same) or of other labels (not same) that score
    from low[i] to high[i]; the anchor's own vec_id is never among them."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v (array<long>, floor(scale * x) of each component).

    Rows with a null id, label or vector, or a null or non-finite component, are
    left out. Other columns are dropped.
    """
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))


class Index:
    """Inverted lists over whole vectors, written once as cells.

    A row is in the list of its nearest centre. A list is stored in cells of a
    few hundred rows with the radius of each: the largest distance of its rows
    from the centre. Missing components count as 0. Exact copies of a row count
    once. Rows with a component so large that scores could pass 62 bits are
    left out.
    """

    def __init__(self, rows: DataFrame, seed: int = 1):
        size, most = F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, c: F.greatest(m, F.abs(c))))
        found = rows.agg(F.count("*").alias("n"), size.alias("d"), most.alias("m")).first()
        self.size = max(1, found.d or 0)
        self.limit = min(int((2**62 / self.size) ** 0.5), 2**31 - 1)
        # Products of floats are exact below 2^53.
        self.kind = "float64" if min(found.m or 0, self.limit) ** 2 * self.size < 2**53 else "int64"
        self.rows = rows.where(~F.exists("v", lambda c: F.abs(c) > self.limit)) if (found.m or 0) > self.limit else rows
        self.centres = self._fit(found.n, seed)
        self.cells = staged(self._built(), "negatives-cells")

    def _fit(self, n: int, seed: int) -> np.ndarray:
        every = max(1, -(-n // FIT_ROWS))
        some = self.rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(2 * FIT_ROWS)
        padded = F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), self.size)), 1, self.size)
        some = some.select(array_to_vector(padded.cast("array<double>")).alias("features"))
        lists = min(MOST_LISTS, max(1, round(n**0.5 / 4)))
        if some.isEmpty():
            return np.zeros((1, self.size))
        model = KMeans(k=max(2, lists), seed=seed, initMode="random", maxIter=8).fit(some)
        return np.array(model.clusterCenters(), "float64").reshape(-1, self.size)

    def _built(self) -> DataFrame:
        centres, size = self.centres, self.size
        most = max(16, CELL_BYTES // (4 * size))
        middle = (centres * centres).sum(axis=1)

        def assign(batches):
            for b in batches:
                x = dense(b.column(2), size)
                near = (middle - 2 * (x @ centres.T)).argmin(axis=1) if len(x) else np.zeros(0)
                raw = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.astype("int32")), b.column(0), b.column(1), raw], names=["list", "vec_id", "label", "raw"])

        def cut(batches):
            last, held = None, []
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if row == last:
                        continue
                    if held and (row[0] != last[0] or len(held) == most):
                        yield cell(last[0], held)
                        held = []
                    held.append(row[1:])
                    last = row
            if held:
                yield cell(last[0], held)

        def cell(at, held):
            x = np.frombuffer(b"".join(r[2] for r in held), "<i4").reshape(-1, size)
            far = float(np.sqrt(((x - centres[at]) ** 2).sum(axis=1).max()))
            ids, labels = (np.array([r[i] for r in held], "<i8").tobytes() for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([far]), pa.array([ids], pa.binary()), pa.array([labels], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["list", "radius", "ids", "labels", "vectors"])

        dealt = map_arrow(self.rows.select("vec_id", "label", "v"), assign, "list int, vec_id long, label long, raw binary")
        dealt = dealt.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).sortWithinPartitions("list", "vec_id", "label", "raw")
        return map_arrow(dealt, cut, "list int, radius double, ids binary, labels binary, vectors binary")

    def search(self, wanted: Requests) -> DataFrame:
        """request, vec_id, score: what each partition of the index has for each
        request, k rows at most; the k best of all partitions are the answer."""
        send = self.cells.sparkSession.sparkContext.broadcast((wanted, self.centres))
        size, kind = self.size, self.kind

        def run(batches):
            wanted, centres = send.value
            best = Best(wanted)
            for b in batches:
                if b.num_rows:
                    visit(best, b, centres, size, kind)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (best.request, best.ids, best.scores)], names=["request", "vec_id", "score"])

        return map_arrow(self.cells, run, "request long, vec_id long, score long")


class Best:
    """The k best rows so far of each request, by score and then smaller id."""

    def __init__(self, wanted: Requests):
        self.wanted = wanted
        self.request, self.ids, self.scores = (np.zeros(0, "int64") for _ in range(3))
        self.kth = np.full(len(wanted.of), -np.inf)

    def add(self, found: list[tuple]) -> None:
        request, ids, scores = (np.concatenate([old, *new]) for old, new in zip((self.request, self.ids, self.scores), zip(*found)))
        order = np.lexsort((ids, -scores, request))
        request = request[order]
        place = np.arange(len(request)) - np.searchsorted(request, request)
        keep = place < self.wanted.k
        self.request, self.ids, self.scores = request[keep], ids[order][keep], scores[order][keep]
        full = place[keep] == self.wanted.k - 1
        self.kth[self.request[full]] = self.scores[full]


def visit(best: Best, cells: pa.RecordBatch, centres: np.ndarray, size: int, kind: str) -> None:
    """Visit the cells of a batch. By Cauchy-Schwarz a row x of a cell with centre c
    and radius r scores within |q| r of q.c. Each anchor takes its cells by falling
    upper bound. A request ends at a bound strictly below its kth score or its
    window; it passes over cells that lie above its window."""
    w = best.wanted
    lists, radius = (cells.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    ids, labels, vectors = (cells.column(i).to_pylist() for i in (2, 3, 4))
    floats = w.vectors.astype("float64")
    middle = floats @ centres[lists].T
    reach = np.sqrt((floats * floats).sum(axis=1))[:, None] * radius[None, :]
    slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
    upper, lower = middle + reach + slack, middle - reach - slack
    order = np.argsort(-upper, axis=1, kind="stable")
    live = np.arange(len(w.of))
    for step in range(len(lists)):
        cell = order[w.of[live], step]
        goes_on = upper[w.of[live], cell] >= np.maximum(best.kth[live], w.low[live])
        live, cell = live[goes_on], cell[goes_on]
        if not len(live):
            return
        meets = lower[w.of[live], cell] <= w.high[live]
        asked, where = live[meets], cell[meets]
        by_cell = np.argsort(where, kind="stable")
        asked, where = asked[by_cell], where[by_cell]
        cuts = [0, *np.flatnonzero(np.diff(where)) + 1, len(where)]
        found = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            c = where[i]
            x = np.frombuffer(vectors[c], "<i4").reshape(-1, size).astype(kind)
            own, kinds = np.frombuffer(ids[c], "<i8"), np.frombuffer(labels[c], "<i8")
            for k in range(i, j, STRIPE):
                found.append(hits(best, asked[k : min(j, k + STRIPE)], x, own, kinds, kind))
        if found:
            best.add(found)


def hits(best: Best, asked: np.ndarray, x: np.ndarray, own: np.ndarray, kinds: np.ndarray, kind: str) -> tuple:
    """request, id, score of the rows of a cell that may be among the k best."""
    w = best.wanted
    anchors, back = np.unique(w.of[asked], return_inverse=True)
    scores = (w.vectors[anchors].astype(kind) @ x.T)[back].astype("int64")
    label = w.labels[w.of[asked]][:, None] == kinds[None, :]
    fits = (label if w.same else ~label) & (own[None, :] != w.ids[w.of[asked]][:, None])
    fits &= (scores >= w.low[asked][:, None]) & (scores <= w.high[asked][:, None]) & (scores >= best.kth[asked][:, None])
    if len(own) > w.k:
        shown = np.where(fits, scores, np.iinfo("int64").min)
        fits &= scores >= np.partition(shown, -w.k, axis=1)[:, -w.k][:, None]
    r, at = np.nonzero(fits)
    return asked[r], own[at], scores[r, at]


def dense(column: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as a matrix of doubles, short ones filled up with 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size)[None, :] < lengths[:, None]] = flat
    return out


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors have the columns of whole_vectors; an anchor is a row too.
    Its positives are the first `positives` other rows of its label by inner
    product, ties by vec_id. For each positive, its negatives are the first
    `negatives` rows of other labels with low * p <= 100 * score <= high * p for
    the positive's score p. The search is exact.

    Anchors go to the tasks in blocks of about `block`, each of which reads the
    index in place twice (once for positives, once for negatives); no vector is
    shuffled again after the index is built. Exact copies of a row count once; rows
    that share a vec_id but differ are rows of their own, and of such anchors
    the one of least label and vector counts. An anchor without other rows of its
    label or without rows in its window has no rows here, as has an empty table.
    """
    spark = rows.sparkSession
    index = Index(rows)
    own = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    own = own.where(~F.exists("v", lambda c: F.abs(c) > index.limit))
    own = staged(own, "negatives-anchors")
    blocks = max(1, -(-own.count() // block))
    out = None
    for i in range(blocks):
        some = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        found = _block(index, some, positives, negatives, low, high)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _block(index: Index, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    got = sorted(anchors.collect(), key=lambda r: r.vec_id)  # at most about a block
    vectors = np.array([[*r.v, *[0] * (index.size - len(r.v))] for r in got], "int64").reshape(-1, index.size)
    ids, labels = np.array([r.vec_id for r in got], "int64"), np.array([r.label for r in got], "int64")
    n = len(got)
    wanted = Requests(vectors, ids, labels, np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), True, positives)
    near = sorted(_first(index.search(wanted), positives).collect(), key=lambda r: (r.request, r.rank))  # so many per anchor
    of, p = np.array([r.request for r in near], "int64"), np.array([r.score for r in near], "int64")
    wanted = Requests(vectors, ids, labels, of, np.ceil(low * p / 100), np.floor(high * p / 100), False, negatives)
    asked = [(i, int(ids[r.request]), r.vec_id, r.score) for i, r in enumerate(near)]
    named = index.cells.sparkSession.createDataFrame(asked, "request long, anchor_id long, positive_id long, positive_score long")
    found = _first(index.search(wanted), negatives).join(F.broadcast(named), "request")
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    whole = whole_vectors(rows)
    return hard_negatives(whole, whole.where("vec_id % 100 = 0"))


OP11_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
