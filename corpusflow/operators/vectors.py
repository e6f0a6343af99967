"""Dense search: exact in blocks of queries, and a stored product-quantised index."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import staged
from ..sources import files, versions

#: Bytes of query vectors that go to all tasks at a time.
BLOCK_BYTES = 16 << 20
#: Queries whose scores with a batch are in memory at a time.
STRIPE = 512
#: Rows of vectors that are scored at a time.
ROWS = 8192
#: Best rows, of all queries of a block, that a search by codes keeps, and rows
#: that it hands on at a time.
HELD, HANDED = 200_000, 50_000


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Arrow lists as rows of doubles; an error where a length isn't `size`."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != size).any():
        raise ValueError("a vector has another length")
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a row of zeros stays."""
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


class Nearest:
    """The n best rows so far of each query: higher scores first, then smaller keys."""

    def __init__(self, queries: int, n: int):
        self.n = n
        self.query, self.keys, self.scores = np.zeros(0, "int64"), None, np.zeros(0)
        self.nth = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, keys: np.ndarray, first: int) -> None:
        """scores of the queries from `first` on (rows) with keys (columns)."""
        some = scores >= self.nth[first : first + len(scores), None]
        if scores.shape[1] > self.n:
            some &= scores >= np.partition(scores, -self.n, axis=1)[:, -self.n][:, None]
        q, at = np.nonzero(some)
        if not len(q):
            return
        query = np.concatenate([self.query, q + first])
        own = keys[at] if self.keys is None else np.concatenate([self.keys, keys[at]])
        value = np.concatenate([self.scores, scores[q, at]])
        rank = np.unique(own, return_inverse=True)[1]
        order = np.lexsort((rank, -value, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.n
        self.query, self.keys, self.scores = query[keep], own[order][keep], value[order][keep]
        full = place[keep] == self.n - 1
        self.nth[self.query[full]] = self.scores[full]


def blocks_of(queries: DataFrame, size: int, most: int | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of the queries, BLOCK_BYTES or `most` of them or about so many at a time."""
    n = max(1, min(BLOCK_BYTES // (8 * size), most or BLOCK_BYTES))
    blocks = max(1, -(-queries.count() // n))
    for i in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = some.select("query_id", F.transform("query", lambda c: c.cast("double"))).collect()  # a block
        if rows:
            yield [r[0] for r in rows], np.array([r[1] for r in rows], "float64").reshape(len(rows), -1)


def exact_top(corpus: DataFrame, queries: DataFrame, key: str, n: int, vector: str = "embedding", decimals: int | None = None, itself: bool = True) -> DataFrame:
    """query_id, key, score, rank: the n rows of the largest cosine for each query.

    queries have query_id and query. Each block of queries makes one pass over
    corpus, by matrix products; a partition sends n rows per query at most, and
    no vector is shuffled. Rows of zeros and queries of zeros score 0. Scores are
    rounded if decimals are given, before they are ranked; ties go by key. With
    itself=False a row isn't found by the query of the same id. Null vectors take no part.
    """
    spark = corpus.sparkSession
    rows = corpus.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col("query").isNotNull()).select("query_id", "query")
    head = rows.select(F.size("v")).head()
    kinds = (asked.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString())
    schema = f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double"
    out = spark.createDataFrame([], schema) if head is None else None
    for ids, q in blocks_of(asked, head[0]) if head else ():
        found = rows.mapInArrow(_exact(spark.sparkContext.broadcast((ids, unit(q))), key, n, head[0], decimals, itself), schema)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _exact(send, key: str, n: int, size: int, decimals: int | None, itself: bool):
    def run(batches):
        ids, q = send.value
        best = Nearest(len(ids), n)
        names, kind = None, None
        own = np.array(ids)
        for b in batches:
            kind = b.schema.field(0).type
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x, keys = unit(matrix(part.column(1), size)), np.array(part.column(0).to_pylist())
                for i in range(0, len(ids), STRIPE):
                    scores = q[i : i + STRIPE] @ x.T
                    scores = scores if decimals is None else np.round(scores, decimals)
                    if not itself:
                        scores[own[i : i + STRIPE, None] == keys[None, :]] = -np.inf
                    best.add(scores, keys, i)
        if best.keys is not None:
            real = best.scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.query[real]]), pa.array(best.keys[real].tolist(), kind), pa.array(best.scores[real])], names=["query_id", key, "score"])

    return run


class Quantised:
    """A stored index of product-quantised unit vectors.

    Vectors are in the list of their nearest of some k-means centres. `codes` has
    a byte per part of a vector: the nearest of up to 256 centres of that part.
    `vectors` has the vectors themselves, by list. A search scores the codes of
    the probed lists, `parts` bytes a row, and reads the vectors of the best
    `candidates` only, which it scores exactly. Centres are fitted on at most
    about `sample` rows; every row is indexed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.folder = versions.current(spark, path)
        if self.folder is None:
            raise FileNotFoundError(path)
        self.manifest = json.loads(files.read_text(spark, f"{self.folder}/manifest.json"))
        self.key = self.manifest["key"]
        self.size = self.manifest["size"]
        held = {r.name: np.array(r.values) for r in spark.read.parquet(f"{self.folder}/centres").collect()}  # MOST_LISTS and 256 vectors at most
        self.lists = held["lists"].reshape(-1, self.size)
        self.parts = [held[f"part-{i}"].reshape(-1, width) for i, width in enumerate(self.manifest["widths"])]

    @classmethod
    def build(cls, corpus: DataFrame, key: str, path: str, vector: str = "embedding", lists: int = 16, parts: int = 16, sample: int = 20_000, manifest: dict | None = None) -> Quantised:
        """Write the index under path, where there must be none yet."""
        spark = corpus.sparkSession
        rows = corpus.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
        found = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
        if not found.n:
            raise ValueError("cannot build an empty search index")
        size = found.size
        every = max(1, found.n // sample)
        some = rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).limit(2 * sample).select("v")
        cuts = np.linspace(0, size, min(parts, size) + 1).astype(int)
        widths = np.diff(cuts).tolist()
        # One group per part, and one for the lists: each a bounded sample.
        jobs = [("lists", 0, size, lists), *((f"part-{i}", int(cuts[i]), int(cuts[i + 1]), 256) for i in range(len(widths)))]
        tagged = some.select("v", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for n, a, b, k in jobs])).alias("j"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
        pieces = tagged.withColumn("norm", norm).select("j.name", "j.k", F.transform(F.slice("v", F.col("j.a") + 1, F.col("j.b") - F.col("j.a")), lambda c: c / F.greatest("norm", F.lit(1e-300))).alias("v"))
        centres = staged(pieces.groupBy("name").applyInArrow(_fitted, "name string, values array<double>"), "vector-centres")
        held = {r.name: np.array(r["values"]) for r in centres.collect()}
        send = spark.sparkContext.broadcast((held["lists"].reshape(-1, size), [held[f"part-{i}"].reshape(-1, w) for i, w in enumerate(widths)]))
        kind = rows.schema[key].dataType.simpleString()

        def encode(batches):
            middle, books = send.value
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    x = unit(matrix(part.column(1), size))
                    codes = np.stack([nearest(x[:, i:j], book) for i, j, book in zip(cuts[:-1], cuts[1:], books)], axis=1).astype("uint8")
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest(x, middle).astype("int32")), pa.array([c.tobytes() for c in codes], pa.binary()), part.column(1)], names=[key, "list", "code", "v"])

        coded = rows.mapInArrow(encode, f"`{key}` {kind}, list int, code binary, v array<double>")

        def write(folder: str) -> None:
            dealt = coded.repartition("list", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("list", key)
            whole = staged(dealt, "vector-coded")
            whole.select(key, "code", "list").write.partitionBy("list").parquet(f"{folder}/codes")
            whole.select(key, F.col("v").cast("array<float>").alias("v"), "list").write.partitionBy("list").parquet(f"{folder}/vectors")
            centres.write.parquet(f"{folder}/centres")
            files.write_report(spark, {"format_version": 3, "vectors": found.n, "size": size, "widths": widths, "key": key, "key_type": kind, **(manifest or {})}, f"{folder}/manifest.json")

        versions.publish(spark, path, write, replace=False)
        return cls(spark, path)

    def _table(self, name: str, column: str) -> DataFrame:
        return self.spark.read.schema(f"`{self.key}` {self.manifest['key_type']}, {column}, list int").parquet(f"{self.folder}/{name}")

    def candidates(self, queries: DataFrame, candidates: int, probes: int | None = None) -> DataFrame:
        """query_id, key, list, score: the best rows of each query by their codes, in
        the lists of its `probes` nearest centres (all)."""
        key, size, middle, books = self.key, self.size, self.lists, self.parts
        cuts = np.cumsum([0, *self.manifest["widths"]])
        spark, probed = self.spark, min(probes or len(middle), len(middle))
        asked_type = queries.schema["query_id"].dataType.simpleString()
        schema = f"query_id {asked_type}, `{key}` {self.manifest['key_type']}, list int, score double"

        def run_with(send):
            def run(batches):
                ids, q, met = send.value
                tables = [q[:, i:j] @ book.T for i, j, book in zip(cuts[:-1], cuts[1:], books)]
                best = Nearest(len(ids), candidates)
                kind, known, listed = None, None, np.zeros(0, "int32")  # rows that may be found, and their lists
                for b in batches:
                    kind = b.schema.field(0).type
                    for at in range(0, b.num_rows, ROWS):
                        part = b.slice(at, ROWS)
                        codes = np.frombuffer(b"".join(part.column(1).to_pylist()), "uint8").reshape(-1, len(books))
                        keys, own = np.array(part.column(0).to_pylist()), part.column(2).to_numpy()
                        known, listed = keys if known is None else np.concatenate([known, keys]), np.concatenate([listed, own])
                        for i in range(0, len(ids), STRIPE):
                            scores = sum(t[i : i + STRIPE][:, codes[:, p]] for p, t in enumerate(tables))
                            scores[~met[i : i + STRIPE][:, own]] = -np.inf
                            best.add(scores, keys, i)
                        keep = np.isin(known, best.keys)
                        known, listed = known[keep], listed[keep]
                if best.keys is not None:
                    order = np.argsort(known)
                    real = np.flatnonzero(best.scores > -np.inf)
                    for at in range(0, len(real), HANDED):
                        some = real[at : at + HANDED]
                        found = best.keys[some]
                        of = listed[order[np.searchsorted(known, found, sorter=order)]]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.query[some]]), pa.array(found.tolist(), kind), pa.array(of, pa.int32()), pa.array(best.scores[some])], names=["query_id", key, "list", "score"])

            return run

        out = spark.createDataFrame([], schema)
        for ids, q in blocks_of(queries.where(F.col("query").isNotNull()), size, max(1, HELD // candidates)):
            q = unit(q)
            met = np.zeros((len(q), len(middle)), bool)
            np.put_along_axis(met, np.argsort(-(q @ middle.T), axis=1)[:, :probed], True, axis=1)
            read = np.flatnonzero(met.any(axis=0)).tolist()
            codes = self._table("codes", "code binary").where(F.col("list").isin(read)).select(key, "code", "list")
            out = out.unionByName(codes.mapInArrow(run_with(spark.sparkContext.broadcast((ids, q, met))), schema))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
        return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= candidates).drop("_r")

    def search(self, queries: DataFrame, n: int, candidates: int = 50, probes: int | None = None) -> DataFrame:
        """query_id, key, score, rank: the n best of the candidates by exact cosine."""
        found = self.candidates(queries, candidates, probes).drop("score")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
        v, q = F.col("v"), F.col("query")
        norm = F.sqrt(dot(v, v) * dot(q, q))
        scored = found.join(self._table("vectors", "v array<float>"), ["list", self.key]).join(queries.select("query_id", "query"), "query_id")
        scored = scored.select("query_id", self.key, (dot(v, q) / F.greatest(norm, F.lit(1e-300))).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _fitted(t: pa.Table) -> pa.Table:
    """k-means centres of one group's vectors, by ten of Lloyd's rounds; distances
    are taken for ROWS vectors at a time."""
    v = t["v"].combine_chunks()
    x = matrix(v, len(v[0]))
    x = x[np.lexsort(x.T)]  # rows come in any order
    k = min(t["k"][0].as_py(), len(x))
    centres = x[np.random.default_rng(1).choice(len(x), k, replace=False)]
    for _ in range(10):
        own = np.concatenate([nearest(x[i : i + ROWS], centres) for i in range(0, len(x), ROWS)])
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, c, k) for c in x.T], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return pa.table({"name": t["name"][:1], "values": pa.array([centres.ravel()], pa.list_(pa.float64()))})
