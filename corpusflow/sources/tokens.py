"""Ordered token corpora: fixed blocks of little-endian ids, a manifest with a hash
tree over the blocks, and raw files read and written in parts.

A corpus is one stream of tokens. Block i holds its tokens from i * BLOCK on, and
all but the last are full, so that a position is found without a search. Blocks
are rows of Parquet, which splits; no file or stream goes through one row or the
driver.
"""

from __future__ import annotations

import json
import os
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.prefix import running_sum
from ..plans.stage import staged
from . import files, versions

BLOCK = 65_536
#: Hashes that one node of the hash tree is over.
FAN = 256
ROWS = "block long, first long, n int, raw binary"
WIDTH = {"uint16": 2, "uint32": 4}


def dtype_of(vocabulary: int) -> str:
    return "uint16" if vocabulary <= 65_535 else "uint32"


def encoded(rows: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", batch: int = 256) -> DataFrame:
    """rows with the ids that a tokenizers file gives, `batch` texts at a time; null
    texts have none. Each row is encoded where it is read."""
    kept = rows.drop(ids)
    names, at = kept.columns, kept.columns.index(text)

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.no_truncation()
        t.no_padding()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                found = t.encode_batch([x or "" for x in part.column(at).to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([e.ids for e in found], pa.list_(pa.int32()))], names=[*names, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def capped(docs: DataFrame, cap: int, order: str, ids: str = "ids") -> DataFrame:
    """docs up to `cap` tokens by order, with `start` (the place of their first token)
    and truncated. The document that passes the cap is cut there."""
    n = F.size(ids).cast("long")
    placed = running_sum(docs.select(order, n.alias("_n")), order, "_n", "_end").select(order, "_n", (F.col("_end") - F.col("_n")).alias("start"))
    some = docs.join(placed.where(F.col("start") < cap), order).withColumn("truncated", F.col("start") + F.col("_n") > cap)
    return some.withColumn(ids, F.when(F.col("truncated"), F.slice(ids, 1, (F.lit(cap) - F.col("start")).cast("int"))).otherwise(F.col(ids))).drop("_n")


def blocks(placed: DataFrame, dtype: str, ids: str = "ids", block: int = BLOCK) -> DataFrame:
    """ROWS of documents with their ids and start."""
    width, start = WIDTH[dtype], F.col("start")
    held = placed.where(F.size(ids) > 0)
    last = F.expr(f"(start + size({ids}) - 1) div {block}")
    pieces = held.select("start", ids, F.explode(F.sequence(F.expr(f"start div {block}"), last)).alias("block"))
    lo = F.greatest(start, F.col("block") * block)
    hi = F.least(start + F.size(ids), (F.col("block") + 1) * block)
    pieces = pieces.select("block", lo.alias("at"), F.slice(ids, (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    whole = pieces.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p"))  # a block is BLOCK tokens at most
    rows = whole.select("block", F.flatten("p.x").alias("x"))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().astype(f"<u{width}")
            raw = [flat[i - at[0] : j - at[0]].tobytes() for i, j in zip(at[:-1], at[1:])]
            numbers = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers * block), pa.array(np.diff(at).astype("int32")), pa.array(raw, pa.binary())], names=[x.split()[0] for x in ROWS.split(", ")])

    return rows.mapInArrow(run, ROWS)


def tree_hash(rows: DataFrame) -> str:
    """The root over the hashes of all blocks: each node is the SHA-256 of the hex
    hashes of up to FAN nodes below, in order."""
    level = rows.select(F.col("block").alias("i"), F.sha2("raw", 256).alias("h"))
    while True:
        above = level.groupBy(F.expr(f"i div {FAN}").alias("i")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x.h), "").cast("binary"), 256).alias("h"))
        level = staged(above, "tree")
        if level.count() <= 1:
            return (level.first() or {"h": ""})["h"]


def write(docs: DataFrame, path: str, vocabulary: int, cap: int, order: str = "n", ids: str = "ids", block: int = BLOCK, **more) -> dict:
    """docs (order, ids, source, verification) as a new version of the corpus at
    path, cut at `cap` tokens; returns its manifest. Without tokens it is an error,
    and nothing is left. `more` adds to the manifest or replaces its counts."""
    spark = docs.sparkSession
    dtype = dtype_of(vocabulary)
    placed = staged(capped(docs, cap, order, ids), "tokens-placed")
    counts = placed.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("tokens"), F.count("*").alias("documents"), F.count_if("truncated").alias("truncated")).first()
    if not counts.tokens:
        raise ValueError(f"no usable tokens were written to {path}")
    by = lambda c: {r[0]: r[1] for r in placed.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).collect()} if c in placed.columns else {}  # noqa: E731  a few kinds
    manifest = {
        "format_version": 3, "dtype": dtype, "vocab_size": vocabulary, "tokens": counts.tokens, "bytes": counts.tokens * WIDTH[dtype], "documents": counts.documents, "duplicates_removed": 0, "contaminated_removed": 0,
        "truncated_documents": counts.truncated, "source_documents": by("source"), "verification": by("verification"), "tokenizer_sha256": None, "block": block, **more,
    }

    def fill(folder: str) -> None:
        blocks(placed, dtype, ids, block).repartitionByRange("block").sortWithinPartitions("block").write.parquet(f"{folder}/blocks")
        manifest["sha256"] = tree_hash(spark.read.parquet(f"{folder}/blocks"))
        files.write_report(spark, manifest, f"{folder}/manifest.json")

    versions.publish(spark, path, fill)
    return manifest


def read(spark: SparkSession, path: str, verify: bool = False) -> tuple[DataFrame, dict]:
    """The blocks and the manifest of a corpus; an error if the tokens (with verify:
    or the bytes) aren't those of the manifest."""
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(path)
    manifest = json.loads(files.read_text(spark, f"{folder}/manifest.json"))
    rows = spark.read.schema(ROWS).parquet(f"{folder}/blocks")
    if (rows.agg(F.sum("n")).first()[0] or 0) != manifest["tokens"]:
        raise ValueError("token file size does not match its manifest")
    if verify and tree_hash(rows) != manifest["sha256"]:
        raise ValueError("token file content does not match its manifest")
    return rows, manifest


def ids_of(rows: DataFrame, dtype: str, raw: str = "raw", ids: str = "ids") -> DataFrame:
    """rows with the ids of their raw bytes in place of these."""
    names = [c for c in rows.columns if c != raw]
    at = rows.columns.index(raw)
    kind = f"<u{WIDTH[dtype]}"

    def run(batches):
        for b in batches:
            parts = [np.frombuffer(x, kind).astype("int64") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(parts, pa.list_(pa.int64()))], names=[*names, ids])

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name != raw), T.StructField(ids, T.ArrayType(T.LongType()))]))


def export_raw(rows: DataFrame, manifest: dict, target: str) -> int:
    """One raw file of all tokens at `target`, a path on a file system that all
    executors have mounted: each task writes its blocks at their own places, which
    a task that runs again repeats. Returns the bytes written."""
    place = urlsplit(target)
    if place.scheme not in ("", "file"):
        raise ValueError("a raw file needs a mounted file system; read the blocks elsewhere")
    path, width = place.path, WIDTH[manifest["dtype"]]
    with open(path, "wb") as f:
        f.truncate(manifest["bytes"])

    def run(batches):
        with open(path, "r+b") as f:
            done = 0
            for b in batches:
                for first, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    done += os.pwrite(f.fileno(), raw, first * width)
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["bytes"])

    return rows.select("first", "raw").mapInArrow(run, "bytes long").agg(F.sum("bytes")).first()[0]


def read_raw(spark: SparkSession, path: str, dtype: str, tokens: int) -> DataFrame:
    """first and raw of the records of a raw file, which splits; an error if its size
    isn't that of `tokens`. A record is the largest number of tokens up to 16384
    that divides them all (a prime number of tokens goes one by one)."""
    width = WIDTH[dtype]
    fs, p = files._fs(spark, path)
    if fs.getFileStatus(p).getLen() != tokens * width:
        raise ValueError("token file size does not match its manifest")
    if not tokens:
        return spark.createDataFrame([], "first long, raw binary")
    each = next(n for n in range(min(16_384, tokens), 0, -1) if tokens % n == 0)
    # Spark's file sources have no fixed-length records; Hadoop's have.
    found = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(each * width)})
    return spark.createDataFrame(found.map(lambda r: (r[0] // width, bytes(r[1]))), "first long, raw binary")


def quota_at(position: Column, quota: int, total: int) -> Column:
    """Tokens of the first source among the first `position` of a mixture: rint of
    the exact share."""
    return F.rint(position.cast("double") * F.lit(float(quota)) / F.lit(float(total))).cast("long")


def mixture(spark: SparkSession, sources: dict[str, tuple[DataFrame, int]], total: int, ratio: float, dtype: str, chunk: int, start: int = 0, end: int | None = None, block: int = BLOCK) -> DataFrame:
    """start and ids of the chunks of a mixture of real tokens that lie in [start, end).

    sources has the blocks and the number of tokens of "reasoning" and "general".
    A chunk begins at each multiple of `chunk`, with its reasoning tokens first;
    a source that runs out begins again. What a chunk holds depends on its place
    alone, so that a run resumed at any position goes on as if it hadn't
    stopped; the first and last chunk are cut to [start, end).

    A chunk's two runs of tokens are cut at the ends of blocks, and the pieces
    joined with the blocks by number: rows are pieces of blocks, never tokens.
    """
    end = total if end is None else min(end, total)
    quota = round(total * ratio)
    width = WIDTH[dtype]
    for name, n in (("reasoning", quota), ("general", total - quota)):
        if n and not sources[name][1]:
            raise ValueError(f"{name} token source is empty")
    base, cut = F.col("base"), F.col("end")
    chunks = spark.range(start // chunk, max(start // chunk, -(-end // chunk))).select((F.col("id") * chunk).alias("base"))
    chunks = chunks.withColumn("end", F.least(base + chunk, F.lit(total)))
    r0, r1 = quota_at(base, quota, total), quota_at(cut, quota, total)
    runs = F.array(F.struct(F.lit("reasoning").alias("source"), r0.alias("nth"), base.alias("at"), (r1 - r0).alias("n")), F.struct(F.lit("general").alias("source"), (base - r0).alias("nth"), (base + r1 - r0).alias("at"), (cut - base - (r1 - r0)).alias("n")))
    placed = chunks.select("base", F.explode(runs).alias("r")).select("base", "r.*")
    skip = F.greatest(F.lit(start) - F.col("at"), F.lit(0))
    placed = placed.select("base", "source", (F.col("nth") + skip).alias("nth"), (F.col("at") + skip).alias("at"), (F.least(F.col("at") + F.col("n"), F.lit(end)) - F.col("at") - skip).alias("n")).where("n > 0")
    lengths = F.create_map(*[F.lit(x) for name, (_, n) in sources.items() for x in (name, n)])
    placed = placed.withColumn("length", F.element_at(lengths, F.col("source")))
    # Blocks of all rounds through a source in one numbering: round * blocks + block.
    per = F.ceil(F.col("length") / F.lit(block))
    number = lambda nth: F.expr(f"({nth}) div length") * per + F.expr(f"(({nth}) % length) div {block}")
    pieces = placed.select("*", F.explode(F.sequence(number("nth"), number("nth + n - 1"))).alias("v")).withColumn("block", F.pmod("v", per)).withColumn("zero", F.floor(F.col("v") / per) * F.col("length") + F.col("block") * block)
    lo = F.greatest("nth", "zero")
    hi = F.least(F.col("nth") + F.col("n"), F.col("zero") + F.least(F.lit(block), F.col("length") - F.col("block") * block))
    pieces = pieces.select("base", "source", "block", (F.col("at") + lo - F.col("nth")).alias("at"), (lo - F.col("zero")).alias("offset"), (hi - lo).alias("n"))
    stored = None
    for name, (rows, _) in sources.items():
        own = rows.select(F.lit(name).alias("source"), "block", "raw")
        stored = own if stored is None else stored.unionByName(own)
    cuts = pieces.join(stored, ["source", "block"]).select("base", "at", F.substring("raw", (F.col("offset") * width + 1).cast("int"), (F.col("n") * width).cast("int")).alias("raw"))
    whole = cuts.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("p"))  # a chunk's pieces
    joined = whole.select(F.col("p")[0]["at"].alias("start"), F.aggregate("p.raw", F.unhex(F.lit("")), lambda a, b: F.concat(a, b)).alias("raw"))
    return ids_of(joined, dtype)
