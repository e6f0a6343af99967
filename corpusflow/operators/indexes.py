"""The stored search index of chunks: words, vectors and the chunks themselves."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, versions
from . import lexicon, search, vectors

Encoder = Callable[[pd.Series], pd.Series]
BOOSTS = {"title": 2.0, "content": 1.0}
#: Parts of the chunk table, by a hash of the id: a lookup reads those of its ids.
PARTS = 64


def _part(key: str = "chunk_id"):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def build(chunks: DataFrame, path: str, encoder: Encoder | None = None, config: dict | None = None, **dense) -> int:
    """Write the index of chunks (chunk_id, title, url, content) under path: a lexical
    one and, with an encoder, vectors of title and content. Returns the number of
    chunks. An existing index is an error, and so is an empty table; nothing is
    left by a failure."""
    spark = chunks.sparkSession
    config = config or search.CONFIG

    def write(folder: str) -> None:
        chunks.select("chunk_id", "title", "url", "content", _part().alias("part")).repartition("part").write.partitionBy("part").parquet(f"{folder}/chunks")
        own = stored(spark, folder)
        n = lexicon.build(own, "chunk_id", {f: F.col(f) for f in BOOSTS}, f"{folder}/lexical", BOOSTS)
        if encoder:
            texts = own.select("chunk_id", F.concat("title", F.lit("\n"), "content").alias("text"))
            vectors.Quantised.build(search.valid_vectors(search.encoded(texts, "text", encoder)), "chunk_id", f"{folder}/dense", **dense)
        manifest = {
            "format_version": 3, "chunks": n, "lexical": "bm25-positions", "dense": encoder is not None, "dense_backend": "product-quantised-lists" if encoder else None, "embedding_model": config["embedding_model"] if encoder else None,
            "reranker_model": config["reranker_model"], "candidate_multiplier": config["candidate_multiplier"], "rrf_constant": config["rrf_constant"],
        }
        files.write_report(spark, manifest, f"{folder}/retrieval-manifest.json")

    return json.loads(files.read_text(spark, f"{versions.publish(spark, path, write, replace=False)}/retrieval-manifest.json"))["chunks"]


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("chunk_id string, title string, url string, content string, part int").parquet(f"{folder}/chunks")


@dataclass
class Index:
    """An index as build() has written it."""

    spark: SparkSession
    path: str
    encoder: Encoder | None = None

    def __post_init__(self):
        self.folder = versions.current(self.spark, self.path)
        if self.folder is None:
            raise FileNotFoundError(self.path)
        self.manifest = json.loads(files.read_text(self.spark, f"{self.folder}/retrieval-manifest.json"))
        self.lexical = lexicon.Lexicon(self.spark, f"{self.folder}/lexical")
        self.dense = vectors.Quantised(self.spark, f"{self.folder}/dense") if self.manifest["dense"] and self.encoder else None

    def chunks(self, found: DataFrame) -> DataFrame:
        """The chunks that rows with a chunk_id name; parts without one aren't read."""
        parts = [r[0] for r in found.select(_part().alias("p")).distinct().collect()]  # PARTS at most
        return stored(self.spark, self.folder).where(F.col("part").isin(parts) if parts else F.lit(False)).drop("part")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best chunks of each query (query_id, text), by both lists fused; by
        words alone without vectors or an encoder."""
        asked = search.encoded(queries, "text", self.encoder, "query") if self.dense else queries
        lexical = search.lexicon_search(self.lexical, "chunk_id")
        none = lambda q, n: self.spark.createDataFrame([], "query_id long, chunk_id string, score double, rank int")
        dense = search.quantised_search(self.dense) if self.dense else none
        return search.hybrid(asked, lexical, dense, self.chunks, "chunk_id", k, self.manifest)
