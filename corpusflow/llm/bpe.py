"""BPE encoding and decoding of documents (see word_bpe for the method)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read_table, schema_with
from .word_bpe import opened, vocabulary_path


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>).

    Null and empty texts get an empty array. Existing columns stay, but for one
    named like `ids`, which is replaced. There is no shuffle: each row is
    encoded where it is read.
    """
    path = path or vocabulary_path()
    kept = docs.drop(ids)
    names, at = kept.columns, kept.columns.index(text)

    def run(batches):
        bpe = opened(path)
        for b in batches:
            rows = [bpe.encode(x).astype("<i4") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.int32()))], names=[*names, ids])

    return map_arrow(kept, run, schema_with(kept, ids, "array<int>"))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the decoded text of its ids; null ids give null."""
    path = path or vocabulary_path()
    kept = encoded.drop(text)
    names, at = kept.columns, kept.columns.index(ids)

    def run(batches):
        bpe = opened(path)
        for b in batches:
            rows = [None if x is None else bpe.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.string())], names=[*names, text])

    return map_arrow(kept, run, schema_with(kept, text, "string"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs.

    Repeated rows and null ids give a row each; null text counts as empty.
    """
    path = path or vocabulary_path()

    def run(batches):
        bpe = opened(path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for x in b.column(1).to_pylist():
                ids = bpe.encode_bytes(x)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode_bytes(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
