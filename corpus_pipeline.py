"""The training-data pipeline: five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import jaccard, lines, packing, quality, toxicity
from corpusflow.llm.common import read_table, staged, unused
from corpusflow.llm.labelled import read_labels


# Each stage but the last returns the columns of docs, whatever their names. A
# null text counts as empty. Rows with one doc_id are one document to line_dedup
# and the join and rows of their own to the others. An empty table stays empty.


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches quality.ACCEPT; at just ACCEPT they
    stay. Equal texts have one fate; without labels all stay."""
    name = unused(docs, "score")
    scored = quality.score(docs, quality.train(docs, read_labels(spark, sf_dir)), name)
    return scored.where(F.col(name) >= quality.ACCEPT).select(*_names(docs))


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below toxicity.REJECT; at just REJECT
    they go. Equal texts have one fate; without labels all stay."""
    name = unused(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, read_labels(spark, sf_dir)), name)
    return scored.where(F.col(name) < toxicity.REJECT).select(*_names(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those of which no word
    is left by that go, those that had none stay. n_chars, if there, is counted
    anew."""
    lines_, lost = "n_lines", "n_dropped"
    own = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in (lines_, lost)}
    out = lines.dedup_lines(docs.withColumnsRenamed(own)).where((F.col(lost) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = out.drop(lines_, lost).withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*_names(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; documents
    without an id or without words stay. Rows of one id share one fate."""
    gone = jaccard.jaccard_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("gone"), "left_anti").select(*_names(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed (see packing.pack)."""
    return packing.pack(docs)


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
#: Classifiers and packing can't be written in SQL; see tests/llm.
ORACLE_SQL = None
