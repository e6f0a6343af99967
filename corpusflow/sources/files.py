"""Whole files through Hadoop's file systems: atomic texts, hashes, logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).head()
    return row.value if row else ""


def replace(spark: SparkSession, part: str, target: str) -> None:
    """Put `part` in the place of `target`. What stood there is moved aside first
    and back again if the move fails: it is never lost."""
    fs, to = _fs(spark, target)
    _, new = _fs(spark, part)
    _, old = _fs(spark, f"{target}.{uuid.uuid4().hex}.old")
    if not fs.exists(new):
        raise FileNotFoundError(part)
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"can't move {target} aside")
    moved = False
    try:
        moved = fs.rename(new, to)
    finally:
        if had and not moved:
            fs.rename(old, to)
    if not moved:
        raise OSError(f"can't move {part} to {target}")
    if had:
        fs.delete(old, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write next to the target, then take its place; the part never stays."""
    part = f"{path}.{uuid.uuid4().hex}.partial"
    fs, p = _fs(spark, part)
    try:
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
            out.hflush()
        finally:
            out.close()
        replace(spark, part, path)
    finally:
        fs.delete(p, False)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    write_text(spark, path, json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of each file. A file's content is one row of at most
    2 GB, as a SHA-256 is over all of it; token corpora have a tree of hashes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines: new files, old ones stay."""
    rows.write.mode("append").json(path)
