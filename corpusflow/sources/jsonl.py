"""JSON lines: reads with the reason and number of each bad line, whole writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of each line of text files.

    A line's number is its place in its block plus the lines of the blocks
    before it: one count per block is gathered and summed up by file. The blocks
    (one per scan task and file at most) are few; Spark sends them to all tasks
    while they are below its limit.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("file").orderBy("_block"))
    before = blocks.select("file", "_block", "_first", (upto - F.col("_n")).alias("_before"))
    return lines.join(before, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def _object(value: Column) -> Column:
    return F.from_json(value, "map<string,string>")


def read_lines(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The required keys as strings, and error (null: valid) per non-blank line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _checked(lines, required)


def _checked(lines: DataFrame, required: list[str], *keep: str) -> DataFrame:
    row = _object(F.col("value"))
    missing = F.filter(F.array(*map(F.lit, required)), lambda k: ~F.map_contains_key(F.coalesce(row, F.create_map().cast("map<string,string>")), k))
    error = F.when(row.isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return lines.select(*keep, *[F.try_element_at(row, F.lit(k)).alias(k) for k in required], error.alias("error"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """line, id, title, url, text as strings and error, which names the line.
    Other keys are left out; a blank line is an error too."""
    rows = _checked(numbered(spark, path), ["id", "title", "url", "text"], "line")
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.concat(F.lit("document line "), "line", F.lit(": "), "error")))


def valid(rows: DataFrame) -> DataFrame:
    """Rows without error; the first error met stops the job."""
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error("error").cast("boolean")).otherwise(True)).drop("error")


def _kind(path: str) -> Column:
    """The JSON type at a path of `value`: STRING, BOOLEAN, ...; null if absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), path, "variant"))


def _text(path: str) -> Column:
    return F.when(_kind(path) == "STRING", F.try_variant_get(F.try_parse_json("value"), path, "string"))


def rollout_prompts(spark: SparkSession, path: str) -> DataFrame:
    """line, question, answer, supporting_ids, search_required and error of each
    line that isn't blank: question and answer are non-blank strings,
    supporting_ids (default none) strings, search_required (default true) a
    JSON boolean."""
    rows = numbered(spark, path).where(F.trim("value") != "")
    ids, wanted = _kind("$.supporting_ids"), _kind("$.search_required")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    what = (
        F.when(F.try_parse_json("value").isNull(), "isn't JSON")
        .when(blank(_text("$.question")), "is missing question")
        .when(blank(_text("$.answer")), "is missing answer")
        .when(ids.isNotNull() & ~ids.isin("ARRAY<STRING>", "ARRAY<VOID>"), "has invalid supporting_ids")
        .when(wanted.isNotNull() & (wanted != "BOOLEAN"), "has invalid search_required")
    )
    return rows.select(
        "line", _text("$.question").alias("question"), _text("$.answer").alias("answer"),
        F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.supporting_ids", "array<string>"), F.array().cast("array<string>")).alias("supporting_ids"),
        F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.search_required", "boolean"), F.lit(True)).alias("search_required"),
        F.when(what.isNotNull(), F.concat(F.lit("RL prompt line "), "line", F.lit(" "), what)).alias("error"),
    )


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """line, text and error of each line that isn't blank; text is a non-blank string."""
    rows = numbered(spark, path).where(F.trim("value") != "")
    bad = F.coalesce(F.trim(_text("$.text")), F.lit("")) == ""
    return rows.select("line", _text("$.text").alias("text"), F.when(bad, F.concat(F.lit("trajectory line "), "line", F.lit(" has no non-empty text"))).alias("error"))


def evaluation_prompts(spark: SparkSession, path: str | None) -> DataFrame:
    """prompt, question or text of each line, whichever comes first and isn't
    empty; a line that isn't an object is a prompt itself; no path, no prompts."""
    if path is None:
        return spark.createDataFrame([], "prompt string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = _object(F.col("value"))
    pick = F.coalesce(*[F.nullif(F.try_element_at(row, F.lit(k)), F.lit("")) for k in ("prompt", "question", "text")])
    return lines.select(F.when(row.isNull(), F.trim("value")).otherwise(pick).alias("prompt")).where("prompt IS NOT NULL")


def last_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last line that isn't blank of each file, parsed, with its file."""
    lines = numbered(spark, path).where(F.trim("value") != "")
    last = lines.groupBy("file").agg(F.max_by("value", "line").alias("value"))
    return last.select("file", F.from_json("value", schema).alias("r")).select("file", "r.*")


def write_whole(df: DataFrame, path: str, nonempty: bool = False) -> int:
    """Write next to the target, then take its place: readers see the old or the
    new rows, and a failure at any point leaves the old ones. Returns the number
    of rows written."""
    spark = df.sparkSession
    part = f"{path}.{uuid.uuid4().hex}.partial"
    try:
        df.write.json(part)
        written = spark.read.text(part).count()
        if nonempty and not written:
            raise ValueError("there is nothing to write")
        files.replace(spark, part, path)
        return written
    finally:
        files.delete(spark, part)


def write_lines(df: DataFrame, column: str, path: str, nonempty: bool = False) -> int:
    """As write_whole, of a column of lines as they are."""
    spark = df.sparkSession
    part = f"{path}.{uuid.uuid4().hex}.partial"
    try:
        df.select(column).write.text(part)
        written = spark.read.text(part).count()
        if nonempty and not written:
            raise ValueError("there is nothing to write")
        files.replace(spark, part, path)
        return written
    finally:
        files.delete(spark, part)
