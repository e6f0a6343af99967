"""The grounded-answer report: answers, retrieval, citations, tool calls, latency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .evaluation import percentiles, ranked

IDS = "array<string>"
#: The report's means over rows, and its ratios of sums.
MEANS = ("answer_exact_match", "answer_token_f1", "retrieval_recall", "retrieval_mrr", "retrieval_ndcg", "citation_precision", "citation_recall", "citation_validity", "search_rate", "unnecessary_search_rate")
FIELDS = (*MEANS, "valid_tool_call_rate", "query_recovery_rate", "latency_p50_seconds", "latency_p95_seconds")


def _or(rows: DataFrame, name: str, kind: str, default: Column) -> Column:
    """A column that rows may lack or leave null."""
    return F.coalesce(F.col(name).cast(kind), default) if name in rows.columns else default


def scored(rows: DataFrame) -> DataFrame:
    """search_mode and the parts of the report of each row."""
    none = F.array().cast(IDS)
    cited, retrieved, supporting = (F.array_distinct(_or(rows, c, IDS, none)) for c in ("cited_ids", "retrieved_ids", "supporting_ids"))
    queries = F.size(_or(rows, "queries", IDS, none))
    total = _or(rows, "tool_calls_total", "long", queries.cast("long"))
    if dict(rows.dtypes).get("valid_tool_calls") == "boolean":
        valid = total * _or(rows, "valid_tool_calls", "long", F.lit(1))
    else:
        valid = _or(rows, "valid_tool_calls", "long", total)
    named = rows.select(
        _or(rows, "search_mode", "string", F.lit("unknown")).alias("search_mode"),
        X.without_citations(F.col("prediction"), _or(rows, "cited_ids", IDS, none)).alias("p"), F.col("answer").alias("a"),
        cited.alias("c"), retrieved.alias("r"), supporting.alias("s"), queries.alias("q"), total.alias("total"), valid.alias("valid"),
        _or(rows, "search_required", "boolean", F.lit(True)).alias("required"), _or(rows, "answer_found", "boolean", F.lit(False)).alias("found"),
        (F.col("elapsed_seconds").cast("double") if "elapsed_seconds" in rows.columns else F.lit(None).cast("double")).alias("elapsed"),
    )
    shared = lambda x, y: F.size(F.array_intersect(x, y)).cast("double")
    c, s, r = F.col("c"), F.col("s"), F.col("r")
    cites = F.size(c) > 0
    over = lambda n, x: n / F.greatest(F.size(x), F.lit(1))
    return named.withColumn("m", ranked(r, s)).select(
        "search_mode", "total", "valid", "elapsed",
        X.exact_match(F.col("p"), F.col("a")).alias("answer_exact_match"), X.token_f1(F.col("p"), F.col("a")).alias("answer_token_f1"),
        F.col("m.recall").alias("retrieval_recall"), F.col("m.mrr").alias("retrieval_mrr"), F.col("m.ndcg").alias("retrieval_ndcg"),
        F.when(cites, over(shared(c, s), c)).otherwise((F.size(s) == 0).cast("double")).alias("citation_precision"),
        F.when(F.size(s) > 0, over(shared(c, s), s)).otherwise(1.0).alias("citation_recall"),
        F.when(cites, over(shared(c, r), c)).otherwise(1.0).alias("citation_validity"),
        (F.col("q") > 0).cast("double").alias("search_rate"), ((F.col("q") > 0) & ~F.col("required")).cast("double").alias("unnecessary_search_rate"),
        (F.col("q") > 1).cast("long").alias("chances"), ((F.col("q") > 1) & F.col("found")).cast("long").alias("recovered"),
    )


def report(rows: DataFrame) -> DataFrame:
    """search_mode (null: all rows), count and FIELDS; rows by mode only where
    there is more than one mode. Two levels of one rollup; without rows one row
    of zeros and a valid_tool_call_rate of 1."""
    parts = scored(rows)
    out = parts.rollup("search_mode").agg(
        F.count("*").alias("count"), F.grouping("search_mode").alias("_all"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in MEANS],
        F.coalesce(F.sum("valid") / F.nullif(F.sum("total"), F.lit(0)), F.lit(1.0)).alias("valid_tool_call_rate"),
        F.coalesce(F.sum("recovered") / F.greatest(F.sum("chances"), F.lit(1)), F.lit(0.0)).alias("query_recovery_rate"),
    )
    every = F.struct(F.lit(1).cast("tinyint").alias("all"), F.lit(None).cast("string").alias("mode"))
    keyed = parts.select("elapsed", F.explode(F.array(every, F.struct(F.lit(0).cast("tinyint").alias("all"), F.col("search_mode").alias("mode")))).alias("_level"))
    late = percentiles(keyed, "elapsed", "_level", latency_p50_seconds=0.5, latency_p95_seconds=0.95).drop("n")
    level = F.struct(F.col("_all").cast("tinyint").alias("all"), F.col("search_mode").alias("mode"))
    out = out.withColumn("_own", level).join(late, F.col("_own").eqNullSafe(F.col("_level")), "left").fillna(0.0, ["latency_p50_seconds", "latency_p95_seconds"])
    modes = parts.agg(F.count_distinct("search_mode").alias("_modes"))
    return out.join(F.broadcast(modes)).where("_all = 1 OR _modes > 1").select("search_mode", "count", *FIELDS)  # one row of modes


def matched(examples: DataFrame, modes: tuple[str, ...] = ("off", "local")) -> DataFrame:
    """Each example once per search mode."""
    return examples.select("*", F.explode(F.array(*map(F.lit, modes))).alias("search_mode"))


def benchmark(examples: DataFrame, answer: Callable[[DataFrame], DataFrame], modes: tuple[str, ...] = ("off", "local")) -> DataFrame:
    """Records of an injected answering step, with answer_found, for report().
    The step adds prediction, queries, tool_calls_total, valid_tool_calls,
    retrieved_ids, cited_ids and elapsed_seconds."""
    done = answer(matched(examples, modes))
    return done.withColumn("answer_found", X.exact_match(X.without_citations(F.col("prediction"), F.col("cited_ids")), F.col("answer")) == 1.0)
