"""Search rollouts: turn histories, provider routing, reward parts from traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import dialogue, evaluation

# Rounds of a tool loop beyond its searches, and what a trace entry's status may be.
EXTRA_ROUNDS = 4
VALID, INVALID = ("ok", "empty", "error"), ("invalid", "rejected")


def history(turns: DataFrame, request: str = "request_id", turn: str = "turn") -> DataFrame:
    """turns with status and the state before and after each: the replay of a
    tool loop over logged turns.

    turns have text (what was generated), mode, max_searches, and outcome (ok,
    empty, error: what the search gave or would give). A text without the call
    marker ends the loop; one whose call can't be read is invalid, the second
    such disables tools; with mode off or the budget used it meets the limit; a
    query asked before is rejected but uses budget. A loop has max_searches and
    EXTRA_ROUNDS turns at most; what is logged after them isn't replayed.
    """
    call = dialogue.tool_call(F.col("text"))
    rows = turns.withColumn("_q", X.case_folded(call["query"])).withColumn("_tries", F.col("text").contains(dialogue.CALL))
    so_far = Window.partitionBy(request).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(request).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ended", F.coalesce(F.max((~F.col("_tries")).cast("int")).over(before), F.lit(0)) == 1)
    rows = rows.withColumn("_round", F.row_number().over(Window.partitionBy(request).orderBy(turn)))
    rows = rows.withColumn("_ended", F.col("_ended") | (F.col("_round") > F.col("max_searches") + EXTRA_ROUNDS))
    asks = F.col("_q").isNotNull() & ~F.col("_ended") & (F.col("mode") != "off")
    # Repeats use budget too: the nth well-formed call of a request is its nth search while n <= the budget.
    rows = rows.withColumn("_n", F.sum(asks.cast("int")).over(so_far))
    rows = rows.withColumn("_used", asks & (F.col("_n") <= F.col("max_searches")))
    same = Window.partitionBy(request, "_q").orderBy(turn)
    rows = rows.withColumn("_again", F.row_number().over(same) > 1)
    bad = F.col("_tries") & F.col("_q").isNull() & ~F.col("_ended")
    status = (
        F.when(F.col("_ended"), "after_end")
        .when(~F.col("_tries"), "answer")
        .when(bad, "invalid")
        .when(~F.col("_used"), "search_limit")
        .when(F.col("_again"), "rejected")
        .otherwise(F.coalesce("outcome", F.lit("error")))
    )
    out = rows.withColumns({"status": status, "invalid_attempts": F.sum(bad.cast("int")).over(so_far), "searches_used": F.sum(F.col("_used").cast("int")).over(so_far)})
    last = (F.col("_round") == F.col("max_searches") + EXTRA_ROUNDS) & ~F.col("status").isin("answer", "after_end")
    return out.withColumns({"tools_disabled": F.col("invalid_attempts") >= 2, "rounds_spent": last}).drop("_q", "_tries", "_ended", "_n", "_used", "_again", "_round")


def finish_reason(replayed: DataFrame, request: str = "request_id") -> DataFrame:
    """request, finish_reason (search_limit if all rounds are spent without an
    answer, else that of the last turn that set one, else answer) and searches_used."""
    sets = F.when((F.col("status") == "search_limit") | F.col("rounds_spent"), "search_limit").when((F.col("status") == "invalid") & F.col("tools_disabled"), "invalid_tool")
    return replayed.groupBy(request).agg(F.coalesce(F.max_by(sets, F.when(sets.isNotNull(), F.col("turn"))), F.lit("answer")).alias("finish_reason"), F.max("searches_used").alias("searches_used"))


def routed(mode: Column, local: Column, web: Column, local_failed: Column, web_available: Column) -> Column:
    """struct(results, provider, status): web and local use their own results;
    auto takes the local ones unless they are empty or failed and the web is there."""
    to_web = (mode == "web") | ((mode == "auto") & web_available & (local_failed | (F.size(local) == 0)))
    missing = (mode == "web") & ~web_available
    results = F.when(missing | (~to_web & local_failed), F.lit(None)).when(to_web, web).otherwise(local)
    status = F.when(results.isNull(), "error").when(F.size(results) > 0, "ok").otherwise("empty")
    return F.struct(results.alias("results"), F.when(status == "error", F.lit(None)).when(to_web, "web").otherwise("local").alias("provider"), status.alias("status"))


def parts(rows: DataFrame) -> DataFrame:
    """rows with one column per reward part.

    rows have prediction, answer, raw (the final output), trace (an array of
    struct<query, status, result_ids>), supporting_ids, search_required,
    searches_used, and may have judge, struct<answer_correctness,
    evidence_support, search_quality, valid>.
    """
    none = F.array().cast("array<string>")
    trace = F.coalesce("trace", F.array().cast("array<struct<query:string,status:string,result_ids:array<string>>>"))
    s = F.array_distinct(F.coalesce("supporting_ids", none))
    named = rows.withColumns({"_c": dialogue.citations(F.col("raw")), "_t": trace, "_s": s})
    named = named.withColumns({"_r": F.array_distinct(F.flatten(F.transform("_t", lambda e: F.coalesce(e.result_ids, none)))), "_p": X.without_citations(F.col("prediction"), F.col("_c"))})
    named = named.withColumns({"_m": evaluation.citation_parts(F.col("_c"), F.col("_r"), F.col("_s")), "_v": F.filter("_t", lambda e: e.query.isNotNull() & e.status.isin(*VALID)), "answer_exact": X.exact_match(F.col("_p"), F.col("answer"))})
    count = lambda among: F.size(F.filter("_t", lambda e: e.status.isin(*among)))
    supports = lambda e: (F.size("_s") == 0) | F.arrays_overlap(F.coalesce(e.result_ids, none), F.col("_s"))
    first, later = F.try_element_at("_v", F.lit(1)), F.slice("_v", 2, F.greatest(F.size("_v"), F.lit(1)))
    failed = (first["status"] != "ok") | ((F.size("_s") > 0) & ~supports(first))
    mended = F.exists(later, lambda e: (e.status == "ok") & (F.size(e.result_ids) > 0) & supports(e))
    asked = F.size(F.array_distinct(F.transform("_v", lambda e: F.lower(e["query"])))) > 1
    recovered = (F.size("_v") > 1) & (F.col("answer_exact") == 1.0) & failed & mended & asked
    judged = lambda k: F.when(F.col("judge.valid"), F.col(f"judge.{k}")).otherwise(0.0) if "judge" in rows.columns else F.lit(0.0)
    required = F.coalesce("search_required", F.lit(True))
    return named.withColumns({
        "answer_f1": X.token_f1(F.col("_p"), F.col("answer")),
        "citation_precision": F.when(F.size("_s") == 0, 0.0).otherwise(F.col("_m.precision")),
        "citation_recall": F.col("_m.recall"),
        "citation_validity": F.col("_m.validity"),
        "valid_tool_calls": F.when(F.size("_t") == 0, 1.0).otherwise(count(VALID) / F.greatest(F.size("_t"), F.lit(1))),
        "query_recovery": F.coalesce(recovered, F.lit(False)).cast("double"),
        "unnecessary_search": ((F.col("searches_used") > 0) & ~required).cast("double"),
        "invalid_tool_call": count(INVALID).cast("double"),
        "search_cost": F.col("searches_used").cast("double"),
        "judge_answer_correctness": judged("answer_correctness"),
        "judge_evidence_support": judged("evidence_support"),
        "judge_search_quality": judged("search_quality"),
        "judge_valid": F.coalesce(F.col("judge.valid"), F.lit(False)).cast("double") if "judge" in rows.columns else F.lit(0.0),
    }).drop("_c", "_t", "_s", "_r", "_p", "_m", "_v")


def group_report(scored: DataFrame, group: str, components: list[str]) -> DataFrame:
    """Per prompt group: rows, mean and population deviation of the reward, mean of each part."""
    return scored.groupBy(group).agg(F.count("*").alias("n"), F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"), *[F.avg(c).alias(f"mean_{c}") for c in components])


def service_counters(requests: DataFrame, status: str = "status") -> DataFrame:
    """requests, errors (503: it failed, 504: it took too long) and busy (429:
    the queue was full) of a log of accepted requests."""
    s = F.col(status)
    return requests.agg(F.count("*").alias("requests"), F.count_if(s.isin(503, 504)).alias("errors"), F.count_if(s == 429).alias("busy"))


# Fixed value: what is answered when a loop ends with a call.
NO_ANSWER = "<|reasoning|>The tool loop did not yield a final response.<|answer|>I could not produce a grounded final answer within the tool budget."


def final_text(replayed: DataFrame, request: str = "request_id", turn: str = "turn") -> DataFrame:
    """request and text: what its last replayed turn says, or NO_ANSWER if that is a call."""
    last = replayed.where("status <> 'after_end'").groupBy(request).agg(F.max_by("text", turn).alias("text"))
    return last.withColumn("text", F.when(F.col("text").contains(dialogue.CALL), NO_ANSWER).otherwise(F.col("text")))
