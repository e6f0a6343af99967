"""Reports over predictions, losses, retrieval lists, runs and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def language_model(losses: DataFrame) -> DataFrame:
    """mean_loss weighted by tokens, and perplexity = exp(min(loss, 20))."""
    ok = (F.col("tokens") >= 1) & (F.col("loss") >= 0) & ~F.isnan("loss")
    loss = F.when(ok, F.col("loss") * F.col("tokens")).otherwise(F.raise_error(F.lit("a loss or token count is invalid")).cast("double"))
    mean = F.sum(loss) / F.sum("tokens")
    return losses.agg(mean.alias("mean_loss"), F.exp(F.least(mean, F.lit(20.0))).alias("perplexity"), F.sum("tokens").alias("tokens"))


def answers(rows: DataFrame) -> DataFrame:
    """task (null: all), n, exact_match, token_f1."""
    scored = rows.select(F.coalesce("task", F.lit("unknown")).alias("task"), X.exact_match(F.col("prediction"), F.col("answer")).alias("em"), X.token_f1(F.col("prediction"), F.col("answer")).alias("f1"))
    return scored.rollup("task").agg(F.count("*").alias("n"), F.avg("em").alias("exact_match"), F.avg("f1").alias("token_f1"))


#: Ranks of a sketch are wrong by at most one part in so many.
SKETCH = 10_000


def percentiles(rows: DataFrame, value: str, by: str, **quantiles: float) -> DataFrame:
    """by, n and the exact interpolated quantiles of each group (0.0 without values).

    A quantile's place is bracketed by a sketch, which is merged map-side and has
    a proven error; a second pass counts what lies below the bracket and the
    values in it, map-side too. So no task has more of a group's values than
    the distinct ones of a bracket, some 6 in SKETCH of them. Null groups are a
    group; null values count in n only.
    """
    some = rows.select(by, F.col(value).cast("double").alias("_v"))
    names = list(quantiles)
    edges = [min(1.0, max(0.0, q + side * 3 / SKETCH)) for q in quantiles.values() for side in (-1, 1)]
    drawn = some.groupBy(by).agg(F.count("*").alias("n"), F.count("_v").alias("_k"), F.percentile_approx("_v", edges, SKETCH).alias("_e"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    edge = lambda i, q, side: F.col("_least") if edges[i] == 0.0 else F.col("_most") if edges[i] == 1.0 else F.col("_e")[i]
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), ((F.col("_k") - 1) * F.lit(float(q))).alias("place"), edge(2 * i, q, 0).alias("lo"), edge(2 * i + 1, q, 1).alias("hi")) for i, (k, q) in enumerate(quantiles.items())])
    brackets = drawn.where("_k > 0").select(F.col(by).alias("_by"), F.explode(wanted).alias("w")).select("_by", "w.*")
    met = some.where("_v IS NOT NULL").join(brackets, F.col(by).eqNullSafe(F.col("_by")))
    side = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), 1).otherwise(0)
    counts = met.groupBy("_by", "name", "place", side.alias("side"), F.when(side == 0, F.col("_v")).alias("_in")).agg(F.count("*").alias("c"), F.min("_v").alias("first"), F.max("_v").alias("last"))
    # With few values a place may be the last below the bracket or the first above it.
    counts = counts.withColumn("x", F.when(F.col("side") < 0, F.col("last")).otherwise(F.col("first")))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("_by", "name").orderBy("side", "_in")))
    found = upto.groupBy("_by", "name", "place").agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("x"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("x"))).alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place")))
    wide = found.groupBy("_by").agg(*[F.max(F.when(F.col("name") == k, between)).alias(k) for k in names])
    return drawn.select(by, "n").join(wide, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in names])


def ranked(retrieved: Column, supporting: Column, cutoff: int | None = None) -> Column:
    """struct(recall, mrr, ndcg) of an ordered list. The ideal order holds as
    many hits as the shorter of the two lists; without support all are 1."""
    found = F.array_distinct(retrieved)
    found = F.slice(found, 1, cutoff) if cutoff else found
    support = F.array_distinct(supporting)
    gains = F.transform(found, lambda x, i: F.when(F.array_contains(support, x), 1 / F.log2(i + 2.0)).otherwise(0.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    first = F.array_min(F.transform(support, lambda x: F.nullif(F.array_position(found, x), F.lit(0).cast("long"))))
    best = F.least(F.size(support), F.size(found))
    ideal = total(F.transform(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), lambda i: 1 / F.log2(i + 1.0)))
    none = F.size(support) == 0
    return F.struct(
        F.when(none, 1.0).otherwise(F.size(F.array_intersect(found, support)) / F.greatest(F.size(support), F.lit(1))).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce(1.0 / first, F.lit(0.0))).alias("mrr"),
        F.when(none, 1.0).when(best == 0, 0.0).otherwise(total(gains) / ideal).alias("ndcg"),
    )


def ranked_hits(found: DataFrame, sizes: DataFrame, group: str, cutoff: int) -> DataFrame:
    """query_id, recall, mrr, ndcg of rows (query_id, rank, hit), where the
    relevant items of a query are only counted: sizes has `support` per group."""
    i = F.col("rank").cast("double")
    gain = F.when(F.col("hit"), 1 / F.log2(i + 1)).otherwise(0.0)
    per = found.where(F.col("rank") <= cutoff).groupBy("query_id", group).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), i)).alias("first"), F.sum(gain).alias("dcg"))
    best = F.least("support", "n").cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    none = F.col("support") <= 0
    return per.join(sizes, group).select(
        "query_id",
        F.when(none, 1.0).otherwise(F.col("hits") / F.greatest("support", F.lit(1))).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(none, 1.0).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )


def final_metric(log: DataFrame, run: str, step: str) -> DataFrame:
    """The last row of each run with its ratio of reasoning tokens."""
    fields = [c for c in ("reasoning_tokens", "tokens_seen", "loss", "tokens_per_second") if c in log.columns]
    last = log.groupBy(run).agg(F.max_by(F.struct(*fields), F.struct(step)).alias("r")).select(run, "r.*")
    return last.withColumn("ratio", F.col("reasoning_tokens") / F.greatest(F.lit(1), F.col("tokens_seen")))


def compared(log: DataFrame, run: str, step: str) -> DataFrame:
    """One row: runs (an array of the last row of each run, by ratio),
    equal_token_budget and token_budget_spread. There are few runs."""
    last = final_metric(log, run, step)
    speed = [c for c in ("tokens_per_second",) if c in last.columns]
    ordered = F.array_sort(F.collect_list(F.struct("ratio", run, F.col("loss").alias("final_loss"), "tokens_seen", *speed)))
    return last.agg(ordered.alias("runs"), (F.count_distinct("tokens_seen") == 1).alias("equal_token_budget"), (F.max("tokens_seen") - F.min("tokens_seen")).alias("token_budget_spread"))


def advantages(rewards: DataFrame, group: str, epsilon: float = 1e-4) -> DataFrame:
    """rewards with advantage relative to the group; groups of one are an error, as
    are rewards that are null, infinite or not a number."""
    w = Window.partitionBy(group)
    odd = F.col("reward").isNull() | F.isnan("reward") | (F.abs("reward") == float("inf"))
    rewards = rewards.withColumn("reward", F.when(odd, F.raise_error(F.lit("a reward isn't finite")).cast("double")).otherwise(F.col("reward")))
    value = (F.col("reward") - F.avg("reward").over(w)) / (F.stddev_pop("reward").over(w) + epsilon)
    return rewards.withColumn("advantage", F.when(F.count("*").over(w) < 2, F.raise_error(F.lit("a group needs two rewards")).cast("double")).otherwise(value))


# The weight of each part of a rollout's reward.
REWARD_WEIGHTS = {
    "answer_exact": 1.0, "answer_f1": 0.25, "citation_precision": 0.20, "citation_recall": 0.20, "citation_validity": 0.20, "valid_tool_calls": 0.10, "query_recovery": 0.10,
    "unnecessary_search": -0.10, "invalid_tool_call": -0.25, "search_cost": -0.02, "judge_answer_correctness": 0.20, "judge_evidence_support": 0.15, "judge_search_quality": 0.05, "judge_valid": 0.0,
}


def reward(parts: DataFrame, weights: dict[str, float] = REWARD_WEIGHTS) -> Column:
    """The weighted sum of the parts that the rows have."""
    return sum((F.lit(w) * F.col(k) for k, w in weights.items() if k in parts.columns), F.lit(0.0))


def citation_parts(cited: Column, returned: Column, supporting: Column) -> Column:
    """struct(precision, recall, validity) of the ids an answer cites."""
    c, r, s = map(F.array_distinct, (cited, returned, supporting))
    n = F.greatest(F.size(c), F.lit(1))
    good = F.size(F.array_intersect(F.array_intersect(c, r), s))
    return F.struct(
        (good / n).alias("precision"),
        F.when(F.size(s) == 0, 0.0).otherwise(good / F.greatest(F.size(s), F.lit(1))).alias("recall"),
        F.when(F.size(c) == 0, 1.0).otherwise(F.size(F.array_intersect(c, r)) / n).alias("validity"),
    )
