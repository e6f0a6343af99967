"""Schedules and budgets as expressions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cosine_rate(tokens: Column, peak: float, least: float, warmup: int, total: int) -> Column:
    """Linear warm-up to the peak, then a cosine down to the least."""
    done = F.least(F.greatest((tokens - warmup) / float(max(1, total - warmup)), F.lit(0.0)), F.lit(1.0))
    return F.when(tokens < warmup, peak * tokens / float(max(1, warmup))).otherwise(least + (peak - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))


def projected_budget(seen: Column, rate: Column, seconds: Column, cap: int, quantum: int) -> Column:
    """What a run can still reach, in whole quanta, a quantum at least."""
    reach = F.least(F.lit(cap).cast("long"), seen + F.floor(rate * seconds))
    return F.greatest((reach / quantum).cast("long") * quantum, F.lit(min(cap, quantum)).cast("long"))


def utilisation(parameters: Column, rate: Column, teraflops: float) -> Column:
    return 6 * parameters * rate / F.lit(teraflops * 1e12)


def warmup_factor(step: Column, total: int, warmup: int) -> Column:
    """The multiplier of a step: linear warm-up, then a cosine down to 0.1."""
    done = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(0.1 + 0.9 * 0.5 * (1.0 + F.cos(F.lit(math.pi) * done)))


def tokens_per_step(sequence: Column, batch: Column, accumulation: Column) -> Column:
    return sequence * batch * accumulation


# The runs of the one-day plan (name, preset, ratio, token cap, hours, seed) and what it reserves.
RUNS = (
    ("proxy-r0", "proxy-124m", 0.0, 150_000_000, 1.5, 42),
    ("proxy-r30", "proxy-124m", 0.3, 150_000_000, 1.5, 42),
    ("proxy-r70", "proxy-124m", 0.7, 150_000_000, 1.5, 42),
    ("main-r70", "main-350m", 0.7, 2_500_000_000, 14.0, 42),
)
RESERVED_HOURS = 5.5


def scheduled_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RUNS), "name string, preset string, reasoning_ratio double, token_cap long, time_budget_hours double, seed int")


def scheduled_hours(runs: DataFrame) -> DataFrame:
    return runs.agg(F.sum("time_budget_hours").alias("scheduled_hours"), (F.sum("time_budget_hours") + RESERVED_HOURS).alias("planned_hours"))
