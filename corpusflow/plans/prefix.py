"""Running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below a value, by binary search in one
    constant array."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*map(F.lit, cuts)).cast("array<long>")
    out = F.lit(0)
    step = 1 << (len(cuts).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step //= 2
    below = lambda lo, k: (lo + k <= len(cuts)) & (F.get(bounds, lo + k - 1) < value)
    return F.aggregate(F.array(*map(F.lit, steps)), out, lambda lo, k: F.when(below(lo, k), lo + k).otherwise(lo))


def running_sum(df: DataFrame, order: str, value: str, name: str, rows_per_bucket: int = 2_000_000, most: int = 10_000) -> DataFrame:
    """df with name: the sum of value up to each row by `order` (a unique whole
    number). Rows are dealt by ranges of equal counts; the totals of the ranges
    (at most `most` numbers) are summed before the windows within ranges. The
    number of ranges follows the rows, 64 at least."""
    every = 1024
    found = df.agg(F.count("*").alias("n"), F.percentile_approx(order, [i / every for i in range(1, every)], 10 * every).alias("cuts")).first()
    buckets = max(64, min(most, found.n // rows_per_bucket))
    cuts = (found.cuts or [])[every // buckets - 1 :: every // buckets] if buckets <= every else df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    bucket = range_of(F.col(order), sorted(set(cuts)))
    keyed = df.withColumn("_bucket", bucket)
    sums = keyed.groupBy("_bucket").agg(F.sum(value).alias("s"))
    offset = sums.select("_bucket", (F.sum("s").over(Window.orderBy("_bucket")) - F.col("s")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_bucket").orderBy(order))
    return keyed.withColumn("_within", within).join(F.broadcast(offset), "_bucket").withColumn(name, F.col("_within") + F.col("_before")).drop("_bucket", "_within", "_before")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: the number (from 0) of each row by `order`, columns of any type.
    Rows are sorted by ranges and staged with the number of their partition; what
    is summed is one count per partition. Rows that are equal in `order` have any order."""
    whole = staged(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = whole.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = whole.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row per partition
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")
