"""Decontamination, exact deduplication, token caps, mixtures, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.prefix import running_sum


def contaminated_pairs(docs: DataFrame, prompts: DataFrame, n: int = 8, threshold: float = 0.5) -> DataFrame:
    """doc_id, item_id, overlap of documents that share at least `threshold` of
    the shingles of the shorter side. Each word is hashed once and each run of n
    hashes again; these numbers go into a join with the prompts'. Only documents
    with a hit make strings of their shingles, for the exact count. Spark
    broadcasts the prompts' side while it is below its size limit, and splits
    skewed partitions beyond."""
    known = prompts.select(F.explode(X.shingle_hashes(F.col("text"), n)).alias("h")).distinct()
    met = docs.select("doc_id", F.explode(X.shingle_hashes(F.col("text"), n)).alias("h")).join(known, "h", "left_semi").select("doc_id").distinct()
    d = docs.join(met, "doc_id", "left_semi").select("doc_id", X.shingles(F.col("text"), n).alias("x")).select("doc_id", F.size("x").alias("nd"), F.explode("x").alias("s"))
    p = prompts.select("item_id", X.shingles(F.col("text"), n).alias("x")).select("item_id", F.size("x").alias("np"), F.explode("x").alias("s"))
    hit = d.join(p, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("k"), F.first("nd").alias("nd"), F.first("np").alias("np"))
    overlap = F.col("k") / F.least("nd", "np")
    return hit.where(overlap >= threshold).select("doc_id", "item_id", F.round(overlap, 6).alias("overlap"))


def decontaminate(docs: DataFrame, prompts: DataFrame, n: int = 8, threshold: float = 0.5) -> DataFrame:
    return docs.join(contaminated_pairs(docs, prompts, n, threshold).select("doc_id").distinct(), "doc_id", "left_anti")


def exact_dedup(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first row by `order` of each normalised text. The hash and order are
    aggregated map-side; texts are not shuffled by content, so that a text with
    many copies makes no large group."""
    first = docs.groupBy(X.normalized_hash(F.col("text")).alias("h")).agg(F.min(order).alias(order)).select(order)
    return docs.join(first, order, "left_semi")


def token_cap(docs: DataFrame, cap: int, order: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """docs up to `cap` tokens in order, with kept (tokens of the row that fit)."""
    seen = running_sum(docs, order, tokens, "_upto")
    before = F.col("_upto") - F.col(tokens)
    return seen.where(before < cap).withColumn("kept", F.least(F.col(tokens), F.lit(cap) - before)).drop("_upto")


def mixture_schedule(chunks: DataFrame, total: int, ratio: float) -> DataFrame:
    """reasoning and general tokens of each chunk [start, start + size): rint of
    the exact share at its ends."""
    quota = round(total * ratio)
    at = lambda n: F.rint(n.cast("double") * F.lit(float(quota)) / F.lit(float(total))).cast("long")
    end = F.col("start") + F.col("size")
    return chunks.withColumn("reasoning", at(end) - at(F.col("start"))).withColumn("general", F.col("size") - F.col("reasoning"))


def mixture_tokens(sources: DataFrame, total: int, ratio: float, chunk: int, start: int = 0, end: int | None = None) -> DataFrame:
    """position, source, cursor of the mixture's tokens in [start, end).

    sources has one row per source (reasoning, general) with its length. Chunks
    of `chunk` tokens begin at 0; each has its reasoning tokens first. The nth
    token of a source is at n modulo its length. All of it is a function of the
    position, so that a run resumed at `start` goes on as if it hadn't stopped.
    An empty source with a quota is an error.
    """
    end = total if end is None else min(end, total)
    quota = round(total * ratio)
    at = lambda n: F.rint(n.cast("double") * F.lit(float(quota)) / F.lit(float(total))).cast("long")
    rows = sources.sparkSession.range(start, max(start, end)).withColumnRenamed("id", "position")
    base = (F.expr(f"position div {chunk}") * chunk).cast("long")
    r0, r1 = at(base), at(F.least(base + chunk, F.lit(total)))
    inside = F.col("position") - base
    first = inside < r1 - r0
    nth = F.when(first, r0 + inside).otherwise(base - r0 + inside - (r1 - r0))
    placed = rows.select("position", F.when(first, "reasoning").otherwise("general").alias("source"), nth.alias("nth"))
    known = placed.join(F.broadcast(sources.select("source", "length")), "source")  # two rows
    cursor = F.when(F.col("length") > 0, F.pmod(F.col("nth"), F.greatest("length", F.lit(1)))).otherwise(F.raise_error(F.lit("a token source is empty")).cast("long"))
    return known.select("position", "source", cursor.alias("cursor"))


def mixture_state(sources: DataFrame, total: int, ratio: float, emitted: int) -> DataFrame:
    """total_tokens, and tokens and cursor of both sources, after `emitted` tokens."""
    quota = round(total * ratio)
    taken = F.rint(F.lit(float(min(emitted, total)) * quota / max(1, total))).cast("long")
    wide = sources.groupBy().pivot("source", ["reasoning", "general"]).agg(F.first("length"))
    general = F.lit(min(emitted, total)) - taken
    return wide.select(F.lit(min(emitted, total)).cast("long").alias("total_tokens"), taken.alias("reasoning_tokens"), general.cast("long").alias("general_tokens"), F.pmod(taken, F.col("reasoning")).alias("reasoning_cursor"), F.pmod(general, F.col("general")).cast("long").alias("general_cursor"))


def packed(tokens: DataFrame, length: int, position: str = "position") -> DataFrame:
    """sequence, tokens (in order) of full sequences; the incomplete tail goes."""
    grouped = tokens.groupBy(F.expr(f"{position} div {length}").alias("sequence")).agg(F.sort_array(F.collect_list(F.struct(position, "token"))).alias("x"))
    return grouped.where(F.size("x") == length).select("sequence", F.col("x.token").alias("tokens"))


def token_dtype(vocabulary: Column) -> Column:
    return F.when(vocabulary <= 65_535, "uint16").otherwise("uint32")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert: the last row per key by order, folded map-side."""
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return out.select(*key, *[F.col("r")[c].alias(c) for c in rest])


def duplicates_in_request(turns: DataFrame, request: str, turn: str, query: str) -> DataFrame:
    """turns with duplicate: whether an earlier turn of the request asked the same."""
    w = Window.partitionBy(request, F.lower(query)).orderBy(turn)
    return turns.withColumn("duplicate", F.row_number().over(w) > 1)
