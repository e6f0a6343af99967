"""Document fingerprints by winnowing, in DataFrame functions only.

A text's tokens are its runs of characters outside space and U+0009..U+000D,
where a character of a script written without spaces is a token by itself. Each
token is hashed once, and each K successive token hashes once more, window by
window along the text (SQL arrays have no running state to take a token out
of); of every WINDOW successive hashes the least is kept, the rightmost of equal
ones, with its position. Two
texts that share K + WINDOW - 1 tokens in a row share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.prefix import range_of
from .common import read_table

K, WINDOW = 5, 16
#: Rows of the table that a bucket holds, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2000, 10_000
TOKEN = r"[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}]|[^\\x20\\x09-\\x0D\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}]+"


def _let(value: str, name: str, body: str) -> str:
    """body with value bound to name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<h: bigint, at: int>> in order of position, of a text column
    that isn't null. A text of fewer than k tokens is one k-gram, one without
    tokens has none; a text of fewer than `window` k-grams keeps one."""
    rolled = ", ".join(f"get(t, i + {j})" for j in range(k))
    # Hashes of 34 bits above a position of 30 (a string can't hold more tokens):
    # one number orders both, and of equal hashes the later position is the lesser.
    grams = f"transform(sequence(0, greatest(size(t) - {k}, 0)), i -> shiftright(xxhash64({rolled}), 30))"
    order = "transform(g, (h, i) -> shiftleft(h, 30) | CAST(1073741823 - i AS BIGINT))"
    steps, width = [], 1
    while width < window:  # minima over 2, 4, 8 ... hashes, then over the window
        step = min(width, window - width)
        steps.append(f"transform(sequence(0, size(m) - 1 - least({step}, size(m) - 1)), i -> least(m[i], m[i + least({step}, size(m) - 1)]))")
        width += step
    body = "array_distinct(m)"
    for s in reversed(steps):
        body = _let(s, "m", body)
    kept = _let(order, "m", body)
    named = f"transform({kept}, o -> named_struct('h', shiftright(o, 30), 'at', 1073741823 - CAST(o & 1073741823 AS INT)))"
    hashes = f"transform(regexp_extract_all({text}, '{TOKEN}', 0), w -> xxhash64(w))"
    return F.expr(_let(hashes, "t", f"IF(size(t) = 0, array(), {_let(grams, 'g', named)})"))


def written(marks: Column) -> Column:
    """Fingerprints as text: hexadecimal hash and position of each."""
    return F.array_join(F.transform(marks, lambda m: F.concat_ws(":", F.lower(F.hex(m.h.bitwiseAND((1 << 34) - 1))), m.at.cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes, 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def with_next(docs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """docs with next_<column>: the values of the row that follows by `order`,
    after the last row those of the first. Of rows with equal order any may
    come first.

    Rows are dealt by ranges of equal counts. The first row of each range is
    also sent, as a guest, to the range before it, so that one sort within
    ranges gives every row its successor.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)).cast("long"))
    n, cuts = docs.agg(F.count("*").alias("n"), F.percentile_approx(key, [i / 256 for i in range(1, 256)], 100_000).alias("c")).first()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    if buckets > 256:
        cuts = docs.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 1_000_000)).first()[0]
    else:
        cuts = (cuts or [])[:: max(1, -(-256 // buckets))]
    cuts = sorted(set(cuts or []))
    bucket = range_of(key, cuts)
    keyed = docs.withColumns({"_key": key, "_bucket": bucket})
    firsts = sorted((r.b, r.k) for r in keyed.groupBy(F.col("_bucket").alias("b")).agg(F.min("_key").alias("k")).collect())  # a row per bucket
    least, earlier = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for i, (b, k) in enumerate(firsts):
        least[b], earlier[b] = k, firsts[i - 1][0]  # the first bucket's go to the last
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_bucket"))
    to = F.when(at(least, "long") == F.col("_key"), at(earlier, "int"))
    copies = F.array_compact(F.array(F.struct(F.col("_bucket").alias("at"), F.lit(0).alias("guest")), F.when(to.isNotNull(), F.struct(to.alias("at"), F.lit(1).alias("guest")))))
    sent = keyed.select(*docs.columns, "_key", F.explode(copies).alias("_to"))
    w = Window.partitionBy("_to.at").orderBy("_to.guest", "_key")
    return sent.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_to.guest = 0").drop("_key", "_to")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of each row of docs.

    The edited text has its last quarter replaced by the beginning of the next
    document by doc_id. Null text is empty, a null id comes before all others;
    of rows with one id any may be next. An empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("marks", fingerprint("body", k, window))
    own = own.withColumn("hashes", F.array_distinct(F.col("marks.h")))
    pair = with_next(own, "doc_id", ["body", "hashes"])
    n = F.length("body")
    q = F.floor(n / 4).cast("int")
    edited = pair.withColumn("edited", F.concat(F.substring(F.col("body"), F.lit(1), n - q), F.substring(F.col("next_body"), F.lit(1), q)))
    marked = edited.withColumn("edited_marks", fingerprint("edited", k, window))
    return marked.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("marks")).alias("fingerprint"),
        written(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.array_distinct(F.col("edited_marks.h"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
