"""Quality rules by host: the failures of each rule are counted per domain, their
rates shrunk with an empirical beta prior, and the verdicts joined back to
documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, staged, text_words

#: The fixed base rule: fewer words, or a larger share (%) of repeated ones, fails.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: A host goes if its shrunk failure rate passes this.
HOST_LIMIT = 0.5
#: Symbols in 100 characters, and repeated lines per 100 words, beyond which a document is doubtful.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 2
RULES = ("rule_base", "rule_symbols", "rule_lines")
SALTS = 16
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "uint64")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The COUNTS of a whole text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text_words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
    )


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "uint64")
    if len(number) == len(words):
        return 0
    with np.errstate(over="ignore"):
        h = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        sums = np.zeros(n, "uint64")
        for j in range(window):
            sums += h[j : j + n] * _ODD[j % 8]
    order = np.sort(sums)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, "int64")
    at = np.flatnonzero(np.isin(sums, twice))
    edges[at] += 1
    edges[at + window] -= 1
    return int((edges.cumsum()[:-1] > 0).sum())


def measure(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host, COUNTS and base_failed of each row; no shuffle."""

    def run(batches):
        for b in batches:
            rows = np.array([counts(t) for t in b.column(2).to_pylist()], "int64").reshape(-1, 5)
            n, again = rows[:, 0], rows[:, 4]
            failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, rows.T.copy()), pa.array(failed)], names=["doc_id", "host", *COUNTS, "base_failed"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), "text"), run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean")


def with_rules(measured: DataFrame) -> DataFrame:
    """measured with a 0/1 column per rule: the base rule; more than MOST_SYMBOLS
    symbols in 100 characters of words; two or more repeated lines, and more
    than MOST_DUP_LINES per 100 words."""
    n = F.greatest("n_words", F.lit(1))
    symbols = (F.col("n_words") > 0) & (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars"))
    lines = (F.col("n_dup_lines") >= 2) & (100 * F.col("n_dup_lines") > MOST_DUP_LINES * n)
    return measured.withColumns({"rule_base": F.col("base_failed").cast("long"), "rule_symbols": symbols.cast("long"), "rule_lines": lines.cast("long")})


def host_rates(measured: DataFrame, rule: str = "rule_base") -> DataFrame:
    """host, n, failed, shrunk and pooled (double) per host, for one rule. The
    prior's two parameters come from all hosts by moments: the pooled rate, and
    the spread of host rates beyond what chance gives. Without spread all hosts
    get the pooled rate; without rows there are no hosts. Null is a host of its
    own."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(rule).alias("failed"))
    t = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"), F.sum(F.col("failed") * F.col("failed").cast("double") / F.col("n")).alias("ff")).first()
    a, b = prior(t.hosts, t.n or 0, t.failed or 0, t.nn or 0.0, t.ff or 0.0)
    return hosts.withColumns({"shrunk": (F.col("failed") + a) / (F.col("n") + a + b), "pooled": F.lit(a / (a + b))})


def prior(hosts: int, n: int, failed: int, nn: float, ff: float) -> tuple[float, float]:
    """Beta parameters from sums over hosts: rows, failures, rows squared, and
    failures squared by rows."""
    mean = (failed + 0.5) / (n + 1)
    rho = 0.0
    spread = mean * (1 - mean)
    if n and n - nn / n - (hosts - 1) > 0:
        rho = (ff - 2 * mean * failed + mean * mean * n - spread * (hosts - 1)) / (spread * (n - nn / n - (hosts - 1)))
    strength = 1 / min(max(rho, 1e-4), 0.999) - 1
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: Column, limit: float = HOST_LIMIT, salts: int = SALTS) -> DataFrame:
    """doc_id, COUNTS, base_failed, host_rate and kept of each row of docs.

    For each rule the failures of a host's documents give its shrunk rate. A
    host is out if a rate passes `limit`: all its documents go. Else a document
    that fails a softer rule (symbols, repeated lines) goes only where its host
    fails that rule more than hosts do on the whole (the pooled rate): a good
    host gets the benefit of the doubt. What fails the base rule always goes.
    host_rate is the base rule's. Null and empty texts fail the base rule;
    repeated rows count and are judged each; a null source is a host; an empty
    table gives no rows.

    Documents are measured once and the measures staged. The host table may be
    of any size: it is joined by (host, salt), so that a host with a third of
    the rows is dealt over `salts` tasks.
    """
    measured = with_rules(staged(measure(docs, host), "host-rules"))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    rates = None
    for rule in RULES:
        own = host_rates(measured, rule).select(F.col("host").alias("h"), F.col("shrunk").alias(rule + "_rate"), (F.col("shrunk") > F.col("pooled")).alias(rule + "_high"))
        own = own.withColumnRenamed("h", "g") if rates is not None else own
        rates = own if rates is None else rates.join(own, F.col("h").eqNullSafe(F.col("g"))).drop("g")
    rates = rates.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("s"))
    joined = salted.join(rates, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left")
    out = F.greatest(*[F.col(r + "_rate") for r in RULES]) > limit
    doubtful = ((F.col("rule_symbols") == 1) & F.col("rule_symbols_high")) | ((F.col("rule_lines") == 1) & F.col("rule_lines_high"))
    return joined.select("doc_id", *COUNTS, "base_failed", F.col("rule_base_rate").alias("host_rate"), (~F.col("base_failed") & ~out & ~doubtful).alias("kept"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents"), F.col("source"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words > 0 AND 100 * n_symbols > 10 * word_chars AS sym, n_dup_lines >= 2 AND 100 * n_dup_lines > 2 * greatest(n_words, 1) AS dup FROM m),
h AS (SELECT source, r, count(*)::DOUBLE AS n, sum(CASE r WHEN 0 THEN base_failed WHEN 1 THEN sym ELSE dup END::INT)::DOUBLE AS f FROM b, range(0, 3) t(r) GROUP BY source, r),
t AS (SELECT r, count(*) AS hosts, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff, (sum(f) + 0.5) / (sum(n) + 1) AS mu FROM h GROUP BY r),
q AS (SELECT r, mu, 1 / least(greatest(CASE WHEN n - nn / n - (hosts - 1) > 0 THEN (ff - 2 * mu * f + mu * mu * n - mu * (1 - mu) * (hosts - 1)) / (mu * (1 - mu) * (n - nn / n - (hosts - 1))) ELSE 0 END, 0.0001), 0.999) - 1 AS s FROM t),
v AS (SELECT source, max((f + mu * s) / (n + s)) > 0.5 AS out, max(CASE WHEN r = 1 THEN (f + mu * s) / (n + s) > mu END) AS sym_high, max(CASE WHEN r = 2 THEN (f + mu * s) / (n + s) > mu END) AS dup_high FROM h JOIN q USING (r) GROUP BY source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT out AND NOT (sym AND sym_high) AND NOT (dup AND dup_high) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
