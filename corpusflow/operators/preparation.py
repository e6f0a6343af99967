"""Corpus preparation: verified reasoning documents, general documents, reports."""

from __future__ import annotations

import contextlib
import math
import os
import resource
import signal
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.prefix import running_sum
from ..plans.stage import staged
from . import corpus, quality

#: A prepared document.
DOCUMENT = "text string, source string, verification string"
# Fields that may hold a reference answer, in order, and those that name a domain.
REFERENCES = ("expected_answer", "reference_answer", "ground_truth", "answer")
DOMAINS = ("domain", "task", "category", "problem_type")
# Fixed value: the source whose rows are maths throughout.
MATH_SOURCE = "OpenR1-Math-220k"


def with_text(rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text is neither null nor empty: others are never counted."""
    return rows.where(F.length(column) > 0)


def _field(rows: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")


def reference(rows: DataFrame) -> Column:
    """The first reference field that isn't blank."""
    return F.coalesce(*[F.when(X.stripped(_field(rows, c)) != "", _field(rows, c)) for c in REFERENCES])


def domain(rows: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", *[_field(rows, c) for c in DOMAINS]))


def code_passes(rows: DataFrame, code: str, tests: str, name: str, seconds: float = 3.0) -> DataFrame:
    """rows with a boolean: whether a candidate and its tests exit with 0 in an
    isolated interpreter within the time. This runs code of the rows: it isn't
    a sandbox, and nothing calls it unless asked to."""
    schema = rows.withColumn(name, F.lit(True)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{name: [runs_clean(c, t, seconds) for c, t in zip(f[code], f[tests], strict=True)]})

    return rows.mapInPandas(run, schema)


#: What a candidate's interpreter may use: bytes of memory, and of one file.
MEMORY, FILE = 1 << 31, 1 << 20
_STARTED = "import sys; exec(compile(sys.stdin.read(), 'candidate', 'exec'), {'__name__': '__main__'})"


def runs_clean(code: str | None, tests: str | None, seconds: float = 3.0) -> bool:
    """Whether the code and then its tests end with status 0. They come through the
    input of an interpreter that leads a process group of its own, with limits on
    processor time, memory and files; the whole group is ended with it, and what
    it prints goes nowhere."""

    def limited() -> None:
        resource.setrlimit(resource.RLIMIT_CPU, (math.ceil(seconds) + 1,) * 2)
        resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
        resource.setrlimit(resource.RLIMIT_FSIZE, (FILE, FILE))

    quiet = subprocess.DEVNULL
    job = subprocess.Popen([sys.executable, "-I", "-c", _STARTED], stdin=subprocess.PIPE, stdout=quiet, stderr=quiet, cwd="/", env={"PYTHONHASHSEED": "0"}, start_new_session=True, preexec_fn=limited)
    try:
        job.communicate("\n\n".join((code or "", tests or "")).encode(), timeout=seconds)
    except subprocess.TimeoutExpired:
        return False
    finally:
        with contextlib.suppress(ProcessLookupError):
            os.killpg(job.pid, signal.SIGKILL)
        job.wait()
    return job.returncode == 0


def gated(rows: DataFrame, included: list[str], math_source: str = MATH_SOURCE, run_code: bool = False, longest: int | None = 200_000) -> DataFrame:
    """rows with reason (null: accepted), reasoning, answer_text and verification.

    The gate's first failing test is the reason; what passes it is verified,
    and a failed verification is the reason "<label>_failed". Rows with tests
    run their code only if run_code is set; else they fail verification.
    """
    response = X.stripped(F.coalesce(_field(rows, "response"), F.lit("")))
    first = quality.reasoning_rejection(F.col("source"), F.col("prompt"), F.col("response"), _field(rows, "finish_reason"), included, longest)
    marked = rows.withColumns({"_first": first, "reasoning": X.tag(response, "think"), "answer_text": X.tag(response, "answer"), "_reference": reference(rows), "_domain": domain(rows)})
    tests = F.array_join("tests", "\n") if "tests" in rows.columns and dict(rows.dtypes)["tests"].startswith("array") else _field(rows, "tests")
    marked = marked.withColumn("_tests", tests)
    if run_code:
        own = F.nullif(X.stripped(_field(rows, "code")), F.lit(""))
        marked = marked.withColumn("_code", F.coalesce(own, X.fenced_code(response, F.col("answer_text"))))
        here = F.col("_first").isNull() & F.col("_tests").isNotNull()
        marked = code_passes(marked.where(here), "_code", "_tests", "_ran").unionByName(marked.where(~here).withColumn("_ran", F.lit(True))).drop("_code")
    else:
        marked = marked.withColumn("_ran", F.lit(False))
    routed = quality.verification(F.col("_domain"), F.col("source"), F.col("answer_text"), F.col("_reference"), math_source)
    coded = F.struct(F.col("_ran").alias("verified"), F.lit("local-code-tests").alias("label"))
    marked = marked.withColumn("_v", F.when(F.col("_tests").isNotNull(), coded).otherwise(routed))
    failed = F.when(~F.col("_v.verified"), F.concat("_v.label", F.lit("_failed")))
    return marked.withColumns({"reason": F.coalesce("_first", failed), "verification": F.col("_v.label")}).drop("_first", "_reference", "_domain", "_tests", "_ran", "_v")


def reasoning_documents(checked: DataFrame, *keep: str) -> DataFrame:
    """The documents (and columns to keep) of gated rows without a reason."""
    body = X.reasoning_document(F.col("prompt"), F.col("reasoning"), F.col("answer_text"))
    return checked.where("reason IS NULL").select(*keep, body.alias("text"), "source", "verification")


def general_checked(rows: DataFrame) -> DataFrame:
    """rows with text stripped, and reason. A column `score`, even if null, is
    the education score; `int_score` counts only without it."""
    education = "score" if "score" in rows.columns else "int_score" if "int_score" in rows.columns else None
    column = lambda c: F.col(c) if c and c in rows.columns else None
    clean = with_text(rows).withColumn("text", X.stripped(F.col("text")))
    reason = quality.general_rejection(F.col("text"), column("language"), column("language_score"), column(education))
    return clean.withColumn("reason", reason)


def general_documents(checked: DataFrame, source: str, *keep: str) -> DataFrame:
    return checked.where("reason IS NULL").select(*keep, "text", F.lit(source).alias("source"), F.lit("upstream-edu-filtered").alias("verification"))


def counters(checked: DataFrame) -> DataFrame:
    """rows_seen, rows_accepted, rows_rejected, and maps in order of their keys:
    rejected by reason, accepted by source. One row; partial sums are made map-side."""
    per = checked.groupBy(F.coalesce("reason", F.lit("")).alias("reason"), F.when(F.col("reason").isNull(), F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    one = lambda k, condition: F.map_from_entries(F.array_sort(F.collect_list(F.when(condition, F.struct(k, "n")))))
    reasons = per.where("reason <> ''").groupBy("reason").agg(F.sum("n").alias("n")).select(F.col("reason").alias("k"), "n", F.lit(True).alias("bad"))
    sources = per.where("reason = ''").select(F.col("source").alias("k"), "n", F.lit(False).alias("bad"))
    both = reasons.unionByName(sources)
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_seen"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("rows_accepted"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("rows_rejected"),
        one("k", F.col("bad")).alias("rejection_reasons"),
        one("k", ~F.col("bad") & F.col("k").isNotNull()).alias("accepted_sources"),
    )


def corpus_selection(docs: DataFrame, prompts: DataFrame | None, cap: int, order: str, tokens: str) -> DataFrame:
    """docs with fate: contaminated, duplicate, kept, truncated or beyond_cap, in
    stream order, and kept (tokens written). Decontamination comes before the
    deduplication, and both before the cap."""
    dirty = corpus.contaminated_pairs(docs.withColumnRenamed(order, "doc_id"), prompts).select(F.col("doc_id").alias(order)).distinct().withColumn("_dirty", F.lit(True)) if prompts is not None else None
    hashed = docs.withColumn("_hash", X.normalized_hash(F.col("text"))).drop("text")
    marked = hashed.join(dirty, order, "left") if dirty is not None else hashed.withColumn("_dirty", F.lit(None).cast("boolean"))
    # Without texts a row is short: firsts, sums and what reads the fates start here.
    marked = staged(marked, "corpus-marked")
    first = marked.where("_dirty IS NULL").groupBy("_hash").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_first"))
    marked = marked.join(first, order, "left").drop("_hash")
    counted = marked.withColumn("_n", F.when(F.col("_first"), F.col(tokens)).otherwise(F.lit(0)).cast("long"))
    seen = running_sum(counted, order, "_n", "_upto")
    before = F.col("_upto") - F.col("_n")
    kept = F.when(F.col("_first") & (before < cap), F.least(F.col("_n"), F.lit(cap) - before)).otherwise(F.lit(0)).cast("long")
    fate = F.when(F.col("_dirty"), "contaminated").when(F.col("_first").isNull(), "duplicate").when(before >= cap, "beyond_cap").when(F.col("_upto") > cap, "truncated").otherwise("kept")
    return seen.withColumns({"fate": fate, "kept": kept}).drop("_dirty", "_first", "_n", "_upto")


def corpus_report(selected: DataFrame) -> DataFrame:
    """One row: tokens, documents, duplicates_removed, contaminated_removed,
    truncated_documents, and written documents by source and by verification."""
    # The fates are read once: a row per source, verification and fate goes on.
    per = staged(selected.groupBy("source", "verification", "fate").agg(F.sum("kept").alias("kept"), F.count("*").alias("n")), "corpus-fates")
    written = F.col("fate").isin("kept", "truncated")
    rows = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    fates = per.agg(
        F.coalesce(F.sum("kept"), F.lit(0)).alias("tokens"),
        rows(written).alias("documents"),
        rows(F.col("fate") == "duplicate").alias("duplicates_removed"),
        rows(F.col("fate") == "contaminated").alias("contaminated_removed"),
        rows(F.col("fate") == "truncated").alias("truncated_documents"),
    )

    def by(column: str, name: str) -> DataFrame:
        counts = per.where(written & F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    # One row each.
    return fates.join(F.broadcast(by("source", "source_documents"))).join(F.broadcast(by("verification", "verification")))
