"""Gates that give each row the first reason that rejects it, null if none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

LANGUAGES = ("en", "eng", "english")


def _text_rejection(text: Column) -> Column:
    n = F.length(text)
    plain = n - F.length(F.regexp_replace(text, f"{X.UNPRINTABLE}+", ""))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    lines = F.filter(F.transform(F.split(text, X.LINE_END), X.collapsed), lambda x: x != "")
    # Bound in a lambda, the lines are made once.
    repetitive = F.exists(F.array(lines), lambda x: (F.size(x) >= 10) & (F.size(F.array_distinct(x)) * 2 < F.size(x)))
    return (
        F.when(n < 200, "too_short")
        .when(n > 200_000, "too_long")
        .when(plain / n > 0.02, "non_printable")
        .when(alnum / n < 0.25, "low_alphanumeric_ratio")
        .when(repetitive, "repetitive_lines")
    )


def general_rejection(text: Column, language: Column | None = None, language_score: Column | None = None, education: Column | None = None) -> Column:
    """Text tests, cheap ones first; metadata tests where columns are given. A
    missing language counts as English, missing scores pass."""
    reason = F.element_at(F.transform(F.array(text), _text_rejection), 1)  # bound in a lambda, the text is made once
    out = F.when(reason.isNotNull(), reason)
    if language is not None:
        out = out.when(~F.lower(F.coalesce(language, F.lit("en"))).isin(*LANGUAGES), "non_english")
    if language_score is not None:
        out = out.when(language_score < 0.65, "low_language_score")
    if education is not None:
        out = out.when(education < 3.0, "low_education_score")
    return out


def reasoning_rejection(source: Column, prompt: Column, response: Column, finish: Column, included: list[str], longest: int | None = 200_000) -> Column:
    """longest: characters of a prompt and its response; None: any number."""
    p, r = X.stripped(F.coalesce(prompt, F.lit(""))), X.stripped(F.coalesce(response, F.lit("")))
    return (
        F.when(~F.coalesce(source, F.lit("")).isin(*included), "source_not_in_math_code_logic_mix")
        .when(p == "", "missing_prompt")
        .when(r == "", "missing_response")
        .when(F.lit(False) if longest is None else F.length(p) + F.length(r) > longest, "too_long")
        .when(X.tag(r, "think").isNull(), "missing_reasoning")
        .when(X.tag(r, "answer").isNull(), "missing_answer")
        .when((F.coalesce(finish, F.lit("")) != "") & ~finish.isin("stop", "eos_token"), "incomplete_generation")
    )


def verification(domain: Column, source: Column, answer: Column, reference: Column, math_source: str) -> Column:
    """struct(verified, label); rows with tests are left to verify_code."""
    d = F.lower(F.coalesce(domain, F.lit("")))
    has = F.coalesce(F.trim(reference), F.lit("")) != ""
    logic = has & d.rlike("logic|choice|puzzle")
    math = has & ((source == math_source) | d.contains("math"))
    label = F.when(logic, "local-logic-answer").when(math, "local-math-final-answer").when(source == math_source, "upstream-math-verified").otherwise("upstream-curated")
    ok = F.when(logic, F.coalesce(X.choice(answer) == X.choice(reference), F.lit(False))).when(math, X.normalize_math(answer) == X.normalize_math(reference)).otherwise(True)
    return F.struct(ok.alias("verified"), label.alias("label"))


def histogram(rejected: DataFrame, reason: str = "reason") -> DataFrame:
    """reason (accepted where null), n."""
    return rejected.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
