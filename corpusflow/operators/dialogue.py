"""Tool calls, answers with citations, masks and collation of training turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

CALL, END_CALL, CITATION, ANSWER = "<|tool_call|>", "<|end_tool_call|>", "<|citation|>", "<|answer|>"


def tool_call(text: Column) -> Column:
    """struct(name, query, top_k) of the one call in a text; null if there is
    none or more than one, or its JSON or arguments aren't valid: a name other
    than search, a query that isn't a string of 1 to 500 characters, a top_k
    that isn't a whole number of 1 to 10, anything behind the JSON. As in the
    schema it follows, 5.0, "5" and true are whole numbers too; null isn't."""
    once = lambda t: (F.length(text) - F.length(F.replace(text, F.lit(t)))) == len(t)
    body = F.regexp_extract(text, r"(?s)<\|tool_call\|>(.*?)<\|end_tool_call\|>", 1)
    # Parsed as a list of one, what stands behind the object is an error.
    whole = F.concat(F.lit("["), body, F.lit("]"))
    call = F.try_variant_get(F.try_parse_json(whole), "$[0]", "variant")
    one = F.try_variant_get(F.try_parse_json(whole), "$[1]", "variant").isNull()
    kind = lambda path: F.schema_of_variant(F.try_variant_get(call, path, "variant"))
    query = X.collapsed(F.try_variant_get(call, "$.arguments.query", "string"))
    given = F.try_variant_get(call, "$.arguments.top_k", "variant")
    said = F.try_variant_get(call, "$.arguments.top_k", "string")
    k = F.when(given.isNull(), 5).when(said == "true", 1).otherwise(F.regexp_extract(said, r"^\s*\+?([0-9]{1,9})(?:\.0*)?\s*$", 1).try_cast("int"))
    whole_k = given.isNull() | (F.schema_of_variant(given) != "VOID")
    name = F.try_variant_get(call, "$.name", "string")
    ok = once(CALL) & once(END_CALL) & one & (name == "search") & (kind("$.name") == "STRING") & (kind("$.arguments.query") == "STRING") & F.length(query).between(1, 500) & whole_k & k.between(1, 10)
    return F.when(ok, F.struct(name.alias("name"), query.alias("query"), k.alias("top_k")))


def citations(text: Column) -> Column:
    """Cited ids, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<\|citation\|>([^\s<]+)"), F.lit(1)))


def final_answer(text: Column, known: Column) -> Column:
    """struct(reasoning, answer, cited): reasoning runs from its marker to the
    answer's or the end; the answer is what follows its marker, else the whole
    text. Citations of known ids become [id], others go."""
    reasoning = X.stripped(F.regexp_extract(text, r"(?s)<\|reasoning\|>(.*?)(?=<\|answer\|>|$)", 1))
    at = F.locate(ANSWER, text)
    tail = X.stripped(F.when(at > 0, F.substring(text, at + len(ANSWER), F.length(text))).otherwise(text))
    cited = F.array_intersect(citations(tail), known)
    # Each piece behind a marker begins with an id, which ends at white space or '<'.
    pieces = F.split(tail, r"<\|citation\|>(?=[^\s<])")
    own = lambda p: F.regexp_extract(p, r"^[^\s<]+", 0)
    shown = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(F.array_contains(cited, own(p)), F.concat(F.lit("["), own(p), F.lit("]"))).otherwise(""), F.regexp_replace(p, r"^[^\s<]+", "")))
    answer = X.stripped(F.array_join(F.transform(pieces, shown), ""))
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"), cited.alias("cited"))


def with_citations(rows: DataFrame, cited: str, results: str) -> DataFrame:
    """rows with citations: source_id, title, url, snippet and provider of each
    cited id, in order, copied from the row's results."""
    by_id = lambda i: F.filter(F.col(results), lambda r: r.id == i)[0]
    made = lambda i: F.transform(F.array(by_id(i)), lambda r: F.struct(r.id.alias("source_id"), r.title.alias("title"), r.url.alias("url"), r.snippet.alias("snippet"), r.provider.alias("provider")))[0]
    present = F.filter(F.col(cited), lambda i: F.exists(F.col(results), lambda r: r.id == i))
    return rows.withColumn("citations", F.transform(present, made))


def masked_spans(text: Column) -> Column:
    """array<struct<start, stop>> of the characters that aren't learnt: all before
    the first tool call, or without one before the first reasoning; and each
    tool result with its markers, an unended one to the end of the text."""
    n = F.length(text)
    call, reason = F.locate(CALL, text), F.locate("<|reasoning|>", text)
    first = F.when(call > 0, call).otherwise(reason) - 1
    head = F.when(first > 0, F.array(F.struct(F.lit(0).alias("start"), first.cast("int").alias("stop"))))
    # Runs from a result's marker to the next end marker; markers inside a run belong to it.
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(<\|tool_result\|>.*?(?:<\|end_tool_result\|>|\z))"), F.lit(1))
    between = F.split(text, r"(?s)<\|tool_result\|>.*?(?:<\|end_tool_result\|>|\z)")
    # Bound in a lambda, the text is cut once, not once per run.
    sizes = F.transform(F.array(F.struct(runs.alias("r"), between.alias("b"))), lambda t: F.transform(t.r, lambda r, i: F.struct(F.length(t.b[i]).alias("gap"), F.length(r).alias("size"))))[0]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    step = lambda s, x: F.struct((s.at + x.gap + x["size"]).alias("at"), F.array_append(s.out, F.struct((s.at + x.gap).cast("int").alias("start"), (s.at + x.gap + x["size"]).cast("int").alias("stop"))).alias("out"))
    results = F.aggregate(sizes, start, step, lambda s: s.out)
    return F.when(n >= 0, F.concat(F.coalesce(head, F.array().cast("array<struct<start:int,stop:int>>")), results))


def trainable(ids: Column, labels: Column) -> Column:
    """Whether an example teaches anything: two ids, and a label behind the first."""
    return (F.size(ids) >= 2) & F.exists(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != -100)


def action_tokens(ids: Column, prompt_length: Column) -> Column:
    return F.size(ids) - prompt_length


def sampled_kl(policy: Column, reference: Column, start: Column) -> Column:
    """Mean of exp(d) - d - 1 over the action tokens, d = reference - policy log
    probabilities; null without action tokens."""
    rest = lambda x: F.slice(x, start + 1, F.greatest(F.size(x) - start, F.lit(0)))
    terms = F.zip_with(rest(policy), rest(reference), lambda p, r: F.exp(r - p) - (r - p) - 1.0)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(terms), F.lit(0))


def policy_loss(policy: Column, reference: Column, start: Column, advantage: Column, coefficient: float) -> Column:
    """-mean(advantage x log probability - coefficient x KL) over the action tokens."""
    rest = F.slice(policy, start + 1, F.greatest(F.size(policy) - start, F.lit(0)))
    mean = F.aggregate(rest, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(rest), F.lit(0))
    return -(advantage * mean - coefficient * sampled_kl(policy, reference, start))


def label_mask(ids: Column, starts: Column, ends: Column, spans: Column) -> Column:
    """Labels: -100 where a token's characters overlap a masked span; tokens of
    no width are never masked."""
    at = F.arrays_zip(ids.alias("id"), starts.alias("a"), ends.alias("b"))
    covered = lambda t, s: (t.b > t.a) & F.exists(s, lambda s: (t.a < s.stop) & (t.b > s.start))
    # Bound in a lambda, the spans are found once per text, not once per token.
    return F.transform(F.array(F.struct(at.alias("at"), spans.alias("spans"))), lambda x: F.transform(x.at, lambda t: F.when(covered(t, x.spans), -100).otherwise(t.id)))[0]


def collated(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """ids and labels padded to the longest row of their batch."""
    widest = rows.groupBy(batch).agg(F.max(F.size("ids")).alias("w"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("w") - F.size(c)))
    return rows.join(widest, batch).withColumns({"ids": fill(F.col("ids"), pad), "labels": fill(F.col("labels"), -100)}).drop("w")


def evidence_budget(rows: DataFrame, request: str, order: str, text: str, budget: int = 12_000) -> DataFrame:
    """rows with used: how many characters of each text fit the request's budget."""
    n = F.length(text)
    before = F.sum(n).over(Window.partitionBy(request).orderBy(order)) - n
    return rows.withColumn("used", F.greatest(F.least(n, F.lit(budget) - before), F.lit(0).cast("long")))
