"""Queries of tool calls, answers, trajectories, masks, rollouts and reports.

Conversations stand in for generated texts: calls, citations and traces are
built from their columns, alike in both languages.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import corpus, dialogue, evaluation, grounded, judge, rollouts, trajectories
from .plans import stage
from .registry import query, table
from .streaming import stateful

SPACE = X.SPACE
STRIP = rf"regexp_replace(%s, '^{SPACE}+|{SPACE}+$', '', 'g')"
COLLAPSE = rf"trim(regexp_replace(%s, '{SPACE}+', ' ', 'g'))"
ARTICLE = r"regexp_replace(%s, '(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g')"
NORM = "trim(regexp_replace(" + ARTICLE % (ARTICLE % "lower(%s)") + ", '[^a-z0-9]+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda w: w <> '')"
F1 = "CASE WHEN len(p) = 0 OR len(a) = 0 THEN (len(p) = 0 AND len(a) = 0)::INT ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(a, lambda y: y = x))))), 0) / (len(p) + len(a)) END"


def letters(c):
    return F.regexp_replace(c, "[^A-Za-z ]", "")


LETTERS = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


def _calls(spark, sf_dir):
    """Well-formed calls and ways of getting them wrong, by conversation."""
    rows = table(spark, sf_dir, "conversations")
    k, kind = (F.col("conv_id") + F.col("turn")) % 13, F.col("conv_id") % 6
    body = F.concat(F.lit('{"name":"'), F.when(kind == 1, "run").otherwise("search"), F.lit('","arguments":{"query":'), F.when(kind == 3, "5").otherwise(F.concat(F.lit('"'), letters(F.col("text")), F.lit('"'))), F.lit(',"top_k":'), k, F.lit("}}"), F.when(kind == 2, " junk").otherwise(""))
    call = F.concat(F.lit("x<|tool_call|>"), body, F.lit("<|end_tool_call|>"))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.concat(call, call)).otherwise(call).alias("t"))


@query(f"SELECT conv_id, turn, CASE WHEN ok THEN q END AS query, CASE WHEN ok THEN k END AS top_k FROM (SELECT conv_id, turn, ((conv_id + turn) % 13)::INT AS k, {COLLAPSE % LETTERS} AS q, conv_id % 6 IN (0, 5) AND (conv_id + turn) % 13 BETWEEN 1 AND 10 AND length({COLLAPSE % LETTERS}) BETWEEN 1 AND 500 AS ok FROM conversations)")
def tool_call_parse(spark, sf_dir):
    return _calls(spark, sf_dir).select("conv_id", "turn", dialogue.tool_call(F.col("t")).alias("c")).select("conv_id", "turn", "c.query", "c.top_k")


@query(rf"SELECT conv_id, turn, {STRIP % 'text'} AS reasoning, 'See [a:1] and  or' || CASE WHEN turn = 2 THEN ' [b:2]' ELSE '' END AS answer, 'a:1' || CASE WHEN turn = 2 THEN ',b:2' ELSE '' END AS cited FROM conversations")
def final_response_parse(spark, sf_dir):
    t = F.concat(F.lit("<|reasoning|>"), "text", F.lit("<|answer|>See <|citation|>a:1 and <|citation|>a:10 or <|citation|>b:"), F.col("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    out = rows.select("conv_id", "turn", dialogue.final_answer(F.col("t"), F.array(F.lit("a:1"), F.lit("b:2"))).alias("a"))
    return out.select("conv_id", "turn", "a.reasoning", "a.answer", F.array_join("a.cited", ",").alias("cited"))


@query("SELECT conv_id, turn, 'c' || (turn % 3) AS source_id, role AS title, 'p' AS provider FROM conversations WHERE turn % 3 < 2")
def cited_metadata(spark, sf_dir):
    result = lambda k: F.struct(F.lit(f"c{k}").alias("id"), F.col("role").alias("title"), F.lit("u").alias("url"), F.lit("s").alias("snippet"), F.lit("p").alias("provider"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.concat(F.lit("c"), F.col("turn") % 3)).alias("cited"), F.array(result(0), result(1)).alias("results"))
    out = dialogue.with_citations(rows, "cited", "results")
    return out.select("conv_id", "turn", F.explode("citations").alias("c")).select("conv_id", "turn", "c.source_id", "c.title", "c.provider")


HEAD = "'<|problem|>' || text"
TAILED = f"{HEAD} || '<|tool_call|>c<|end_tool_call|><|tool_result|>' || text || '<|end_tool_result|>mid<|tool_result|>open ' || text"


@query(f"SELECT conv_id, turn, length({TAILED})::BIGINT AS n, (length({HEAD}) + length('<|tool_result|><|end_tool_result|>') + length(text) + length('<|tool_result|>open ') + length(text))::BIGINT AS masked FROM conversations")
def sft_label_mask(spark, sf_dir):
    t = F.concat(F.lit("<|problem|>"), "text", F.lit("<|tool_call|>c<|end_tool_call|><|tool_result|>"), "text", F.lit("<|end_tool_result|>mid<|tool_result|>open "), "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    # One token per character.
    at = F.sequence(F.lit(0), F.length("t") - 1)
    labels = dialogue.label_mask(F.transform(at, lambda i: F.lit(1)), at, F.transform(at, lambda i: i + 1), dialogue.masked_spans(F.col("t")))
    return rows.select("conv_id", "turn", F.length("t").cast("long").alias("n"), F.size(F.filter(labels, lambda x: x == -100)).cast("long").alias("masked"))


@query("SELECT conv_id, turn FROM conversations WHERE turn >= 2 AND conv_id % 3 <> 0")
def sft_trainable(spark, sf_dir):
    """Examples of as many tokens as the turn, of which only the last may be learnt."""
    rows = table(spark, sf_dir, "conversations")
    ids = F.when(F.col("turn") > 0, F.sequence(F.lit(1).cast("long"), F.col("turn"))).otherwise(F.array().cast("array<long>"))
    labels = F.transform(ids, lambda i: F.when((i == F.col("turn")) & (F.col("conv_id") % 3 != 0), i).otherwise(-100))
    return rows.select("conv_id", "turn", ids.alias("ids"), labels.alias("labels")).where(dialogue.trainable(F.col("ids"), F.col("labels"))).select("conv_id", "turn")


@query("SELECT conv_id, turn, least(60 * turn + 1, 100)::BIGINT AS n, list_sum(CASE WHEN 60 * turn + 1 <= 100 THEN range(0, 60 * turn + 1) ELSE list_concat(range(0, 25), range(60 * turn + 1 - 75, 60 * turn + 1)) END)::BIGINT AS total FROM conversations")
def prompt_head_and_tail(spark, sf_dir):
    cut = X.head_and_tail(F.sequence(F.lit(0).cast("long"), 60 * F.col("turn")), 100)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(cut).cast("long").alias("n"), F.aggregate(cut, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("WITH d AS (SELECT event_id, list_transform(range(0, 4), lambda i: -(value + i) / 1000) AS p, list_transform(range(0, 4), lambda i: -(value + i * i) / 1000) AS r FROM events) SELECT event_id, round(list_sum(list_transform(range(2, 5), lambda i: exp(r[i] - p[i]) - (r[i] - p[i]) - 1)) / 3, 9) AS kl, 3 AS action_tokens, round(-(0.5 * list_sum(p[2:4]) / 3 - 0.1 * list_sum(list_transform(range(2, 5), lambda i: exp(r[i] - p[i]) - (r[i] - p[i]) - 1)) / 3), 9) AS loss FROM d")
def sampled_kl(spark, sf_dir):
    at = F.sequence(F.lit(0), F.lit(3))
    logs = lambda f: F.transform(at, lambda i: -(F.col("value") + f(i)) / 1000)
    rows = table(spark, sf_dir, "events").select("event_id", logs(lambda i: i).alias("p"), logs(lambda i: i * i).alias("r"))
    p, r = F.col("p"), F.col("r")
    return rows.select("event_id", F.round(dialogue.sampled_kl(p, r, F.lit(1)), 9).alias("kl"), dialogue.action_tokens(p, F.lit(1)).alias("action_tokens"), F.round(dialogue.policy_loss(p, r, F.lit(1), F.lit(0.5), 0.1), 9).alias("loss"))


EVIDENCE = "'{\"id\": ' || to_json('doc:' || doc_id)::VARCHAR || ', \"title\": ' || to_json(source)::VARCHAR || ', \"url\": ' || to_json('https://e/' || doc_id)::VARCHAR || ', \"snippet\": ' || to_json(left(text, 500))::VARCHAR || ', \"content\": ' || to_json(left(text, 700))::VARCHAR || ', \"score\": 1.0, \"provider\": \"local\", \"published_at\": null, \"score_components\": {}}'"
CALL = "'<|tool_call|>{\"name\":\"search\",\"arguments\":{\"query\":\"' || %s || '\",\"top_k\":' || %s || '}}<|end_tool_call|>' || chr(10)"
BLOCK = f"'<|tool_result|>' || chr(10) || '{trajectories.BANNER}' || chr(10) || '[' || %s || ']' || chr(10) || '<|end_tool_result|>' || chr(10)"


@query(rf"""WITH d AS (SELECT doc_id, {STRIP % 'left(text, 50)'} AS q, lang AS a, source AS s, {EVIDENCE} AS e FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256('<|problem|>' || chr(10) || q || chr(10) || CASE doc_id % 3 WHEN 0 THEN '<|reasoning|>why<|answer|>' || a
 WHEN 1 THEN {CALL % ('s', '1')} || {BLOCK % 'e'} || '<|reasoning|>why<|answer|>' || a || ' <|citation|>doc:' || doc_id
 ELSE {CALL % ('s', '5')} || {BLOCK % "''"} || {CALL % ("s || ' again'", '1')} || {BLOCK % 'e'} || '<|reasoning|>why<|answer|>' || a || ' <|citation|>doc:' || doc_id END) AS text_sha256 FROM d""")
def trajectory_documents(spark, sf_dir):
    evidence = F.array(F.struct(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("source").alias("title"), F.concat(F.lit("https://e/"), "doc_id").alias("url"), F.col("text").alias("snippet"), F.col("text").alias("content"), F.lit(1.0).alias("score"), F.lit("local").alias("provider"), F.lit(None).cast("string").alias("published_at"), F.create_map().cast("map<string,double>").alias("score_components")))
    none = F.array().cast(f"array<{trajectories.RESULT}>")
    one = lambda q, e: F.struct(q.alias("query"), e.cast(f"array<{trajectories.RESULT}>").alias("evidence"))
    s, k = F.col("source"), F.col("doc_id") % 3
    kind = f"array<struct<query:string,evidence:array<{trajectories.RESULT}>>>"
    searches = F.when(k == 0, F.array().cast(kind)).when(k == 1, F.array(one(s, evidence)).cast(kind)).otherwise(F.array(one(s, none), one(F.concat(s, F.lit(" again")), evidence)).cast(kind))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(trajectories.document(F.left("text", F.lit(50)), F.col("lang"), searches, F.lit(" why ")), 256).alias("text_sha256"))


@query("SELECT conv_id, turn, '<|tool_result|>{\"error\":' || to_json(text)::VARCHAR || '}<|end_tool_result|>' AS block FROM conversations")
def tool_errors(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", trajectories.formatted_error(F.col("text")).alias("block"))


JUDGED = "(event_id % 13) / 10.0"


@query(f"""SELECT event_id, CASE WHEN k > 6 AND s <= 1 THEN s ELSE 0 END::DOUBLE AS answer_correctness, k > 6 AND s <= 1 AS valid,
CASE k WHEN 0 THEN 'judge output contained leading text' WHEN 1 THEN 'judge output contained trailing text' WHEN 2 THEN 'judge output used an invalid schema' WHEN 3 THEN CASE WHEN s > 1 THEN 'judge field answer_correctness was outside [0, 1]' ELSE 'judge field evidence_support was not numeric' END WHEN 4 THEN 'judge output did not contain JSON' WHEN 5 THEN CASE WHEN s > 1 THEN 'judge field answer_correctness was outside [0, 1]' ELSE 'judge reason was not a string' END WHEN 6 THEN 'judge output contained invalid JSON'
ELSE CASE WHEN s > 1 THEN 'judge field answer_correctness was outside [0, 1]' ELSE event_type END END AS reason FROM (SELECT event_id, event_type, event_id % 11 AS k, {JUDGED} AS s FROM events)""")
def judge_outputs(spark, sf_dir):
    k, s = F.col("event_id") % 11, (F.col("event_id") % 13) / 10.0
    body = F.concat(F.lit('{"answer_correctness": '), s, F.lit(', "evidence_support": '), F.when(k == 3, "true").otherwise("0.5"), F.lit(', "search_quality": 1, "reason": '), F.when(k == 5, "1").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))), F.when(k == 2, ', "more": 1').otherwise(""), F.when(k == 6, "").otherwise("}"))
    text = F.when(k == 0, F.concat(F.lit("so: "), body)).when(k == 1, F.concat(body, F.lit(" done"))).when(k == 4, "none").otherwise(body)
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", judge.judge_score(text).alias("j")).select("event_id", "j.answer_correctness", "j.valid", "j.reason")


@query("WITH u AS (SELECT conv_id, turn, text, greatest(least(length(text), 1000 - (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))), 0) AS n FROM conversations) SELECT conv_id, string_agg(turn || ':' || n, ',' ORDER BY turn) AS used FROM u WHERE n > 0 GROUP BY conv_id")
def judge_evidence(spark, sf_dir):
    result = F.struct(F.col("turn").cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("content"), F.lit("s").alias("snippet"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array(result).alias("results")))).alias("trace"))
    found = rows.select("conv_id", judge.evidence(F.col("trace"), 1000).alias("e"))
    return found.select("conv_id", F.array_join(F.transform("e", lambda r: F.concat(r.id, F.lit(":"), F.length(r.content).cast("string"))), ",").alias("used"))


HISTORY = """t AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR turn >= 6 THEN 0 WHEN turn % 4 = 3 THEN 1 ELSE 2 END AS kind, lower(left(text, 1)) AS q, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'empty' END AS outcome FROM conversations),
e AS (SELECT *, coalesce(max((kind = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ended FROM t),
n AS (SELECT *, sum((kind = 2 AND NOT ended)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS nth, row_number() OVER (PARTITION BY conv_id, CASE WHEN kind = 2 THEN q END, kind = 2 ORDER BY turn) AS again FROM e),
h AS (SELECT conv_id, turn, CASE WHEN ended THEN 'after_end' WHEN kind = 0 THEN 'answer' WHEN kind = 1 THEN 'invalid' WHEN nth > 3 THEN 'search_limit' WHEN again > 1 THEN 'rejected' ELSE outcome END AS status, kind, ended, nth FROM n)"""


def _history(spark, sf_dir):
    call = F.concat(F.lit('<|tool_call|>{"name":"search","arguments":{"query":"'), F.left("text", F.lit(1)), F.lit('"}}<|end_tool_call|>'))
    text = F.when((F.col("role") == "system") | (F.col("turn") >= 6), F.lit("done")).when(F.col("turn") % 4 == 3, "<|tool_call|>{<|end_tool_call|>").otherwise(call)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), "turn", text.alias("text"), F.lit("local").alias("mode"), F.lit(3).alias("max_searches"), F.when(F.col("turn") % 2 == 0, "ok").otherwise("empty").alias("outcome"))
    return rollouts.history(rows)


@query(f"WITH {HISTORY} SELECT conv_id, turn, status, sum((kind = 2 AND NOT ended AND nth <= 3)::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS searches_used FROM h")
def turn_history(spark, sf_dir):
    return _history(spark, sf_dir).select(F.col("request_id").alias("conv_id"), "turn", "status", F.col("searches_used").cast("long").alias("searches_used"))


@query(f"""WITH {HISTORY}, s AS (SELECT conv_id, turn, CASE WHEN status = 'search_limit' THEN 'search_limit' WHEN status = 'invalid' AND sum((kind = 1 AND NOT ended)::INT) OVER (PARTITION BY conv_id ORDER BY turn) >= 2 THEN 'invalid_tool' END AS f FROM h)
SELECT conv_id, coalesce(max_by(f, turn) FILTER (WHERE f IS NOT NULL), 'answer') AS finish_reason FROM s GROUP BY conv_id""")
def finish_reasons(spark, sf_dir):
    return rollouts.finish_reason(_history(spark, sf_dir)).select(F.col("request_id").alias("conv_id"), "finish_reason")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round, CASE WHEN role = 'system' THEN 0 WHEN turn % 3 = 2 THEN 1 ELSE 2 END AS kind FROM conversations),
e AS (SELECT *, round > 5 OR coalesce(max((kind = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ended FROM t),
n AS (SELECT *, sum((kind = 2 AND NOT ended)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS nth, sum((kind = 1 AND NOT ended)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS bad FROM e),
f AS (SELECT conv_id, turn, CASE WHEN ended OR kind = 0 THEN NULL WHEN round = 5 OR (kind = 2 AND nth > 1) THEN 'search_limit' WHEN kind = 1 AND bad >= 2 THEN 'invalid_tool' END AS f FROM n)
SELECT conv_id, coalesce(max_by(f, turn) FILTER (WHERE f IS NOT NULL), 'answer') AS finish_reason FROM f GROUP BY conv_id""")
def spent_rounds(spark, sf_dir):
    """Loops of one search, thus of five rounds, after which nothing is replayed."""
    call = F.concat(F.lit('<|tool_call|>{"name":"search","arguments":{"query":"'), F.col("turn").cast("string"), F.lit('"}}<|end_tool_call|>'))
    text = F.when(F.col("role") == "system", "done").when(F.col("turn") % 3 == 2, "<|tool_call|>{<|end_tool_call|>").otherwise(call)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), "turn", text.alias("text"), F.lit("local").alias("mode"), F.lit(1).alias("max_searches"), F.lit("ok").alias("outcome"))
    return rollouts.finish_reason(rollouts.history(rows)).select(F.col("request_id").alias("conv_id"), "finish_reason")


@query("""SELECT event_id, CASE WHEN m = 'web' AND NOT w THEN 'error' WHEN m = 'local' AND f THEN 'error' WHEN m = 'auto' AND f AND NOT w THEN 'error' WHEN web OR (m <> 'web' AND l > 0) THEN 'ok' ELSE 'empty' END AS status,
CASE WHEN (m = 'web' AND NOT w) OR (m = 'local' AND f) OR (m = 'auto' AND f AND NOT w) THEN NULL WHEN web THEN 'web' ELSE 'local' END AS provider
FROM (SELECT *, (m = 'web' AND w) OR (m = 'auto' AND w AND (f OR l = 0)) AS web FROM (SELECT event_id, ['web', 'local', 'auto'][event_id % 3 + 1] AS m, event_id % 2 AS l, event_id % 5 = 0 AS f, event_id % 7 <> 0 AS w FROM events))""")
def routed_searches(spark, sf_dir):
    i = F.col("event_id")
    mode = F.element_at(F.array(*map(F.lit, ("web", "local", "auto"))), (i % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    r = rollouts.routed(mode, F.when(i % 2 == 1, F.array(F.lit("l"))).otherwise(none), F.array(F.lit("w")), i % 5 == 0, i % 7 != 0)
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.status", "r.provider")


TRACED = f"""c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
w AS (SELECT *, string_split(text, ' ') AS ws, string_split(nxt, ' ') AS ns FROM c WHERE nxt IS NOT NULL),
x AS (SELECT *, list_filter(['i1', 'i' || (turn % 3)], lambda z, i: i = 1 OR z <> 'i1') AS claimed, ['i0'] AS r1, ['i' || (conv_id % 3)] AS r2, CASE WHEN conv_id % 4 = 0 THEN [] ELSE ['i1', 'i2'] END AS s,
 ['ok', 'empty', 'invalid', 'error', 'rejected'][(conv_id + turn) % 5 + 1] AS st1, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'empty' END AS st2, CASE WHEN conv_id % 2 = 0 THEN nxt ELSE text END AS ans FROM w),
y AS (SELECT *, len(list_filter(claimed, lambda z: list_contains(list_concat(r1, r2), z))) AS returned, len(list_filter(claimed, lambda z: list_contains(list_concat(r1, r2), z) AND list_contains(s, z))) AS good,
 st1 IN ('ok', 'empty', 'error') AS v1, {NORM % 'text'} = {NORM % 'ans'} AS em, {WORDS % 'text'} AS p, {WORDS % 'ans'} AS a FROM x),
z AS (SELECT *, {F1} AS f1 FROM y),
q AS (SELECT conv_id, turn, em::INT::DOUBLE AS answer_exact, f1::DOUBLE AS answer_f1, CASE WHEN len(s) = 0 THEN 0 ELSE good / len(claimed) END AS citation_precision, CASE WHEN len(s) = 0 THEN 0 ELSE good / len(s) END AS citation_recall, returned / len(claimed) AS citation_validity,
 (v1::INT + 1) / 2.0 AS valid_tool_calls, (NOT v1)::INT::DOUBLE AS invalid_tool_call,
 (v1 AND em AND (st1 <> 'ok' OR (len(s) > 0 AND NOT list_has_any(r1, s))) AND st2 = 'ok' AND (len(s) = 0 OR list_has_any(r2, s)) AND lower(left(text, 10)) <> lower(left(text, 12)))::INT::DOUBLE AS query_recovery, (conv_id % 3 = 0)::INT::DOUBLE AS unnecessary_search FROM z)"""
TOTAL = "answer_exact + 0.25 * answer_f1 + 0.2 * (citation_precision + citation_recall + citation_validity) + 0.1 * (valid_tool_calls + query_recovery) - 0.1 * unnecessary_search - 0.25 * invalid_tool_call - 0.02 * 2"


def _parts(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c, t = F.col("conv_id"), F.col("turn")
    status = F.element_at(F.array(*map(F.lit, ("ok", "empty", "invalid", "error", "rejected"))), ((c + t) % 5 + 1).cast("int"))
    step = lambda q, s, ids: F.struct(q.alias("query"), s.alias("status"), F.array(ids).alias("result_ids"))
    rows = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt IS NOT NULL")
    rows = rows.select(
        "conv_id", "turn", F.col("text").alias("prediction"), F.when(c % 2 == 0, F.col("nxt")).otherwise(F.col("text")).alias("answer"),
        F.concat(F.lit("<|citation|>i1 <|citation|>i"), t % 3).alias("raw"),
        F.array(step(F.left("text", F.lit(10)), status, F.lit("i0")), step(F.left("text", F.lit(12)), F.when(t % 2 == 0, "ok").otherwise("empty"), F.concat(F.lit("i"), c % 3))).alias("trace"),
        F.when(c % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("i1"), F.lit("i2"))).alias("supporting_ids"), (c % 3 != 0).alias("search_required"), F.lit(2).alias("searches_used"),
    )
    parts = rollouts.parts(rows)
    return parts.withColumn("reward", evaluation.reward(parts))


PARTS = ("answer_exact", "answer_f1", "citation_precision", "citation_recall", "citation_validity", "valid_tool_calls", "invalid_tool_call", "query_recovery", "unnecessary_search")


@query(f"WITH {TRACED} SELECT conv_id, turn, {', '.join(f'round({p}, 6)::DOUBLE AS {p}' for p in PARTS)}, round({TOTAL}, 6) AS reward FROM q")
def trace_rewards(spark, sf_dir):
    return _parts(spark, sf_dir).select("conv_id", "turn", *[F.round(p, 6).alias(p) for p in PARTS], F.round("reward", 6).alias("reward"))


@query(f"WITH {TRACED}, r AS (SELECT *, {TOTAL} AS reward FROM q) SELECT conv_id, count(*) AS n, round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, round(avg(answer_f1), 6) AS mean_answer_f1 FROM r GROUP BY conv_id")
def reward_report(spark, sf_dir):
    out = rollouts.group_report(_parts(spark, sf_dir), "conv_id", ["answer_f1"])
    return out.select("conv_id", "n", *[F.round(c, 6).alias(c) for c in ("reward_mean", "reward_std", "mean_answer_f1")])


GROUNDED = f"""c AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
m AS (SELECT *, string_split(text, ' ') AS ws, string_split(nxt, ' ') AS ns FROM c WHERE nxt IS NOT NULL),
g AS (SELECT *, ws[1:6] AS rl, ns[1:5] AS sl, CASE WHEN turn % 3 = 0 THEN [] ELSE ws[2:4] END AS cl, turn % 3 AS nq FROM m),
d AS (SELECT role, turn, length(text) / 10.0 AS el, nq, conv_id % 5 <> 0 AS req, conv_id % 2 = 0 AS found, text AS said, CASE WHEN conv_id % 7 = 0 THEN text ELSE nxt END AS wanted, list_filter(rl, lambda x, i: list_position(rl, x) = i) AS r, list_distinct(sl) AS s, list_distinct(cl) AS c FROM g),
e AS (SELECT *, {NORM % 'said'} = {NORM % 'wanted'} AS em, {WORDS % 'said'} AS p, {WORDS % 'wanted'} AS a, list_transform(r, lambda x, i: CASE WHEN list_contains(s, x) THEN 1 / log2(i + 1) ELSE 0 END) AS gain, len(list_filter(c, lambda x: list_contains(s, x))) AS cs, len(list_filter(c, lambda x: list_contains(r, x))) AS cr FROM d),
h AS (SELECT *, em::INT AS answer_exact_match, {F1} AS answer_token_f1, len(list_filter(gain, lambda v: v > 0)) / len(s) AS retrieval_recall, coalesce(1 / list_min(list_transform(gain, lambda v, i: CASE WHEN v > 0 THEN i END)), 0) AS retrieval_mrr,
 list_sum(gain) / list_sum(list_transform(range(1, 1 + least(len(s), len(r))), lambda i: 1 / log2(i + 1))) AS retrieval_ndcg, CASE WHEN len(c) > 0 THEN cs / len(c) ELSE 0 END AS citation_precision, cs / len(s) AS citation_recall, CASE WHEN len(c) > 0 THEN cr / len(c) ELSE 1 END AS citation_validity,
 (nq > 0)::INT AS search_rate, (nq > 0 AND NOT req)::INT AS unnecessary_search_rate, nq AS total, CASE WHEN turn % 4 = 0 THEN nq ELSE least(nq, 1) END AS valid, CASE WHEN turn % 4 > 0 THEN el END AS elapsed FROM e)"""


@query(f"""WITH {GROUNDED} SELECT role AS search_mode, count(*) AS count, {', '.join(f'round(avg({c}), 6)::DOUBLE AS {c}' for c in grounded.MEANS)}, round(coalesce(sum(valid) / nullif(sum(total), 0), 1), 6) AS valid_tool_call_rate,
round(sum((nq > 1 AND found)::INT) / greatest(sum((nq > 1)::INT), 1), 6) AS query_recovery_rate, round(coalesce(quantile_cont(elapsed, 0.5), 0), 6) AS latency_p50_seconds, round(coalesce(quantile_cont(elapsed, 0.95), 0), 6) AS latency_p95_seconds FROM h GROUP BY ROLLUP (role)""")
def grounded_report(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t, c = F.col("turn"), F.col("conv_id")
    words, none = F.split("text", " "), F.array().cast("array<string>")
    rows = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt IS NOT NULL")
    nq = (t % 3).cast("int")
    rows = rows.select(
        F.col("role").alias("search_mode"), F.col("text").alias("prediction"), F.when(c % 7 == 0, F.col("text")).otherwise(F.col("nxt")).alias("answer"), F.array_repeat(F.lit("q"), nq).alias("queries"),
        F.when(t % 4 > 0, F.least(nq, F.lit(1))).cast("long").alias("valid_tool_calls"), F.slice(words, 1, 6).alias("retrieved_ids"), F.slice(F.split("nxt", " "), 1, 5).alias("supporting_ids"),
        F.when(t % 3 == 0, none).otherwise(F.slice(words, 2, 3)).alias("cited_ids"), (c % 5 != 0).alias("search_required"), (c % 2 == 0).alias("answer_found"), F.when(t % 4 > 0, F.length("text") / 10.0).alias("elapsed_seconds"),
    )
    return grounded.report(rows).select("search_mode", "count", *[F.round(f, 6).alias(f) for f in grounded.FIELDS])


@query("SELECT item_id, m AS search_mode FROM benchmark, (VALUES ('off'), ('local')) v(m)")
def matched_examples(spark, sf_dir):
    return grounded.matched(table(spark, sf_dir, "benchmark")).select("item_id", "search_mode")


@query(f"SELECT conv_id, turn, {COLLAPSE % "replace(replace(text || ' [x:1] tail [x:10]', '[x:1]', ' '), '[y]', ' ')"} AS clean FROM conversations")
def without_citations(spark, sf_dir):
    t = F.concat("text", F.lit(" [x:1] tail [x:10]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.without_citations(t, F.array(F.lit("x:1"), F.lit("y"))).alias("clean"))


@query("""WITH r AS (SELECT user_id::VARCHAR AS key, epoch(ts) AS t, event_id, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS kind, event_type AS payload FROM events),
p AS (SELECT key, t, max_by(payload, event_id) AS payload FROM r WHERE kind = 'put' GROUP BY 1, 2)
SELECT g.event_id, coalesce(p.t + 3600 > g.t, false) AS hit, CASE WHEN p.t + 3600 > g.t THEN p.payload END AS payload FROM r g ASOF LEFT JOIN p ON g.key = p.key AND g.t >= p.t WHERE g.kind = 'get'""")
def stream_cache(spark, sf_dir):
    from .queries import _stream

    i = F.col("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    requests = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), at.alias("at"), F.when(i % 3 == 0, "put").otherwise("get").alias("kind"), (at + 3600).alias("expires"), "event_type", "event_id")
    # A get is known by its key and time; its payload is what it asks for.
    asked = requests.withColumn("payload", F.col("event_type"))
    answers = stateful.written(spark, stateful.cache(asked.drop("event_type", "event_id")), "append", stage.scratch(spark))
    gets = table(spark, sf_dir, "events").where("event_id % 3 <> 0").select("event_id", F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("at"))
    return gets.join(answers, ["key", "at"]).select("event_id", "hit", "payload")


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_id % 4 >= 2) AS errors, count(*) FILTER (WHERE event_id % 4 = 1) AS busy FROM events")
def stream_service_counters(spark, sf_dir):
    from .queries import _stream

    i = F.col("event_id") % 4
    rows = _stream(spark, sf_dir, "events").select(F.when(i == 0, 200).when(i == 1, 429).when(i == 2, 503).otherwise(504).alias("status"))
    return stateful.written(spark, stateful.service_counters(rows), "complete", stage.scratch(spark))


@query("SELECT user_id AS run, max(event_id) AS step, max_by(value, event_id) AS loss FROM events GROUP BY 1")
def stream_metrics_log(spark, sf_dir):
    from .queries import _stream

    rows = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return stateful.written(spark, stateful.metrics_by_run(rows), "complete", stage.scratch(spark))


@query("SELECT e AS epoch, doc_id FROM documents, range(1, 3) t(e) WHERE e > 1 OR doc_id >= 100")
def resumed_epochs(spark, sf_dir):
    return stateful.resumed_epochs(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3, 1, 100).select("epoch", "doc_id")


@query("WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user') SELECT conv_id, count(*) AS n, count(DISTINCT t) AS fresh FROM q GROUP BY 1")
def fresh_queries(spark, sf_dir):
    turns = corpus.duplicates_in_request(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", "turn", "text")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(~F.col("duplicate")).alias("fresh"))
