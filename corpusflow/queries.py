"""Registered queries over the driver's tables, with their DuckDB twins.

Turns stand in for answers and event values for losses: those queries exercise
the operators, their numbers mean nothing elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import corpus, dialogue, evaluation, preparation, quality, retrieval, schedules, vectors, web
from .plans import stage
from .plans.prefix import running_sum
from .registry import ORACLE_SQL, QUERIES, query, table
from .streaming import corpus_stream, stateful

FLAGSHIP = "quality_rejection_histogram"

SPACE, ENDS, DARK = X.SPACE, X.LINE_END, X.UNPRINTABLE
STRIP = rf"regexp_replace(%s, '^{SPACE}+|{SPACE}+$', '', 'g')"
COLLAPSE = rf"trim(regexp_replace(%s, '{SPACE}+', ' ', 'g'))"
REASON = rf"""
CASE WHEN length(t) < 200 THEN 'too_short' WHEN length(t) > 200000 THEN 'too_long'
 WHEN (length(t) - length(regexp_replace(t, '{DARK}', '', 'g'))) / length(t) > 0.02 THEN 'non_printable'
 WHEN length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(t) < 0.25 THEN 'low_alphanumeric_ratio'
 WHEN len(ls) >= 10 AND len(list_distinct(ls)) / len(ls) < 0.5 THEN 'repetitive_lines'"""
GATED = rf"g AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '{ENDS}'), lambda x: {COLLAPSE % 'x'}), lambda x: x <> '') AS ls FROM (SELECT *, {STRIP % 'text'} AS t FROM documents WHERE text <> ''))"


@query(f"WITH {GATED} SELECT coalesce({REASON} END, 'accepted') AS reason, count(*) AS n FROM g GROUP BY 1")
def quality_rejection_histogram(spark, sf_dir):
    docs = preparation.with_text(table(spark, sf_dir, "documents"))
    return quality.histogram(docs.select(quality.general_rejection(X.stripped(F.col("text"))).alias("reason")))


@query(f"WITH {GATED} SELECT g.doc_id, {REASON} WHEN lower(coalesce(lang, 'en')) NOT IN ('en', 'eng', 'english') THEN 'non_english' WHEN quality * 4.0 < 3.0 THEN 'low_education_score' END AS reason FROM g LEFT JOIN labels USING (doc_id)")
def quality_gate_with_metadata(spark, sf_dir):
    docs = preparation.with_text(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", quality.general_rejection(X.stripped(F.col("text")), F.col("lang"), education=F.col("quality") * 4.0).alias("reason"))


@query(f"WITH {GATED} SELECT source, count(*) AS seen, count(*) FILTER (WHERE ({REASON} END) IS NULL) AS accepted, count(*) FILTER (WHERE ({REASON} END) IS NOT NULL) AS rejected FROM g GROUP BY source")
def accepted_by_source(spark, sf_dir):
    docs = preparation.with_text(table(spark, sf_dir, "documents")).select("source", quality.general_rejection(X.stripped(F.col("text"))).isNull().alias("ok"))
    return docs.groupBy("source").agg(F.count("*").alias("seen"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


HASH = f"sha256({COLLAPSE % 'lower(text)'})"


@query(f"SELECT doc_id, {HASH} AS hash FROM documents")
def normalized_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalized_hash(F.col("text")).alias("hash"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {HASH}")
def exact_dedup_keep_first(spark, sf_dir):
    return corpus.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id")


SHINGLES = r"w AS (SELECT {id}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM {t}), s AS (SELECT DISTINCT {id}, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - 7)) AS i FROM w))"
D = SHINGLES.format(id="doc_id", t="documents")
P = SHINGLES.format(id="item_id", t="benchmark").replace("w AS", "pw AS").replace("FROM w)", "FROM pw)").replace(", s AS", ", ps AS")
PAIRS = f"{D}, {P}, nd AS (SELECT doc_id, count(*) AS nd FROM s GROUP BY 1), np AS (SELECT item_id, count(*) AS np FROM ps GROUP BY 1), hit AS (SELECT doc_id, item_id, count(*) / min(least(nd, np)) AS o FROM s JOIN ps USING (g) JOIN nd USING (doc_id) JOIN np USING (item_id) GROUP BY 1, 2), pairs AS (SELECT doc_id, item_id, round(o, 6) AS overlap FROM hit WHERE o >= 0.5)"


@query(f"WITH {D} SELECT doc_id, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id) AS n FROM documents d")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.shingles(F.col("text"), 8)).cast("long").alias("n"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def contaminated_pairs(spark, sf_dir):
    return corpus.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"WITH {PAIRS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs)")
def decontaminated_documents(spark, sf_dir):
    return corpus.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id")


@query(f"WITH {PAIRS}, c AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs)) SELECT (SELECT count(*) FROM documents) AS seen, (SELECT count(*) FROM c) AS clean, (SELECT count(DISTINCT {HASH}) FROM c) AS kept")
def corpus_funnel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dirty = corpus.contaminated_pairs(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct().withColumn("dirty", F.lit(True))
    marked = docs.select("doc_id", X.normalized_hash(F.col("text")).alias("h")).join(dirty, "doc_id", "left")
    return marked.agg(F.count("*").alias("seen"), F.count_if(F.col("dirty").isNull()).alias("clean"), F.count_distinct(F.when(F.col("dirty").isNull(), F.col("h"))).alias("kept"))


@query(r"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents), r AS (SELECT *, sum(n_tokens) OVER (ORDER BY doc_id) AS upto FROM t) SELECT doc_id, n_tokens, least(n_tokens, 50000 - (upto - n_tokens))::BIGINT AS kept FROM r WHERE upto - n_tokens < 50000")
def token_cap_truncation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))
    return corpus.token_cap(docs, 50_000)


# Words of each document, and of all up to it, in order of ids.
WORDS_UPTO = r"w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents), u AS (SELECT *, sum(n) OVER (ORDER BY doc_id) AS upto, sum(n) OVER () AS total FROM w)"


def _words_upto(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    return running_sum(docs, "doc_id", "n", "upto")


@query(f"WITH {WORDS_UPTO}, m AS (SELECT *, round_even(total::DOUBLE * 0.7, 0) AS quota FROM u), k AS (SELECT doc_id, upto - n AS start, n AS size, (round_even(upto::DOUBLE * quota / total, 0) - round_even((upto - n)::DOUBLE * quota / total, 0))::BIGINT AS reasoning FROM m) SELECT doc_id, start::BIGINT AS start, size, reasoning, size - reasoning AS general FROM k")
def mixture_schedule(spark, sf_dir):
    """The documents' words as chunks of a mixture of as many tokens."""
    chunks = _words_upto(spark, sf_dir)
    total = chunks.agg(F.max("upto")).first()[0] or 1
    return corpus.mixture_schedule(chunks.select("doc_id", (F.col("upto") - F.col("n")).alias("start"), F.col("n").alias("size")), total, 0.7)


@query("SELECT position // 8 AS sequence, string_agg(token::VARCHAR, ',' ORDER BY position) AS tokens FROM (SELECT event_id AS position, user_id AS token FROM events) GROUP BY 1 HAVING count(*) = 8")
def packed_sequences(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("token"))
    return corpus.packed(tokens, 8).select("sequence", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query(r"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents), n AS (SELECT source, count(DISTINCT word) AS v, count(*) AS most FROM w GROUP BY source)
SELECT source, v, CASE WHEN v <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype, most, CASE WHEN most <= 65535 THEN 'uint16' ELSE 'uint32' END AS widest FROM n""")
def token_dtype(spark, sf_dir):
    """The type that ids of a source's distinct words need, or of all its words."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("word"))
    per = words.groupBy("source", "word").agg(F.count("*").alias("n")).groupBy("source").agg(F.count("*").alias("v"), F.sum("n").alias("most"))
    return per.select("source", "v", corpus.token_dtype(F.col("v")).alias("dtype"), "most", corpus.token_dtype(F.col("most")).alias("widest"))


ARTICLE = r"regexp_replace(%s, '(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g')"
NORM = "trim(regexp_replace(" + ARTICLE % (ARTICLE % "lower(%s)") + ", '[^a-z0-9]+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda w: w <> '')"


def _answers(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("role", F.col("text").alias("prediction"), F.lead("text").over(w).alias("answer"), F.col("role").alias("task")).where("answer IS NOT NULL")


@query(f"""WITH a AS (SELECT role, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
w AS (SELECT role, {NORM % 'p'} = {NORM % 'a'} AS em, {WORDS % 'p'} AS p, {WORDS % 'a'} AS a FROM a WHERE a IS NOT NULL),
f AS (SELECT role, em::INT AS em, CASE WHEN len(p) = 0 OR len(a) = 0 THEN (len(p) = 0 AND len(a) = 0)::INT ELSE
 2.0 * coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(a, lambda y: y = x))))), 0) / (len(p) + len(a)) END AS f1 FROM w)
SELECT role AS task, count(*) AS n, round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS token_f1 FROM f GROUP BY ROLLUP (role)""")
def answer_em_f1_by_group(spark, sf_dir):
    out = evaluation.answers(_answers(spark, sf_dir))
    return out.select("task", "n", F.round("exact_match", 6).alias("exact_match"), F.round("token_f1", 6).alias("token_f1"))


@query("WITH l AS (SELECT abs(value) / 100 AS loss, 1 + user_id % 7 AS tokens FROM events), m AS (SELECT sum(loss * tokens) / sum(tokens) AS v, sum(tokens)::BIGINT AS tokens FROM l) SELECT round(v, 6) AS mean_loss, round(exp(least(v, 20)), 6) AS perplexity, tokens FROM m")
def lm_loss_perplexity(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select((F.abs("value") / 100).alias("loss"), (1 + F.col("user_id") % 7).alias("tokens"))
    return evaluation.language_model(losses).select(F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 6).alias("perplexity"), "tokens")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles_by_mode(spark, sf_dir):
    out = evaluation.percentiles(table(spark, sf_dir, "events"), "value", "event_type", p50=0.5, p95=0.95)
    return out.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""WITH r AS (SELECT user_id, max_by(struct_pack(s := event_id, r := event_id % 100, t := event_id % 1000, l := value), event_id) AS x FROM events GROUP BY user_id)
SELECT user_id, x.r AS reasoning_tokens, x.t AS tokens_seen, round(x.l, 6) AS loss, round(x.r / greatest(1, x.t), 6) AS ratio FROM r""")
def final_metric_per_run(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 100).alias("reasoning_tokens"), (F.col("event_id") % 1000).alias("tokens_seen"), F.col("value").alias("loss"))
    return evaluation.final_metric(log, "user_id", "event_id").withColumns({"loss": F.round("loss", 6), "ratio": F.round("ratio", 6)})


def _neighbours(spark, sf_dir, n=10):
    """A stated set of queries (ids divisible by 20) against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return v, vectors.exact_top(v, queries, "vec_id", n, itself=False)


COSINE = "e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM e), c AS (SELECT q.vec_id AS query_id, x.vec_id, x.label, q.label AS own, list_inner_product(x.e, q.e) / (x.l * q.l) AS score FROM n q JOIN n x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c)"


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10")
def dense_topk_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir)[1].select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {COSINE}, t AS (SELECT * FROM k WHERE rank <= 10), o AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
m AS (SELECT query_id, sum((label = own)::INT) AS hits, min(CASE WHEN label = own THEN rank END) AS first, sum(CASE WHEN label = own THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, any_value(own) AS own FROM t GROUP BY query_id),
i AS (SELECT query_id, sum(1 / log2(p + 1)) AS ideal FROM (SELECT query_id, unnest(generate_series(1, least(size - 1, 10))) AS p FROM m JOIN o ON own = label) GROUP BY query_id)
SELECT m.query_id, round(hits / (size - 1), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(dcg / ideal, 6) AS ndcg FROM m JOIN o ON own = label JOIN i USING (query_id)""")
def ranked_retrieval_metrics(spark, sf_dir):
    v, near = _neighbours(spark, sf_dir)
    # Only hits and the number of vectors per label matter: no list of all support is made.
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("support"))
    labelled = near.join(v.select("vec_id", "label"), "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    out = evaluation.ranked_hits(labelled.select("query_id", "own", "rank", (F.col("label") == F.col("own")).alias("hit")), sizes.withColumnRenamed("label", "own"), "own", 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query()
def chunk_documents(spark, sf_dir):
    return retrieval.chunks(table(spark, sf_dir, "documents"))


def _bm25(spark, sf_dir, boost=0.0):
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fields = {"text": F.col("text")} | ({"title": F.substring_index("text", "\n", 1)} if boost else {})
    scores = retrieval.bm25(docs, queries, "doc_id", fields, {"title": boost})
    return retrieval.top(scores.withColumn("score", F.round("score", 6)), 10, "doc_id")


def _bm25_sql(field: str, name: str) -> str:
    return rf"""{name}w AS (SELECT doc_id, list_filter(regexp_extract_all(lower({field}), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) <= 40) AS ws FROM documents),
{name}t AS (SELECT doc_id, term, count(*) AS tf, any_value(len(ws)) AS dl FROM (SELECT doc_id, ws, unnest(ws) AS term FROM {name}w) GROUP BY 1, 2),
{name}q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) <= 40)) AS term FROM benchmark),
{name}d AS (SELECT term, count(*) AS df FROM {name}t GROUP BY 1), {name}n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM {name}w),
{name} AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM {name}t JOIN {name}d USING (term) JOIN {name}q USING (term), {name}n GROUP BY 1, 2)"""


TOP10 = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM x)) WHERE rank <= 10"


@query(f"WITH {_bm25_sql('text', 'x')} {TOP10}")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


TITLE = "string_split(text, chr(10))[1]"


@query(f"WITH {_bm25_sql('text', 'b')}, {_bm25_sql(TITLE, 'h')}, x AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM b UNION ALL SELECT query_id, doc_id, 2.0 * score FROM h) GROUP BY 1, 2) {TOP10}")
def bm25_title_boost(spark, sf_dir):
    return _bm25(spark, sf_dir, 2.0).withColumn("rank", F.col("rank").cast("long"))


#: The tables' URLs have a fragment or one tracking parameter at most, and sorted ones otherwise.
CANONICAL = r"regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_source=[^&]*$', '')"


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT page_id, 'web:' || left(sha256(url), 20) AS id FROM pages")
def stable_source_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.source_id(F.lit("web"), F.col("url")).alias("id"))


@query(f"""WITH p AS (SELECT page_id % 50 AS query_id, page_id AS position, {CANONICAL} AS canonical FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS n FROM p),
f AS (SELECT query_id, canonical, min(position) AS position, min(place) AS place, any_value(n) AS n FROM r GROUP BY 1, 2)
SELECT query_id, canonical, position, rank, score, provider_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank, (n - place)::DOUBLE AS score, (place + 1)::DOUBLE AS provider_rank FROM f) WHERE rank <= 5""")
def web_dedup_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("query_id"), F.col("page_id").alias("position"), "url")
    return web.dedup_top(rows, 5).withColumn("rank", F.col("rank").cast("long"))


@query()
def page_main_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.main_text("html").alias("text"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def cache_upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return corpus.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "value", "event_id")


@query("WITH c AS (SELECT user_id, max(event_id) AS expires FROM events GROUP BY 1) SELECT u.user_id AS key, CASE WHEN expires > 1000 THEN expires END AS payload FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id)")
def cache_lookup_unexpired(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cache = events.groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("expires")).withColumn("payload", F.col("expires"))
    return web.unexpired(cache, events.select(F.col("user_id").alias("key")).distinct(), F.lit(1000))


SANITIZED = "regexp_replace(html, '" + DARK + "', ' ', 'g')"
for _t in X.CONTROL_TOKENS:
    SANITIZED = f"replace({SANITIZED}, '{_t}', '< | {_t[2:-2]} | >')"


@query(f"SELECT page_id, left({SANITIZED}, 12000) AS clean FROM pages")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitized(F.col("html")).alias("clean"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) > 1 AS duplicate FROM conversations WHERE role = 'user'")
def duplicate_queries(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return corpus.duplicates_in_request(turns, "conv_id", "turn", "text").select("conv_id", "turn", "duplicate")


@query("SELECT conv_id, turn, greatest(least(length(text), 1000 - (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))), 0)::BIGINT AS used FROM conversations")
def evidence_budget(spark, sf_dir):
    rows = dialogue.evidence_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 1000)
    return rows.select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query("WITH r AS (SELECT conv_id, turn, length(text)::BIGINT AS n, max(length(text)) OVER (PARTITION BY conv_id) AS w FROM conversations) SELECT conv_id, turn, w::BIGINT AS width, w - n AS padded FROM r")
def sft_collate(spark, sf_dir):
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"), ids.alias("labels"))
    out = dialogue.collated(rows, "conv_id", -1)
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("width"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("padded"))


@query("WITH g AS (SELECT user_id, event_id, value, count(*) OVER w AS k, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id)) SELECT event_id, round((value - m) / (s + 0.0001), 6) AS advantage FROM g WHERE k > 1")
def group_advantages(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("reward"))
    large = events.groupBy("user_id").count().where("count > 1").select("user_id")
    out = evaluation.advantages(events.join(large, "user_id", "left_semi"), "user_id")
    return out.select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT event_id, round((event_id % 2) * 1.0 + 0.25 * ((event_id % 5) / 4.0) - 0.02 * (event_id % 4) + 0.2 * (event_id % 3) / 2.0, 6) AS reward FROM events")
def reward_components(spark, sf_dir):
    i = F.col("event_id")
    parts = table(spark, sf_dir, "events").select("event_id", (i % 2).cast("double").alias("answer_exact"), (i % 5 / 4.0).alias("answer_f1"), (i % 4).cast("double").alias("search_cost"), (i % 3 / 2.0).alias("citation_recall"))
    return parts.select("event_id", F.round(evaluation.reward(parts), 6).alias("reward"))


@query(f"WITH {WORDS_UPTO} SELECT doc_id, upto::BIGINT AS tokens, round(CASE WHEN upto < 10000 THEN 0.0006 * upto / 10000.0 ELSE 0.00006 + 0.00054 * 0.5 * (1 + cos(pi() * least(greatest((upto - 10000) / 290000.0, 0), 1))) END, 9) AS rate FROM u")
def lr_schedule(spark, sf_dir):
    """The rate after each document, by the words seen."""
    return _words_upto(spark, sf_dir).select("doc_id", F.col("upto").alias("tokens"), F.round(schedules.cosine_rate(F.col("upto"), 0.0006, 0.00006, 10_000, 300_000), 9).alias("rate"))


def _runs(spark, sf_dir):
    """Users as runs: events seen, events in eight seconds, seconds between the first and last."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(i).alias("seen"), F.count("*").alias("events"), (F.max(i) - F.min(i)).alias("seconds"))


RUNS = "r AS (SELECT user_id, sum(event_id)::BIGINT AS seen, count(*) AS events, max(event_id) - min(event_id) AS seconds FROM events GROUP BY user_id)"


@query(f"WITH {RUNS} SELECT user_id, greatest(least(2500000, seen + floor(events / 8.0 * seconds))::BIGINT // 4096 * 4096, 4096)::BIGINT AS budget FROM r")
def token_budget(spark, sf_dir):
    return _runs(spark, sf_dir).select("user_id", schedules.projected_budget(F.col("seen"), F.col("events") / 8.0, F.col("seconds"), 2_500_000, 4096).alias("budget"))


@query(f"WITH {RUNS} SELECT user_id, round(6 * 350000000.0 * (events * 1000) / 989e12, 9) AS mfu FROM r")
def mfu(spark, sf_dir):
    return _runs(spark, sf_dir).select("user_id", F.round(schedules.utilisation(F.lit(350_000_000.0), F.col("events") * 1000, 989.0), 9).alias("mfu"))


@query(f"WITH {RUNS} SELECT sum(events / 16.0)::DOUBLE AS scheduled_hours, sum(events / 16.0)::DOUBLE + 5.5 AS planned_hours, sum(2048 * events * 32)::BIGINT AS tokens_per_step FROM r")
def planned_hours(spark, sf_dir):
    """Hours and tokens of a step of all users' runs, sixteen events being an hour."""
    runs = _runs(spark, sf_dir).withColumn("time_budget_hours", F.col("events") / 16.0)
    steps = runs.agg(F.sum(schedules.tokens_per_step(F.lit(2048).cast("long"), F.col("events"), F.lit(32))).alias("tokens_per_step"))
    return schedules.scheduled_hours(runs).join(F.broadcast(steps))  # one row each


def _stream(spark, sf_dir, name):
    """A table as a bounded stream; a single file is read through its name."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path + "*" if not spark.read.parquet(path).inputFiles()[0].rpartition("/")[0].endswith(".parquet") else path)


@query(ORACLE_SQL[FLAGSHIP])
def stream_rejection_counts(spark, sf_dir):
    return stateful.written(spark, corpus_stream.rejection_counts(preparation.with_text(_stream(spark, sf_dir, "documents"))), "complete", stage.scratch(spark))


@query(f"SELECT count(DISTINCT {HASH}) AS n FROM documents")
def stream_dedup(spark, sf_dir):
    return stateful.written(spark, corpus_stream.dedup(_stream(spark, sf_dir, "documents")).select("h"), "append", stage.scratch(spark)).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    out = corpus_stream.windowed(table(spark, sf_dir, "events"), "1 hour")
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value FROM events) GROUP BY 1, 2")
def events_sliding(spark, sf_dir):
    out = corpus_stream.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes")
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM c GROUP BY user_id, k")
def events_session(spark, sf_dir):
    out = corpus_stream.sessions(table(spark, sf_dir, "events"), "30 minutes")
    return out.select("user_id", F.col("w.start").alias("start"), "n")


from . import queries_corpus, queries_dialogue, queries_index, queries_search  # noqa: E402, F401
