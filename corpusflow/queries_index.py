"""Queries of the stored indexes over documents, benchmark items and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import lexicon, retrieval
from .plans.stage import scratch
from .registry import query, table
from .sources import tokens

BOOSTS = {"title": 2.0, "content": 1.0}
TERMS = r"list_filter(regexp_extract_all(lower(%s), '[\p{L}\p{N}]+'), lambda t: strlen(t) <= 40)"

# c: query_id, clause, sign, field (null: both) and words of each clause.
SCORED = f"""f AS (SELECT doc_id, 'title' AS field, {TERMS % "coalesce(string_split(text, chr(10))[1], '')"} AS ws FROM documents UNION ALL SELECT doc_id, 'content', {TERMS % "coalesce(text, '')"} FROM documents),
t AS (SELECT field, doc_id, len(ws) AS dl, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM f),
df AS (SELECT field, term, count(DISTINCT doc_id) AS df FROM t WHERE term IN (SELECT unnest(words) FROM c) GROUP BY 1, 2), m AS (SELECT field, count(*) AS n, avg(len(ws)) AS mean FROM f GROUP BY 1),
a AS (SELECT query_id, clause, sign, v.field, CASE v.field WHEN 'title' THEN 2.0 ELSE 1.0 END AS boost, len(words) AS size, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM c JOIN (VALUES ('title'), ('content')) v(field) ON coalesce(c.field, v.field) = v.field WHERE len(words) > 0),
w AS (SELECT *, boost * sum(ln(1 + (n - df + 0.5) / (df + 0.5))) OVER (PARTITION BY query_id, clause, field) AS weight FROM a JOIN df USING (term, field) JOIN m USING (field)),
p AS (SELECT query_id, clause, sign, field, doc_id, pos - i AS start, any_value(dl) AS dl, any_value(weight) AS weight, any_value(mean) AS mean FROM w JOIN t USING (field, term) GROUP BY ALL HAVING count(*) = any_value(size)),
o AS (SELECT query_id, clause, sign, field, doc_id, any_value(weight) * count(*) * 2.2 / (count(*) + 1.2 * (0.25 + 0.75 * any_value(dl) / any_value(mean))) AS score FROM p GROUP BY ALL),
q AS (SELECT query_id, doc_id, clause, sign, sum(score) AS score FROM o GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(score) FILTER (sign <> '-'), 6) AS score FROM q GROUP BY 1, 2
  HAVING count(*) FILTER (sign = '+') = (SELECT count(*) FROM c WHERE c.query_id = q.query_id AND c.sign = '+' AND len(words) > 0) AND count(*) FILTER (sign = '-') = 0 AND count(*) FILTER (sign <> '-') > 0)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""


def _index(spark, sf_dir):
    path = f"{scratch(spark)}/lexicon-{uuid.uuid4().hex}"
    fields = {"title": F.substring_index("text", "\n", 1), "content": F.col("text")}
    lexicon.build(table(spark, sf_dir, "documents"), "doc_id", fields, path, BOOSTS)
    return lexicon.Lexicon(spark, path)


def _found(spark, sf_dir, queries):
    out = _index(spark, sf_dir).search(queries, 10, "doc_id")
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH b AS (SELECT item_id AS query_id, string_split(text, ' ') AS x FROM benchmark),
c AS (SELECT query_id, 1 AS clause, '+' AS sign, NULL AS field, {TERMS % "x[2] || ' ' || x[3]"} AS words FROM b UNION ALL SELECT query_id, 2, '', NULL, {TERMS % 'x[5]'} FROM b UNION ALL SELECT query_id, 3, '', 'title', {TERMS % 'x[2]'} FROM b
  UNION ALL SELECT query_id, 4, '', 'content', {TERMS % "x[6] || ' ' || x[7] || ' ' || x[8]"} FROM b UNION ALL SELECT query_id, 5, '-', NULL, {TERMS % "x[1] || ' ' || x[4]"} FROM b), {SCORED}""")
def lexicon_phrases(spark, sf_dir):
    """Required and excluded phrases, words in a field."""
    return _found(spark, sf_dir, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), phrased(F.col("text")).alias("text")))


def phrased(text):
    """The query text of an item. Its words end at spaces only and may hold line
    ends or marks, so each clause stands in quotes; one that lacks a word is left out."""
    x = F.split(F.translate(text, '"', "\n"), " ")
    clause = lambda mark, *at: F.concat(F.lit(f'{mark}"'), F.concat_ws(" ", F.array(*[F.get(x, F.lit(i)) for i in at])), F.lit('"'))
    whole = lambda mark, *at: F.when(F.size(x) > max(at), clause(mark, *at))
    return F.concat_ws(" ", whole("+", 1, 2), whole("", 4), whole("title:", 1), whole("content:", 5, 6, 7), whole("-", 0, 3))


@query(f"WITH c AS (SELECT query_id, clause, '' AS sign, NULL AS field, [word] AS words FROM (SELECT item_id AS query_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS clause FROM (SELECT item_id, {TERMS % 'text'} AS ws FROM benchmark))), {SCORED}")
def lexicon_topk(spark, sf_dir):
    """All words of an item; blocks that can't reach the threshold aren't read."""
    words = F.array_join(retrieval.terms(F.col("text")), " ")
    return _found(spark, sf_dir, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("text")))


WORD_IDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\n\\t\\r\\x0B\\x0C]+'), lambda w: (length(w) * 257 + unicode(w)) % 65521)"


def _corpora(spark, sf_dir, cap=None):
    """Two corpora, of English documents and others, with a word's length and first
    letter as its id."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^ \n\t\r\x0B\x0C]+)"), F.lit(1))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.coalesce("lang", F.lit("")).alias("lang"), F.transform(words, lambda w: ((F.length(w) * 257 + F.ascii(w)) % 65521).cast("int")).alias("ids"))
    root, out = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}", {}
    for name, some in (("reasoning", docs.where("lang = 'en'")), ("general", docs.where("lang <> 'en'"))):
        tokens.write(some.drop("lang"), f"{root}/{name}", 65_521, cap or 1 << 60, block=4096)
        out[name] = tokens.read(spark, f"{root}/{name}")
    return out


TOKENS = f"""d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'reasoning' ELSE 'general' END AS source, {WORD_IDS} AS ids FROM documents WHERE coalesce(lang, '') IS NOT NULL),
t AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS cursor, id FROM (SELECT source, doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM d)), l AS (SELECT source, count(*) AS length FROM t GROUP BY 1)"""


@query(f"""WITH {TOKENS}, p AS (SELECT position, position // 5000 * 5000 AS base FROM range(0, 200000) r(position)),
q AS (SELECT *, round_even(base::DOUBLE * 140000 / 200000, 0)::BIGINT AS r0, round_even(least(base + 5000, 200000)::DOUBLE * 140000 / 200000, 0)::BIGINT AS r1 FROM p),
n AS (SELECT position, base, CASE WHEN position - base < r1 - r0 THEN 'reasoning' ELSE 'general' END AS source, CASE WHEN position - base < r1 - r0 THEN r0 + position - base ELSE base - r0 + position - base - (r1 - r0) END AS nth FROM q WHERE position >= 777 AND position < 190001),
z AS MATERIALIZED (SELECT position, base, source, nth % length AS cursor FROM n JOIN l USING (source))
SELECT min(position) AS start, count(*) AS n, sha256(string_agg(id::VARCHAR, ',' ORDER BY position)) AS ids FROM z JOIN t USING (source, cursor) GROUP BY base""")
def mixture_of_tokens(spark, sf_dir):
    """A mixture of two corpora, resumed at token 777; its tokens, not only its plan."""
    held = _corpora(spark, sf_dir)
    out = tokens.mixture(spark, {k: (rows, m["tokens"]) for k, (rows, m) in held.items()}, 200_000, 0.7, "uint16", 5000, 777, 190_001, block=4096)
    return out.select("start", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids"))


@query(f"""WITH {TOKENS} SELECT source, cursor // 4096 AS block, count(*) AS n, sha256(string_agg(id::VARCHAR, ',' ORDER BY cursor)) AS ids FROM t WHERE cursor < 50001 GROUP BY 1, 2""")
def token_blocks(spark, sf_dir):
    """The blocks of both corpora, cut at 50,001 tokens within a document."""
    out = None
    for name, (rows, m) in _corpora(spark, sf_dir, 50_001).items():
        own = tokens.ids_of(rows.select("block", "raw"), m["dtype"]).select(F.lit(name).alias("source"), "block", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids"))
        out = own if out is None else out.unionByName(own)
    return out
