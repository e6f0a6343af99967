import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import corpus, dialogue, evaluation, quality, retrieval, schedules, web
from corpusflow.plans.prefix import running_sum
from corpusflow.sources import jsonl


def one(spark, expr, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], names)
    return row.select(expr.alias("x")).first().x


def test_answers_and_math(spark):
    assert one(spark, X.normalize_answer(F.col("t")), t="The  Red-Planet, a.") == "red planet"
    assert one(spark, X.token_f1(F.col("p"), F.col("a")), p="a b b c", a="b c d") == pytest.approx(2 * 2 / 6)
    assert one(spark, X.token_f1(F.col("p"), F.col("a")), p="", a="the") == 1.0
    assert one(spark, X.boxed_answer(F.col("t")), t=r"\boxed{1} and \boxed{2}") == "2"
    assert one(spark, X.normalize_math(F.col("t")), t=r"$\boxed{X}$.") == "x"
    assert one(spark, X.choice(F.col("t")), t="it is (c)") == "C"
    assert one(spark, X.tag(F.col("t"), "think"), t="<THINK> a\nb </think>") == "a\nb"


def test_chunks_overlap_and_cut_long_sentences(spark):
    chunks = one(spark, X.chunked(F.col("t"), 20, 5), t="One two three. Four five six. Seven.")
    assert chunks == ["One two three.", "hree. Four five six.", "six. Seven."]
    assert one(spark, X.chunked(F.col("t"), 10, 2), t="x" * 25) == ["x" * 10, "x" * 10, "x" * 9]
    assert one(spark, X.chunked(F.col("t"), 10, 2), t="  ") == []


def test_gate_reasons(spark):
    good = "Good words are here to read and keep. " * 6
    rows = [("too_short", "x" * 199), ("too_long", "a b " * 50_001), ("non_printable", "\x00" * 30 + good), ("low_alphanumeric_ratio", "." * 300), ("repetitive_lines", "same line here and now\n" * 12), (None, good)]
    got = spark.createDataFrame(rows, "want string, t string").select("want", quality.general_rejection(F.col("t")).alias("r")).collect()
    assert all(r.want == r.r for r in got)


def test_mixture_prefix_error_is_half_a_token(spark):
    for size in (1, 2, 13, 32):
        n = 320 // size
        chunks = spark.range(n).select((F.col("id") * size).alias("start"), F.lit(size).cast("long").alias("size"))
        rows = corpus.mixture_schedule(chunks, 1000, 0.7).orderBy("start").collect()
        done = 0
        for r in rows:
            done += r.reasoning
            assert abs(done - 0.7 * (r.start + r["size"])) <= 0.5 + 1e-9


def test_cap_and_running_sum(spark):
    rows = spark.createDataFrame([(1, 3), (2, 5), (3, 4)], "doc_id long, n_tokens long")
    assert {r.doc_id: r.kept for r in corpus.token_cap(rows, 5).collect()} == {1: 3, 2: 2}
    many = spark.range(1000).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("v"))
    assert all(r.s == 2 * (r.k + 1) for r in running_sum(many, "k", "v", "s", 7).collect())


def test_decontamination_before_dedup(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "One  two three four"), (3, "other words stand here")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "one two three four five")], "item_id long, text string")
    assert {r.doc_id for r in corpus.decontaminate(docs, bench, 3).collect()} == {3}
    assert {r.doc_id for r in corpus.exact_dedup(docs).collect()} == {1, 3}


def test_ranked_metrics_drop_repeats_before_the_cutoff(spark):
    m = one(spark, evaluation.ranked(F.array(*map(F.lit, "aab")), F.array(F.lit("b")), 2))
    assert (m.recall, m.mrr) == (1.0, 0.5)
    none = one(spark, evaluation.ranked(F.array(F.lit("a")), F.array().cast("array<string>")))
    assert (none.recall, none.mrr, none.ndcg) == (1.0, 1.0, 1.0)


def test_advantages_and_losses(spark):
    rows = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 3.0)], "g string, reward double")
    got = sorted(r.advantage for r in evaluation.advantages(rows, "g").collect())
    assert got[1] == 0 and got[0] == pytest.approx(-got[2])
    losses = spark.createDataFrame([(1.0, 1), (3.0, 3)], "loss double, tokens int")
    assert evaluation.language_model(losses).first().mean_loss == 2.5


def test_urls():
    assert web.canonical("HTTPS://u:p@Example.com:443//a//b?utm_x=1&b=2&a=&gclid=3#f") == "https://example.com/a/b?a=&b=2"
    assert web.canonical("ftp://x") is None and web.canonical(None) is None
    assert web.page_text("<p>a <b>b</b></p><script>x</script><p>c</p>") == "a b\nc"


def test_tool_calls(spark):
    call = '<|tool_call|>{"name": "search", "arguments": {"query": " a  b ", "top_k": 3}}<|end_tool_call|>'
    got = [r.c for r in spark.createDataFrame([(call,), (call * 2,), ("x",), (call.replace("3", "11"),), (call.replace("<|end", " junk<|end"),), (call.replace('" a  b "', "5"),), (call.replace("3", "null"),), (call.replace("3", '"3"'),)], "t string").select(dialogue.tool_call(F.col("t")).alias("c")).collect()]
    assert got[0].query == "a b" and got[0].top_k == 3 and got[1:7] == [None] * 6 and got[7].top_k == 3
    a = one(spark, dialogue.final_answer(F.col("t"), F.array(F.lit("a:0"))), t="<|reasoning|>r<|answer|>M <|citation|>a:0 n <|citation|>a:01")
    assert (a.reasoning, a.answer, a.cited) == ("r", "M [a:0] n", ["a:0"])
    open_end = one(spark, dialogue.final_answer(F.col("t"), F.array(F.lit("x"))), t="<|reasoning|> to the end ")
    assert (open_end.reasoning, open_end.answer) == ("to the end", "<|reasoning|> to the end")


def test_fusion_and_schedule(spark):
    ranks = [spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(x)], "query_id long, k string, rank int") for x in (["a", "b"], ["b", "c"])]
    fused = {r.k: r.score for r in retrieval.fuse(ranks, "k", 10.0).collect()}
    assert fused["b"] > fused["a"] > fused["c"]
    assert one(spark, schedules.projected_budget(F.col("s"), F.col("r"), F.col("t"), 1_000_000, 1000), s=0, r=100.0, t=3600.0) == 360_000


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "text": "t"}\n\n{"id": 2}\nplain\n')
    rows = jsonl.read_lines(spark, str(tmp_path / "x.jsonl"), ["id", "text"])
    assert {(r.id, r.error) for r in rows.collect()} == {("1", None), ("2", "missing: text"), (None, "not a JSON object")}
    assert {r.prompt for r in jsonl.evaluation_prompts(spark, str(tmp_path / "x.jsonl")).collect()} == {"t", "plain"}
    target = str(tmp_path / "out")
    jsonl.write_whole(rows.select("id"), target, nonempty=True)
    with pytest.raises(ValueError):
        jsonl.write_whole(rows.select("id").where("false"), target, nonempty=True)
    assert spark.read.json(target).count() == 3  # a line per row, the one without id too


def test_chunks_against_a_plain_version(spark):
    import re

    def plain(text, size, overlap):
        out, held = [], ""
        for unit in filter(None, (u.strip() for u in re.split(r"(?<=[.!?])\s+|\n{2,}", re.sub("[ \t]+", " ", text).strip()))):
            if len(unit) > size:
                out += [held] * bool(held) + [unit[i : i + size] for i in range(0, max(1, len(unit) - overlap), size - overlap)]
                held = ""
            elif held and len(held) + 1 + len(unit) > size:
                out.append(held)
                held = f"{held[-overlap:]} {unit}".lstrip()
            else:
                held = f"{held} {unit}".lstrip()
        return out + [held] * bool(held)

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, ""), (-2, "a" * 500), (-3, "One. Two!\n\nThree?  four \t five. " * 9), (-4, " \n\n ")], "doc_id long, text string"))
    for size, overlap in ((100, 20), (2000, 200)):
        for r in rows.select("text", X.chunked(F.col("text"), size, overlap).alias("c")).where("text IS NOT NULL").collect():
            assert r.c == plain(r.text, size, overlap)


def test_canonical_urls_of_both_engines(spark):
    import random

    r = random.Random(1)
    urls = [None, "", "http://[::1]:8080/a", "https://e.org:99999/", "http://a@b@c.org/", "https://e.org/ü?q=a+b%20c&q=%zz&~t=*&UTM_Medium=1", "https://e.org:080/x", "https://E.org/\tx\n", "https://e.org/?a=b=c&&d"]
    urls += ["http" + r.choice(["", "s"]) + "://" + "".join(r.choice("abZ:/?#@&=%+~*.é 1") for _ in range(r.randrange(25))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, u string").select("i", web.canonical_url(F.col("u")).alias("c"))
    assert {x.i: x.c for x in rows.collect()} == {i: web.canonical(u) for i, u in enumerate(urls)}
