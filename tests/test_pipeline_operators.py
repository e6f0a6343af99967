"""Operators of preparation, search, dialogue, files and streams on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusflow import cli
from corpusflow.operators import articles, corpus, dialogue, evaluation, grounded, indexes, judge, preparation, rollouts, search, trajectories, validation
from corpusflow.sources import fetch, files, jsonl
from corpusflow.streaming import stateful


def test_numbered_lines_and_documents(spark, tmp_path):
    good = '{"id": %d, "title": "t", "url": "u", "text": "x", "more": 1}'
    (tmp_path / "d.jsonl").write_text("\n".join([good % 1, "", good % 2, '{"id": 3}', "[]"]) + "\n")
    rows = {r.line: r for r in jsonl.documents(spark, str(tmp_path / "d.jsonl")).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and rows[1].id == "1" and rows[1].error is None
    assert rows[2].error.startswith("document line 2:") and rows[4].error.endswith("missing: title, url, text") and rows[5].error
    big = tmp_path / "big.txt"
    big.write_text("".join(f"{i}\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    got = jsonl.numbered(spark, str(big)).where("CAST(value AS long) <> line - 1").count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == 0


def test_rollout_prompts_and_trajectories(spark, tmp_path):
    lines = ['{"question":"q","answer":"a","supporting_ids":["d"],"search_required":false}', "", '{"answer":"x"}', '{"question":"q"}', '{"question":"q","answer":"a","supporting_ids":"bad"}', '{"question":"q","answer":"a","search_required":"false"}', "{bad}", '{"question":5,"answer":"a"}', '{"question":"q","answer":"a"}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n")
    rows = {r.line: r for r in jsonl.rollout_prompts(spark, str(tmp_path / "p.jsonl")).collect()}
    assert rows[1].error is None and rows[1].supporting_ids == ["d"] and rows[1].search_required is False
    assert [rows[i].error.split(" ", 4)[4] for i in (3, 4, 5, 6, 7, 8)] == ["is missing question", "is missing answer", "has invalid supporting_ids", "has invalid search_required", "isn't JSON", "is missing question"]
    assert rows[9].supporting_ids == [] and rows[9].search_required is True and 2 not in rows
    (tmp_path / "t.jsonl").write_text('{"text":"a"}\n{"text":" "}\n{"text":1}\n')
    assert [r.error is None for r in jsonl.trajectories(spark, str(tmp_path / "t.jsonl")).orderBy("line").collect()] == [True, False, False]
    assert jsonl.evaluation_prompts(spark, None).count() == 0


def test_whole_writes_survive_failures(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.range(3)
    assert jsonl.write_whole(rows, target, True) == 3 and jsonl.write_whole(rows.where("id < 2"), target) == 2
    with pytest.raises(ValueError):
        jsonl.write_whole(rows.where("false"), target, True)
    with pytest.raises(OSError):
        files.replace(spark, str(tmp_path / "absent"), target)
    assert spark.read.json(target).count() == 2 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]
    files.write_text(spark, str(tmp_path / "r.json"), "é\n")
    files.write_report(spark, {"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 2, "b": 1}
    assert files.hashes(spark, str(tmp_path / "r.json")).first().sha256 == __import__("hashlib").sha256((tmp_path / "r.json").read_bytes()).hexdigest()


def test_index_is_built_whole(spark, tmp_path):
    docs = tmp_path / "docs.jsonl"
    texts = {"mars": "The red planet has the largest volcano.", "sea": "The deep sea holds strange fish."}
    docs.write_text("".join(json.dumps({"id": k, "title": k.title(), "url": f"https://e/{k}", "text": t}) + "\n" for k, t in texts.items()))
    index = str(tmp_path / "index")
    assert cli.main(["build-index", "--input", str(docs), "--output", index], spark)["chunks"] == 2
    assert cli.main(["ask", "--index", index, "--query", "red planet volcano"], spark)["results"][0]["chunk_id"] == "mars:0"
    assert cli.main(["ask", "--index", index, "--query", "  "], spark)["results"] == []
    assert cli.main(["ask", "--index", index, "--query", '+title:sea "strange fish" -volcano'], spark)["results"][0]["chunk_id"] == "sea:0"
    with pytest.raises(FileExistsError):
        cli.main(["build-index", "--input", str(docs), "--output", index], spark)
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError):
        cli.main(["build-index", "--input", str(tmp_path / "none.jsonl"), "--output", str(tmp_path / "empty")], spark)
    assert not list((tmp_path / "empty").glob("data-*"))


def test_index_with_vectors(spark, tmp_path):
    texts = [("a", "Red planet", "rust and dust"), ("b", "Deep sea", "strange fish live there"), ("c", "Old sea", "a dry bed")]
    chunks = spark.createDataFrame([(k, t, "u", c) for k, t, c in texts], "chunk_id string, title string, url string, content string")
    encoder = lambda s: s.map(lambda t: [1.0 + t.lower().count("sea"), float(len(t)), 1.0])
    indexes.build(chunks, str(tmp_path / "i"), encoder, lists=2, parts=2)
    index = indexes.Index(spark, str(tmp_path / "i"), encoder)
    rows = index.search(spark.createDataFrame([(1, "sea"), (2, " ")], "query_id long, text string"), 3).orderBy("rank").collect()
    assert {r.chunk_id for r in rows} == {"a", "b", "c"} and rows[0].score_components["dense"] > 0 and {r.query_id for r in rows} == {1}
    assert index.manifest["dense"] and index.manifest["chunks"] == 3


def test_benchmark_command(spark, tmp_path, monkeypatch):
    (tmp_path / "e.jsonl").write_text('{"question": "q", "answer": "a", "supporting_ids": ["i"]}\n')
    (tmp_path / "answerer_of_test.py").write_text("from pyspark.sql import functions as F\ndef answer(d):\n    none = F.array().cast('array<string>')\n    return d.withColumns({'prediction': F.lit('a [i]'), 'queries': none, 'tool_calls_total': F.lit(0), 'valid_tool_calls': F.lit(0), 'retrieved_ids': none, 'cited_ids': F.array(F.lit('i')), 'elapsed_seconds': F.lit(1.5)})\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    out = cli.main(["benchmark-grounded", "--input", str(tmp_path / "e.jsonl"), "--answerer", "answerer_of_test:answer", "--output", str(tmp_path / "o")], spark)
    assert out["records"] == 2 and {r["search_mode"] for r in out["report"]} == {None, "off", "local"} and out["report"][0]["latency_p95_seconds"] == 1.5


def test_commands(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"loss": 1, "tokens": 1}\n{"loss": 3, "tokens": 3}\n')
    assert cli.main(["score-lm", "--input", str(tmp_path / "l.jsonl")], spark)["mean_loss"] == 2.5
    (tmp_path / "g.jsonl").write_text('{"prediction": "Paris [d:1]", "answer": "paris", "cited_ids": ["d:1"], "supporting_ids": ["d:1"], "retrieved_ids": ["d:1"], "queries": ["q"], "elapsed_seconds": 2}\n')
    report = cli.main(["score-grounded", "--input", str(tmp_path / "g.jsonl")], spark)["report"]
    assert len(report) == 1 and report[0]["answer_exact_match"] == report[0]["citation_validity"] == 1.0
    for run, ratio in (("b", 1), ("a", 3)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.jsonl").write_text('{"tokens_seen": 1}\n' + json.dumps({"reasoning_tokens": ratio, "tokens_seen": 10, "loss": 1.0, "tokens_per_second": 1.0}) + "\n")
    compared = cli.main(["compare-proxies", "--input", str(tmp_path / "runs")], spark)
    assert [r["run"] for r in compared["runs"]] == ["b", "a"] and compared["equal_token_budget"] and compared["token_budget_spread"] == 0
    assert cli.main(["experiment-plan"], spark)["total_scheduled_training_hours"] == 18.5
    (tmp_path / "q.jsonl").write_text('{"question": "q", "answer": "a", "query": "find", "evidence": [{"id": "x:0", "title": "t", "url": "u", "snippet": "s", "content": "c"}]}\n{"question": "2+2?", "answer": "4"}\n')
    assert cli.main(["make-trajectories", "--input", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "traj")], spark)["trajectories"] == 2
    texts = sorted(r.text for r in spark.read.json(str(tmp_path / "traj")).collect())
    assert "<|tool_call|>" not in texts[0] and texts[1].endswith("<|answer|>a <|citation|>x:0")
    manifest = {"d": {"revision": "a" * 40, "license": "x", "role": "reasoning", "config": "c", "included_sources": ["s"]}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    (tmp_path / "r.jsonl").write_text('{"text": "x", "source": "s", "prompt": "p", "response": "<think>t</think><answer>a</answer>"}\n{"text": "x", "source": "z", "prompt": "p", "response": "r"}\n')
    out = cli.main(["prepare-data", "--manifest", str(tmp_path / "m.json"), "--output", str(tmp_path / "prep"), "--reasoning", str(tmp_path / "r.jsonl")], spark)
    assert out["reasoning"]["documents"] == 1 and out["reasoning"]["filtering"]["rows_rejected"] == 1
    assert json.loads((tmp_path / "prep" / "preparation-manifest.json").read_text())["format_version"] == 2
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1", "title": "T a", "text": "x " * 150}) + "\n")
    assert cli.main(["bootstrap-data", "--input", str(tmp_path / "a.jsonl"), "--output", str(tmp_path / "boot")], spark) == {"articles": 1, "questions": 3}
    assert cli.main(["bootstrap-data", "--input", str(tmp_path / "a.jsonl"), "--output", str(tmp_path / "boot"), "--education", str(tmp_path / "a.jsonl")], spark)["tokenizer_samples"] == 1


def test_manifest_and_configuration_faults(spark):
    good = {"revision": "a" * 40, "license": "l", "role": "general"}
    bad = [good | {"revision": "main"}, good | {"license": ""}, good | {"role": ""}, good | {"config": ""}, good | {"role": "reasoning"}, good | {"role": "reasoning", "config": "c"}]
    assert validation.manifest_errors({"ok": good}) == {} and all(validation.manifest_errors({"x": b}) for b in bad)
    validation.check_training(0.5, 8, 8, 1.0, 1e-3)
    for wrong in ((1.5, 8, 8, 1.0, 1e-3), (0.5, 1, 8, 1.0, 1e-3), (0.5, 8, 8, math.inf, 1e-3)):
        with pytest.raises(ValueError):
            validation.check_training(*wrong)
    for wrong in ({"group_size": 1}, {"max_searches": 4}, {"judge_model": "m"}, {"judge_revision": "A" * 40}):
        with pytest.raises(ValueError):
            validation.check_rollouts(**({"group_size": 2, "max_searches": 3, "epochs": 1, "time_budget_hours": 1.0} | wrong))


def test_code_verification_is_opt_in(spark):
    r = "<think>t</think><answer>a</answer>"
    rows = spark.createDataFrame([(1, "s", "p", r, "x = 1", "assert x == 1"), (2, "s", "p", r, "x = 1", "assert x == 2"), (3, "s", "p", r, None, None)], "id int, source string, prompt string, response string, code string, tests string")
    off = {x.id: x.reason for x in preparation.gated(rows, ["s"]).collect()}
    on = {x.id: x.reason for x in preparation.gated(rows, ["s"], run_code=True).collect()}
    assert off == {1: "local-code-tests_failed", 2: "local-code-tests_failed", 3: None} and on == {1: None, 2: "local-code-tests_failed", 3: None}


def test_grounded_report_keeps_support_and_validity_apart(spark):
    rows = spark.createDataFrame(
        [("off", "Paris", "Paris", [], None, [], [], [], False, None, 1.0), ("local", "Rome [x]", "Rome", ["a", "b"], 1, ["x", "y"], ["y"], ["x"], True, True, 9.0)],
        "search_mode string, prediction string, answer string, queries array<string>, valid_tool_calls long, retrieved_ids array<string>, supporting_ids array<string>, cited_ids array<string>, search_required boolean, answer_found boolean, elapsed_seconds double",
    )
    got = {r.search_mode: r for r in grounded.report(rows).collect()}
    assert set(got) == {None, "off", "local"} and got["local"].citation_precision == 0 and got["local"].citation_validity == 1
    assert got["local"].retrieval_mrr == 0.5 and got[None].valid_tool_call_rate == 0.5 and got[None].query_recovery_rate == 1.0 and got[None].latency_p95_seconds == pytest.approx(8.6)
    assert {r.search_mode for r in grounded.report(rows.where("search_mode = 'off'")).collect()} == {None}
    made = grounded.benchmark(spark.createDataFrame([("q", "a")], "question string, answer string"), lambda d: d.withColumns({"prediction": F.lit("a [i]"), "cited_ids": F.array(F.lit("i"))}))
    assert {(r.search_mode, r.answer_found) for r in made.collect()} == {("off", True), ("local", True)}


def test_fused_ties_keep_first_seen_order(spark):
    lex = spark.createDataFrame([(1, "a", 9.0, 1), (1, "b", 8.0, 2)], "query_id long, k string, score double, rank int")
    den = spark.createDataFrame([(1, "c", 0.9, 1), (1, "b", 0.8, 2)], "query_id long, k string, score double, rank int")
    rows = search.fused(lex, den, "k").orderBy("rank").collect()
    assert [r.k for r in rows] == ["b", "a", "c"] and rows[1].dense == 0.0 and rows[2].bm25 == 0.0
    with pytest.raises(Exception, match="another length"):
        search.valid_vectors(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")).collect()


def test_judge_output_faults(spark):
    good = {"answer_correctness": 0.5, "evidence_support": 1, "search_quality": 0, "reason": "r" * 600}
    text = json.dumps(good)
    bad = {
        None: "did not contain", "none": "did not contain", f"x {text}": "leading", f"{text} y": "trailing", f"{text} }}": "trailing", "{": "invalid JSON", "{bad} x": "invalid JSON", json.dumps(good | {"x": 1}): "schema", json.dumps({"a": {"b": "}"}}) + " z": "trailing",
        json.dumps(good | {"search_quality": True}): "search_quality was not numeric", json.dumps(good | {"evidence_support": "1"}): "evidence_support was not numeric", json.dumps(good | {"search_quality": 1.1}): "search_quality was outside", json.dumps(good | {"evidence_support": -1e-9}): "outside",
        json.dumps(good | {"reason": 1}): "not a string", json.dumps(good | {"reason": None}): "not a string", text.replace("0.5", "NaN"): "judge", text.replace("0.5", "1e999"): "judge",
    }
    fine = {f" \n{text}\t ": "r" * 500, json.dumps(good | {"reason": 'a "quoted\\" } brace {'}): 'a "quoted\\" } brace {'}
    rows = spark.createDataFrame([(t,) for t in [*bad, *fine]], "t string").select("t", judge.judge_score(F.col("t")).alias("j"))
    for r in rows.collect():
        if r.t in fine:
            assert tuple(r.j) == (0.5, 1.0, 0.0, True, fine[r.t])
        else:
            assert tuple(r.j)[:4] == (0.0, 0.0, 0.0, False) and bad[r.t] in r.j.reason, (r.t, r.j.reason)


def test_code_runs_within_limits(tmp_path):
    run = preparation.runs_clean
    assert run("x = 1", "assert x == 1") and not run("x = 1", "assert x == 2") and not run("def f(:", "") and run(None, None)
    assert not run("while True: pass", "", 0.5) and not run("x = bytearray(1 << 33)", "") and run("print('x' * 10**6)", "import sys; sys.exit(0)") and not run("", "raise SystemExit(3)")
    mark = tmp_path / "mark"
    later = f"import time; time.sleep(2); open({str(mark)!r}, 'w')"
    late = f"import subprocess, sys; subprocess.Popen([sys.executable, '-c', {later!r}])"
    assert run(late, "") and (__import__("time").sleep(3), not mark.exists())[1]


def test_judge_payload(spark):
    rows = spark.createDataFrame([("q", "a", "p", 1, [("x", "ok", [("i", "t", "body", "s")])])], "question string, answer string, prediction string, searches_used int, trace array<struct<query:string,status:string,results:array<struct<id:string,title:string,content:string,snippet:string>>>>")
    got = json.loads(judge.payloads(rows, 3).first().payload)
    assert got["evidence"] == [{"id": "i", "title": "t", "content": "bod"}] and got["search_trace"][0]["result_ids"] == ["i"]


def test_reward_of_a_trace(spark):
    trace = "array<struct<query:string,status:string,result_ids:array<string>>>"
    schema = f"prediction string, answer string, raw string, trace {trace}, supporting_ids array<string>, search_required boolean, searches_used int"
    one = ("Paris [doc:1]", "Paris", "<|answer|>Paris <|citation|>doc:1", [("q", "ok", ["doc:1"])], ["doc:1"], True, 1)
    two = ("Paris", "Paris", "Paris", [("q", "empty", []), ("r", "ok", ["doc:1"])], ["doc:1"], True, 2)
    rows = rollouts.parts(spark.createDataFrame([one, two], schema))
    got = rows.withColumn("reward", evaluation.reward(rows)).orderBy("searches_used").collect()
    assert got[0].reward == pytest.approx(1.93) and got[0].query_recovery == 0.0 and got[1].query_recovery == 1.0


def test_mixture_resumes_where_it_stopped(spark):
    sources = spark.createDataFrame([("reasoning", 2), ("general", 1)], "source string, length long")
    names = lambda df: [("rg"[r.source == "general"], r.cursor) for r in df.orderBy("position").collect()]
    whole = names(corpus.mixture_tokens(sources, 10, 0.7, 4))
    assert [s for s, _ in whole].count("r") == 7 and whole[4:] == names(stateful.resumed_mixture(sources, 10, 0.7, 4, 4, 6))
    state = corpus.mixture_state(sources, 10, 0.7, 4).first()
    assert (state.reasoning_tokens, state.general_tokens, state.reasoning_cursor, state.general_cursor) == (3, 1, 1, 0)
    with pytest.raises(Exception, match="empty"):
        corpus.mixture_tokens(sources.withColumn("length", F.lit(0).cast("long")), 10, 0.7, 4).collect()


def test_articles_and_shuffles(spark):
    rows = spark.createDataFrame([(1, None, "A b", None, "x" * 200), (2, "p/q", " ", None, "x" * 200), (3, "p/q", "C", "u", "y" * 200), (4, "z", "D", "u", "short")], "n int, id string, title string, url string, text string")
    got = articles.articles(rows, 2, "n").collect()
    assert [(r.id, r.url) for r in got] == [("wiki-0", "https://en.wikipedia.org/wiki/A_b"), ("wiki-p_q", "u")]
    more = rows.union(spark.createDataFrame([(5, "", "E", "", "z" * 200)], rows.schema))
    assert sorted(r.id for r in articles.articles(more, None, "n").collect()) == ["wiki-0", "wiki-2", "wiki-p_q"]
    first = [r.id for r in articles.shuffled(spark.range(100), "id", 1).collect()]
    assert first == [r.id for r in articles.shuffled(spark.range(100), "id", 1).collect()] != sorted(first) and sorted(first) == list(range(100))


def test_sample_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\r\nb\n" * 50), (2, "short"), (3, "é" * 30_000)], "doc_id long, text string")
    samples = articles.tokenizer_samples({"education": docs})
    assert articles.write_samples(samples, str(tmp_path / "s")) == 2
    got = {r.name: r.text for r in articles.read_samples(spark, str(tmp_path / "s")).collect()}
    assert got == {"education-00001.txt": ("a\r\nb\n" * 50).strip(), "education-00003.txt": "é" * 20_000}
    with pytest.raises(ValueError):
        articles.write_samples(samples.where("false"), str(tmp_path / "n"))
    with pytest.raises(FileNotFoundError):
        articles.read_samples(spark, str(tmp_path / "n"))


def test_masks_and_trajectory_limits(spark):
    text = "<|problem|>p<|reasoning|>r"
    spans = spark.createDataFrame([(text,), ("none",), ("<|tool_result|>a",)], "t string").select(dialogue.masked_spans(F.col("t")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in spans] == [[(0, 12)], [], [(0, 16)]]
    step = "struct<query:string,evidence:array<" + trajectories.RESULT + ">>"
    rows = spark.createDataFrame([("q", "a", [("x", [])] * 4)], f"question string, answer string, searches array<{step}>")
    with pytest.raises(Exception, match="at most 3"):
        trajectories.generate(rows).collect()


def test_fetching_checks_every_hop():
    pages = {
        "https://a.org/": fetch.Reply(302, {"location": "/b"}), "https://a.org/b": fetch.Reply(200, {"content-type": "text/html; charset=utf-8"}, b"<p>hi</p><script>x</script>"),
        "https://loop.org/": fetch.Reply(301, {"location": "https://loop.org/"}), "https://big.org/": fetch.Reply(200, {"content-type": "text/plain"}, b"x" * 50), "https://pdf.org/": fetch.Reply(200, {"content-type": "application/pdf"}, b"x"),
        "https://no.org/robots.txt": fetch.Reply(200, {}, b"User-agent: *\nDisallow: /"), "https://no.org/": fetch.Reply(200, {"content-type": "text/plain"}, b"x"), "https://out.org/": fetch.Reply(302, {"location": "http://10.0.0.1/"}),
    }
    get = lambda u: pages.get(u, fetch.Reply(404))
    public = lambda u: None if "10.0.0.1" in u else u
    found = {u: fetch.fetched(u, get, public, fetch.Robots(get, public), most=40) for u in ("https://a.org/", "https://loop.org/", "https://big.org/", "https://pdf.org/", "https://no.org/", "https://out.org/")}
    assert found.pop("https://a.org/") == "hi" and set(found.values()) == {None}
    waits, replies = [], iter([fetch.Reply(429, {"retry-after": "9"}), fetch.Reply(500), fetch.Reply(200)])
    assert fetch.with_retries(lambda: next(replies), 3, waits.append).status == 200 and waits == [4.0, 2.0]
    with pytest.raises(RuntimeError):
        fetch.with_retries(lambda: fetch.Reply(503), 2, waits.append)


def test_web_search_rows(spark):
    def find(text, count):
        if text == "down":
            raise OSError("no route")
        return [{"url": f"https://e/{i}", "title": "t", "description": "d"} for i in range(count + 5)]

    queries = spark.createDataFrame([(1, " a  b "), (2, "down"), (3, " ")], "query_id long, text string")
    rows = fetch.search(queries, find, 3, 2, lambda s: None).collect()
    assert sum(r.query_id == 1 for r in rows) == 6 and [r.error for r in rows if r.query_id == 2] == ["web search failed after retries: no route"] and not any(r.query_id == 3 for r in rows)


def test_shuffled_stream_batches(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    stateful.shuffled_batches(stream, "id", 3, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))
    files.append_metrics(spark.range(1), str(tmp_path / "log"))
    files.append_metrics(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_rounds_of_a_tool_loop_are_limited(spark):
    good = '<|tool_call|>{"name":"search","arguments":{"query":"%s"}}<|end_tool_call|>'
    turns = [good % "a", "<|tool_call|>bad<|end_tool_call|>", good % "b", good % "c", "<|tool_call|>bad<|end_tool_call|>", "late answer"]
    rows = [(1, i, t, "local", 1, "ok") for i, t in enumerate(turns)] + [(2, 0, good % "STRASSE", "local", 3, "ok"), (2, 1, good % "straße", "local", 3, "ok"), (2, 2, "done", "local", 3, None)]
    played = rollouts.history(spark.createDataFrame(rows, "request_id int, turn int, text string, mode string, max_searches int, outcome string"))
    status = {(r.request_id, r.turn): r.status for r in played.collect()}
    assert [status[1, i] for i in range(6)] == ["ok", "invalid", "search_limit", "search_limit", "invalid", "after_end"] and [status[2, i] for i in range(3)] == ["ok", "rejected", "answer"]
    assert {r.request_id: r.finish_reason for r in rollouts.finish_reason(played).collect()} == {1: "search_limit", 2: "answer"}
    assert {r.request_id: r.text for r in rollouts.final_text(played).collect()} == {1: rollouts.NO_ANSWER, 2: "done"}


def test_rewards_are_finite_and_speed_is_kept(spark):
    for odd in (math.nan, math.inf, None):
        with pytest.raises(Exception, match="finite"):
            evaluation.advantages(spark.createDataFrame([(1, 1.0), (1, odd)], "g int, reward double"), "g").collect()
    log = spark.createDataFrame([("a", 1, 1, 10, 2.0, 7.5)], "run string, step int, reasoning_tokens long, tokens_seen long, loss double, tokens_per_second double")
    assert evaluation.compared(log, "run", "step").first().runs[0].tokens_per_second == 7.5


def test_whole_numbers_of_a_call(spark):
    call = '<|tool_call|>{"name":"search","arguments":{"query":"q"%s}}<|end_tool_call|>'
    want = {"": 5, ',"top_k":5.0': 5, ',"top_k":"7"': 7, ',"top_k":true': 1, ',"top_k":5.5': None, ',"top_k":"x"': None, ',"top_k":null': None, ',"top_k":false': None, ',"top_k":11': None, ',"top_k":[1]': None}
    rows = spark.createDataFrame([(k, call % k) for k in want], "k string, t string").select("k", dialogue.tool_call(F.col("t"))["top_k"].alias("n"))
    assert {r.k: r.n for r in rows.collect()} == want


def test_exact_percentiles_against_sorting(spark):
    import numpy as np

    r = np.random.default_rng(3)
    data = [("a", float(x)) for x in r.normal(size=3000)] + [("b", float(x)) for x in r.integers(0, 3, 500)] + [("c", 4.0), (None, 1.0), (None, 2.0), ("d", None)]
    got = {x.k: x for x in evaluation.percentiles(spark.createDataFrame(data, "k string, v double"), "v", "k", lo=0.0, p50=0.5, p95=0.95, hi=1.0).collect()}
    for k in ("a", "b", "c", None):
        values = [v for g, v in data if g == k]
        assert [got[k].lo, got[k].p50, got[k].p95, got[k].hi] == pytest.approx(list(np.quantile(values, [0, 0.5, 0.95, 1]))) and got[k].n == len(values)
    assert (got["d"].n, got["d"].p50) == (1, 0.0)


def test_parts_of_a_page_beyond_its_limit_are_not_read():
    read = []
    body = (read.append(i) or b"x" * 10 for i in range(100))
    page = fetch.Reply(200, {"content-type": "text/plain"}, body)
    assert fetch.page_of(page, 25) is None and len(read) == 3
    assert fetch.page_of(fetch.Reply(200, {"content-type": "text/plain; charset=latin-1"}, [b"caf", b"\xe9"])) == "café"


def test_cached_rows_go_without_requests(spark, tmp_path):
    schema = "key string, at double, kind string, expires double, payload string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1000.0, "put", 1050.0, "x"), ("b", 1000.0, "put", 1e9, "y"), ("a", 1010.0, "get", None, None)], schema).coalesce(1).write.parquet(source)
    stream = lambda: stateful.cache(spark.readStream.schema(schema).parquet(source), "1 second").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    keys = lambda: {r.key.key for r in spark.read.format("statestore").load(str(tmp_path / "c")).select("key").collect()}
    stream()
    assert keys() == {"a", "b"}
    spark.createDataFrame([("c", 1100.0, "get", None, None)], schema).coalesce(1).write.mode("append").parquet(source)
    stream()
    assert keys() == {"b"}
    assert {(r.key, r.hit) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", True), ("c", False)}


def test_a_burst_is_spread_over_batches(spark, tmp_path):
    spark.range(0, 700, 1, 7).write.parquet(str(tmp_path / "in"))
    run = lambda: sorted(map(tuple, stateful.admitted(spark, str(tmp_path / "in"), "id long", str(tmp_path / "w"), 3).collect()))
    assert run() == [(0, 300, 3, 4), (1, 300, 3, 1), (2, 100, 1, 0)]
    spark.range(700, 1000, 1, 4).write.mode("append").parquet(str(tmp_path / "in"))
    assert [x[2:] for x in run()][3:] == [(3, 1), (1, 0)]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "w" / "out")).collect()) == list(range(1000))


def test_paged_source(spark, tmp_path):
    from corpusflow.sources.paged import PagedSource

    (tmp_path / "total").write_text("95")
    spark.dataSource.register(PagedSource)
    options = {"transport": "tests.paged_transport:get", "page": 10, "pages_per_task": 3}
    rows = spark.read.format("paged").options(**options).schema("i long, text string").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4 and sorted((r.i, r.text) for r in rows.collect()) == [(i, f"row {i}") for i in range(95)]
    stream = spark.readStream.format("paged").options(**options).schema("i long").load(str(tmp_path))

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    (tmp_path / "total").write_text("123")
    run()
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(123))
