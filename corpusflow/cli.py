"""Command line: python -m corpusflow.cli COMMAND ...; each prints one JSON object."""

from __future__ import annotations

import argparse
import hashlib
import importlib
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import articles, corpus, evaluation, grounded, indexes, preparation, schedules, search, trajectories, validation
from .plans.stage import scope, staged
from .sources import files, jsonl, tokens

LOSSES = "loss double, tokens long"
ANSWERS = "task string, prediction string, answer string"
GROUNDED = "search_mode string, prediction string, answer string, queries array<string>, tool_calls_total long, valid_tool_calls long, retrieved_ids array<string>, supporting_ids array<string>, cited_ids array<string>, search_required boolean, answer_found boolean, elapsed_seconds double"
METRICS = "reasoning_tokens long, tokens_seen long, loss double, tokens_per_second double"
QUESTIONS = f"question string, answer string, query string, evidence array<{trajectories.RESULT}>, searches array<struct<query:string,evidence:array<{trajectories.RESULT}>>>, reasoning string"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]  # reports: a few rows


def _named(name: str):
    """What `module:function` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with n, staged, so that n is the same in all that is made of them."""
    return staged(rows.withColumn("n", F.monotonically_increasing_id()), name)


def bootstrap_data(spark, a) -> dict:
    rows = spark.read.schema("id string, title string, url string, text string").json(a.input)
    found = staged(articles.articles(_numbered(rows, "articles"), a.limit, "n"), "articles-found")
    asked = articles.with_no_search(articles.questions(found))
    out = {"articles": jsonl.write_whole(found, f"{a.output}/articles", True), "questions": jsonl.write_whole(asked, f"{a.output}/questions", True)}
    given = {"education": a.education, "reasoning": a.reasoning}
    streams = {k: _numbered(spark.read.schema("text string").json(path), "sample-rows") for k, path in given.items() if path}
    if streams:
        out["tokenizer_samples"] = articles.write_samples(articles.tokenizer_samples(streams, "n"), f"{a.output}/tokenizer-sample")
    return out


def prepare_data(spark, a) -> dict:
    manifest = validation.load_manifest(spark, a.manifest)
    prompts = staged(jsonl.evaluation_prompts(spark, a.prompts).select(F.monotonically_increasing_id().alias("item_id"), F.col("prompt").alias("text")), "prompts")
    included = sorted({s for e in manifest.values() for s in e.get("included_sources", [])})
    outputs = {}
    for kind, path, cap in (("reasoning", a.reasoning, a.reasoning_cap), ("general", a.general, a.general_cap)):
        if not path:
            continue
        rows = _numbered(preparation.with_text(spark.read.json(path)), "prepare-rows")
        checked = preparation.gated(rows, included) if kind == "reasoning" else preparation.general_checked(rows).withColumn("source", F.lit("general"))
        docs = preparation.reasoning_documents(checked, "n") if kind == "reasoning" else preparation.general_documents(checked, "general", "n")
        if a.tokenizer:
            docs = staged(tokens.encoded(docs, a.tokenizer), "prepare-ids")
            counted = docs.withColumn("n_tokens", F.size("ids").cast("long"))
        else:
            counted = docs.withColumn("n_tokens", F.regexp_count("text", F.lit(r"\S+")).cast("long"))
        chosen = staged(preparation.corpus_selection(counted.drop("ids"), prompts if a.prompts else None, cap, "n", "n_tokens"), "prepare-fates")
        report = _rows(preparation.corpus_report(chosen))[0] | {"filtering": _rows(preparation.counters(checked))[0]}
        kept = docs.join(chosen.where("kept > 0").select("n", "kept"), "n")
        if a.tokenizer:
            raw = spark.read.format("binaryFile").load(a.tokenizer).first().content  # one small file
            own = {k: report[k] for k in ("duplicates_removed", "contaminated_removed", "filtering")}
            known = {"tokenizer_sha256": hashlib.sha256(raw).hexdigest(), **own}
            report = tokens.write(kept.drop("text", "kept"), f"{a.output}/{kind}", _vocabulary(raw), cap, **known)
        else:
            jsonl.write_whole(kept.select("text", "source", "verification", "kept"), f"{a.output}/{kind}", True)
        outputs[kind] = report
    run = {"format_version": 2, "datasets": manifest, "evaluation_prompts": prompts.count(), "outputs": outputs}
    files.write_report(spark, run, f"{a.output}/preparation-manifest.json")
    return outputs


def _vocabulary(raw: bytes) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode()).get_vocab_size()


def build_index(spark, a) -> dict:
    config = validation.load_retrieval_config(spark, a.config)
    chunks = search.chunk_table(jsonl.valid(jsonl.documents(spark, a.input)))
    return {"chunks": indexes.build(chunks, a.output, _named(a.encoder) if a.encoder else None, config)}


def ask(spark, a) -> dict:
    index = indexes.Index(spark, a.index, _named(a.encoder) if a.encoder else None)
    queries = spark.createDataFrame([(0, a.query)], "query_id long, text string")
    return {"results": _rows(index.search(queries, a.k).orderBy("rank"))}


def benchmark_grounded(spark, a) -> dict:
    """--answerer names a function from examples to answers (see grounded.benchmark)."""
    examples = jsonl.valid(jsonl.rollout_prompts(spark, a.input))
    done = grounded.benchmark(examples, _named(a.answerer), tuple(a.modes.split(",")))
    written = jsonl.write_whole(done, a.output, True)
    return {"records": written, "report": _rows(grounded.report(spark.read.schema(GROUNDED).json(a.output)))}


def make_trajectories(spark, a) -> dict:
    rows = spark.read.schema(QUESTIONS).json(a.input)
    return {"trajectories": jsonl.write_whole(trajectories.generate(rows), a.output, True)}


def score_lm(spark, a) -> dict:
    rows = spark.read.schema(LOSSES).json(a.input).withColumn("tokens", F.coalesce("tokens", F.lit(1)))
    return _rows(evaluation.language_model(rows))[0]


def score_reasoning(spark, a) -> dict:
    return {"report": _rows(evaluation.answers(spark.read.schema(ANSWERS).json(a.input)))}


def score_grounded(spark, a) -> dict:
    return {"report": _rows(grounded.report(spark.read.schema(GROUNDED).json(a.input)))}


def compare_proxies(spark, a) -> dict:
    last = jsonl.last_records(spark, f"{a.input}/*/metrics.jsonl", METRICS)
    named = last.withColumns({"run": F.element_at(F.split("file", "/"), -2), "step": F.lit(1)})
    return _rows(evaluation.compared(named, "run", "step"))[0]


def experiment_plan(spark, a) -> dict:
    runs = schedules.scheduled_runs(spark)
    plan = {"total_scheduled_training_hours": schedules.scheduled_hours(runs).first().scheduled_hours, "reserved_calibration_sft_rl_evaluation_hours": schedules.RESERVED_HOURS, "runs": _rows(runs)}
    if a.output:
        files.write_report(spark, plan, a.output)
    return plan


def decontaminate(spark, a) -> dict:
    docs = spark.read.parquet(a.input)
    prompts = jsonl.evaluation_prompts(spark, a.prompts).select(F.monotonically_increasing_id().alias("item_id"), F.col("prompt").alias("text"))
    kept = corpus.exact_dedup(corpus.decontaminate(docs, prompts))
    kept.write.mode("errorifexists").parquet(a.output)
    return {"documents": spark.read.parquet(a.output).count()}


#: Command: function, required options, optional ones with defaults.
COMMANDS = {
    "bootstrap-data": (bootstrap_data, ("input", "output"), {"limit": 5000, "education": "", "reasoning": ""}),
    "prepare-data": (prepare_data, ("manifest", "output"), {"reasoning": "", "general": "", "prompts": None, "tokenizer": None, "reasoning_cap": 2_000_000_000, "general_cap": 1_000_000_000}),
    "build-index": (build_index, ("input", "output"), {"config": None, "encoder": None}),
    "ask": (ask, ("index", "query"), {"k": 5, "encoder": None}),
    "make-trajectories": (make_trajectories, ("input", "output"), {}),
    "score-lm": (score_lm, ("input",), {}),
    "score-reasoning": (score_reasoning, ("input",), {}),
    "score-grounded": (score_grounded, ("input",), {}),
    "benchmark-grounded": (benchmark_grounded, ("input", "answerer", "output"), {"modes": "off,local"}),
    "compare-proxies": (compare_proxies, ("input",), {}),
    "experiment-plan": (experiment_plan, (), {"output": None}),
    "decontaminate": (decontaminate, ("input", "prompts", "output"), {}),
}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="corpusflow")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, required, optional) in COMMANDS.items():
        p = commands.add_parser(name)
        for o in required:
            p.add_argument(f"--{o.replace('_', '-')}", required=True)
        for o, default in optional.items():
            p.add_argument(f"--{o.replace('_', '-')}", default=default, type=int if isinstance(default, int) else str)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusflow").getOrCreate()
    with scope(spark):
        out = COMMANDS[a.command][0](spark, a)
    print(json.dumps(out, default=str, sort_keys=True))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
