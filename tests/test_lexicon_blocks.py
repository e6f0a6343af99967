"""The postings of an index pass one shuffle."""

from pyspark.sql import functions as F

from corpusflow.operators import lexicon


def test_postings_are_shuffled_once(spark):
    rows = spark.createDataFrame([("content", k, ["the", f"w{k % 7}", "the"]) for k in range(300)], "field string, key long, terms array<string>")
    made = lexicon.blocks(rows, F.lit(3.0), 5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = made.collect()
    assert sum(r.n for r in got) == 600 and {r.term for r in got} == {"the", *(f"w{k}" for k in range(7))}
    the = [e for r in got if r.term == "the" for e in r.entries]
    assert sorted(e.key for e in the) == list(range(300)) and all((e.tf, e.length, e.positions) == (2, 3, [0, 2]) for e in the)
    assert len({r.window for r in got}) == 5 and all([e.key for e in r.entries] == sorted(e.key for e in r.entries) for r in got)
