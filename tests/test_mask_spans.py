"""Masked spans of long turns."""

import time

from pyspark.sql import functions as F

from corpusflow.operators import dialogue


def test_spans_are_found_once(spark):
    turn = "<|tool_call|>c<|end_tool_call|><|tool_result|>" + "r" * 3000 + "<|end_tool_result|>mid"
    rows = spark.createDataFrame([(i, turn * 6) for i in range(40)], "n int, t string")
    at = F.sequence(F.lit(0), F.length("t") - 1)
    labels = dialogue.label_mask(F.transform(at, lambda i: F.lit(1)), at, F.transform(at, lambda i: i + 1), dialogue.masked_spans(F.col("t")))
    began = time.monotonic()
    masked = {r[0] for r in rows.select(F.size(F.filter(labels, lambda x: x == -100))).collect()}
    assert masked == {6 * (3000 + len("<|tool_result|><|end_tool_result|>"))}
    assert time.monotonic() - began < 20  # found per token: minutes
