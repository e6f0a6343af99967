"""Texts and fates are read once, however many results are taken from them."""

from pyspark.sql import functions as F

from corpusflow.operators import preparation


def test_selection_and_report_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(x):
        read.add(1)
        return x

    told = F.udf(told, "string").asNondeterministic()
    i = F.col("id")
    docs = spark.range(0, 40, 1, 2).select(i.alias("doc_id"), told(F.concat(F.lit("text "), i % 30)).alias("text"), F.lit("s").alias("source"), F.lit("v").alias("verification"), F.lit(2).cast("long").alias("n"))
    chosen = preparation.corpus_selection(docs, None, 41, "doc_id", "n").collect()
    assert read.value == 40
    assert {f: sum(r.fate == f for r in chosen) for f in ("kept", "truncated", "duplicate", "beyond_cap")} == {"kept": 20, "truncated": 1, "duplicate": 10, "beyond_cap": 9}
    read.add(-40)
    fates = spark.createDataFrame(chosen).coalesce(2).withColumn("fate", told(F.col("fate")))
    report = preparation.corpus_report(fates).first()
    assert read.value == 40
    assert (report.tokens, report.documents, report.duplicates_removed, report.truncated_documents, report.source_documents) == (41, 21, 10, 1, {"s": 21})
