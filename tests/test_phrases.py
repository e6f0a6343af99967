"""Query texts of items whose words hold line ends."""

from pyspark.sql import functions as F

from corpusflow.operators import lexicon
from corpusflow.queries_index import phrased


def test_phrases_of_words_with_line_ends(spark):
    text = 'a b.\nc d e.\nf g "h i+ j-k'
    rows = spark.createDataFrame([(1, text), (2, "a b c"), (3, None), (4, "")], "query_id int, text string")
    found = lexicon.clauses(rows.select("query_id", phrased(F.col("text")).alias("text")), ["title", "content"]).collect()
    got = {(r.query_id, r.sign, r.field, tuple(r.words)) for r in found}
    first = {(1, "+", None, ("b", "c", "d")), (1, "", None, ("g",)), (1, "", "title", ("b", "c")), (1, "", "content", ("h", "i", "j", "k")), (1, "-", None, ("a", "e", "f"))}
    assert {x for x in got if x[0] != 2} == first
    assert {x for x in got if x[0] == 2} == {(2, "+", None, ("b", "c")), (2, "", "title", ("b",))}
