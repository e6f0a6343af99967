"""Articles: normalisation, accepted-row limits, questions, tokenizer samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.prefix import numbered
from ..sources import versions

# Texts of the question rows, and the two rows that need no search.
QUESTION = ('What is the main topic of the Wikipedia article titled "', '"?')
REASONING = "Search the local encyclopedia, inspect the returned article, and cite it."
NO_SEARCH = (
    ("bootstrap-arithmetic", "What is 2 + 2?", "4", "This is stable arithmetic, so no search is needed."),
    ("bootstrap-definition", "What is the capital of France?", "Paris", "This bootstrap example tests a no-search answer path."),
)
ARTICLE_URL = "https://en.wikipedia.org/wiki/"


def usable(title: Column, text: Column) -> Column:
    return (F.length(X.stripped(title)) > 0) & (F.length(X.stripped(text)) >= 200)


def quoted(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and _.-~/ alone."""
    encoded = F.url_encode(c)
    for shown, want in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(shown), F.lit(want))
    return encoded


def articles(rows: DataFrame, limit: int | None = None, order: str = "id") -> DataFrame:
    """id, title, url, text of usable rows, the first `limit` accepted ones by
    order. An id that is missing or blank becomes the number of the accepted
    rows before it; only where there is one rows are numbered, by ranges (no
    single task sorts the table)."""
    found = rows.where(usable(F.col("title"), F.col("text")))
    if limit is not None:
        found = found.orderBy(order).limit(limit)
    raw = X.stripped(F.coalesce(F.col("id").cast("string"), F.lit("")))
    if found.where(raw == "").head(1):
        found = numbered(found, [order], "_n")
        raw = F.when(raw == "", F.col("_n").cast("string")).otherwise(raw)
    title = X.stripped(F.col("title"))
    url = X.stripped(F.coalesce(F.col("url"), F.lit("")))
    made = F.concat(F.lit(ARTICLE_URL), quoted(F.replace(title, F.lit(" "), F.lit("_"))))
    return found.select(F.concat(F.lit("wiki-"), F.replace(raw, F.lit("/"), F.lit("_"))).alias("id"), title.alias("title"), F.when(url == "", made).otherwise(url).alias("url"), X.stripped(F.col("text")).alias("text"))


def questions(found: DataFrame) -> DataFrame:
    """A question per article, with its evidence."""
    source = F.concat("id", F.lit(":0"))
    evidence = F.struct(source.alias("id"), "title", "url", F.left("text", F.lit(500)).alias("snippet"), F.left("text", F.lit(12_000)).alias("content"), F.lit(1.0).alias("score"), F.lit("local-wikipedia").alias("provider"))
    return found.select(
        F.concat(F.lit("bootstrap-"), "id").alias("id"),
        F.concat(F.lit(QUESTION[0]), "title", F.lit(QUESTION[1])).alias("question"),
        F.col("title").alias("answer"),
        F.col("title").alias("query"),
        F.lit(True).alias("search_required"),
        F.array(source).alias("supporting_ids"),
        F.array(evidence).alias("evidence"),
        F.lit(REASONING).alias("reasoning"),
    )


def with_no_search(rows: DataFrame) -> DataFrame:
    """The question rows and the constant ones, which lack query and evidence."""
    fixed = rows.sparkSession.createDataFrame(list(NO_SEARCH), "id string, question string, answer string, reasoning string")
    fixed = fixed.withColumns({"search_required": F.lit(False), "supporting_ids": F.array().cast("array<string>")})
    return rows.unionByName(fixed, allowMissingColumns=True)


def tokenizer_samples(streams: dict[str, DataFrame], order: str = "doc_id", limit: int = 256) -> DataFrame:
    """name and text: of each stream the first `limit` texts of 100 characters
    or more, cut to 20,000. This is a sampling operator: its limit is its purpose."""
    out = None
    for label, rows in streams.items():
        text = X.stripped(F.col("text"))
        some = rows.where(F.length(text) >= 100).orderBy(order).limit(limit)
        named = some.select(F.concat(F.lit(f"{label}-"), F.lpad(F.col(order).cast("string"), 5, "0"), F.lit(".txt")).alias("name"), F.left(text, F.lit(20_000)).alias("text"))
        out = named if out is None else out.unionByName(named)
    return out


def write_samples(samples: DataFrame, path: str) -> int:
    """A text file for each sample (name, text), in a folder of that name, as a new
    version of path; returns their number. The version's pointer is the mark that
    all are there; without samples it is an error. A text may hold any line ends."""
    spark = samples.sparkSession
    found = []

    def write(folder: str) -> None:
        samples.select("name", "text").write.partitionBy("name").option("lineSep", "\n").text(folder)
        found.append(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path").count())
        if not found[0]:
            raise ValueError("there are no samples")

    versions.publish(spark, path, write)
    return found[0]


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """name and text of the samples of the newest version that is whole."""
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(path)
    rows = spark.read.text(folder, wholetext=True)
    return rows.select("name", F.expr("left(value, length(value) - 1)").alias("text"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in a repeatable random order: a range sort on a hash of key and seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
