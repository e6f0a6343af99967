"""A stored lexical index: positions, phrases, fields, required and excluded
clauses, and a top k that reads no block which can't reach it.

postings has a row (block) per term, field and window of documents. Windows are
hashes of the key, so that a block has some WINDOW entries at most, whatever the
term. A block knows its number of entries and its bound: the largest BM25 part,
without idf, that one of them can have. Blocks are made where the documents of a
window meet; files are sorted by a hash of the term (its bucket) and the term, so
that pages of other buckets are passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import scratch, staged
from ..sources import files, versions
from . import retrieval

K1, B = 1.2, 0.75
BUCKETS, WINDOW = 64, 2048
#: Words of a window on average, at most: what one task holds.
WORDS = 1 << 19
#: Windows of each query that are read first, for a threshold.
FIRST = 4
#: Postings of one Arrow batch that is sent back, at most and but for one block.
BATCH = 100_000
ENTRY = "array<struct<key:{0},tf:int,length:int,positions:array<int>>>"


def part(tf, length, mean):
    """BM25's part of a term in a document, without idf; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def blocks(rows: DataFrame, mean: Column, windows: int) -> DataFrame:
    """The blocks of rows (field, key, terms)."""
    return _blocks(_joined(rows), mean, windows)


def _joined(rows: DataFrame) -> DataFrame:
    """field, key, words (terms have no blanks), length."""
    return rows.select("field", "key", F.array_join("terms", " ").alias("words"), F.size("terms").alias("length"))


def _blocks(rows: DataFrame, mean: Column, windows: int) -> DataFrame:
    """The blocks of _joined rows. Texts are shuffled once, by window; a posting never
    is a row. Blocks come in order of terms, for the statistics of pages."""
    kind = ENTRY.format(rows.schema["key"].dataType.simpleString())
    window = F.pmod(F.xxhash64("key"), F.lit(windows)).cast("int")
    placed = rows.where("length > 0").withColumns({"window": window, "mean": mean.cast("double")})
    made = placed.groupBy("window").applyInArrow(_inverted, f"term string, field string, window int, n long, bound double, entries {kind}")
    return made.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).sortWithinPartitions("bucket", "term", "field", "window")


def _inverted(rows: pa.Table) -> pa.Table:
    """The blocks of the documents of one window."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending")], null_placement="at_start")).combine_chunks()
    words = pc.split_pattern(rows["words"], " ").combine_chunks()
    coded, fields = words.flatten().dictionary_encode(), rows["field"].combine_chunks().dictionary_encode()
    size, mean = rows["length"].to_numpy(), rows["mean"].to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    block = coded.indices.to_numpy().astype("int64") * len(fields.dictionary) + fields.indices.to_numpy()[row]
    order = np.argsort(block, kind="stable")  # words come by key and place
    block, row, place = block[order], row[order], place[order]
    new = np.r_[True, block[1:] != block[:-1]]
    at = np.flatnonzero(new | np.r_[True, row[1:] != row[:-1]])  # postings
    tf, row = np.diff(np.r_[at, len(block)]), row[at]
    first = np.flatnonzero(new[at])
    n, of = np.diff(np.r_[first, len(at)]), block[at[first]]
    bound = np.maximum.reduceat(part(tf, size[row], mean[row]), first)
    positions = pa.ListArray.from_arrays(pa.array(np.r_[at, len(block)], pa.int32()), pa.array(place, pa.int32()))
    entries = pa.StructArray.from_arrays([rows["key"].combine_chunks().take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(size[row], pa.int32()), positions], names=["key", "tf", "length", "positions"])
    columns = {
        "term": coded.dictionary.take(pa.array(of // len(fields.dictionary))), "field": fields.dictionary.take(pa.array(of % len(fields.dictionary))), "window": pa.array(np.full(len(first), rows["window"][0].as_py()), pa.int32()),
        "n": pa.array(n), "bound": pa.array(bound), "entries": pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)], pa.int32()), entries),
    }
    made = pa.RecordBatch.from_pydict(columns)
    cuts = np.flatnonzero(np.r_[True, np.diff(first // BATCH) > 0, True])
    return pa.Table.from_batches([made.slice(i, j - i) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """df, written and read back, until the end of the block."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/lexicon-texts-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        files.delete(spark, path)


def build(docs: DataFrame, key: str, fields: dict[str, Column], path: str, boosts: dict[str, float] | None = None, manifest: dict | None = None) -> int:
    """Write the index of docs under path and return the number of documents. An
    existing index or an empty table is an error that leaves nothing behind."""
    spark = docs.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), retrieval.terms(F.coalesce(c, F.lit(""))).alias("terms")) for f, c in fields.items()])).alias("f")
    rows = docs.select(F.col(key).alias("key"), each).select("f.field", "key", "f.terms")
    with _kept(_joined(rows)) as texts:  # texts are taken apart once
        counts = {r.field: r for r in texts.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("words")).collect()}  # a row per field
        n = max((r.n for r in counts.values()), default=0)
        if not n:
            raise ValueError("cannot build an empty search index")
        means = {f: max(r.words, 1) / r.n for f, r in counts.items()}
        windows = max(1, -(-n // WINDOW), -(-sum(r.words for r in counts.values()) // WORDS))
        mean = F.element_at(F.create_map(*[F.lit(x) for f, m in means.items() for x in (f, m)]), F.col("field"))
        dealt = _blocks(texts, mean, windows)
        known = {"format_version": 3, "documents": n, "windows": windows, "fields": {f: {"mean": means[f], "boost": float((boosts or {}).get(f, 1.0))} for f in fields}, "key": docs.schema[key].dataType.simpleString(), **(manifest or {})}

        def write(folder: str) -> None:
            dealt.write.parquet(f"{folder}/postings")
            files.write_report(spark, known, f"{folder}/manifest.json")

        versions.publish(spark, path, write, replace=False)
    return n


# A clause: a sign, a field, and a phrase in quotes or a word.
_CLAUSE = r'([+-]?)(?:({0}):)?(?:"([^"]*)"|([^\s"]+))'


def clauses(queries: DataFrame, fields: list[str]) -> DataFrame:
    """query_id, clause, sign, field (null: all), words and required (how many
    clauses of the query are) of each clause of a query text: words, "phrases in quotes", field:clause, +required, -excluded. A word
    that holds several terms (fore-word) is a phrase. Clauses without terms and
    marks that make no sense are passed over; a field that isn't known is a word."""
    pattern = F.lit(_CLAUSE.format("|".join(fields)))
    group = lambda i: F.regexp_extract_all("text", pattern, F.lit(i))
    found = F.posexplode(F.arrays_zip(group(1).alias("sign"), group(2).alias("field"), group(3).alias("phrase"), group(4).alias("word")))
    rows = queries.select("query_id", found.alias("clause", "c"))
    words = retrieval.terms(F.concat("c.phrase", F.lit(" "), "c.word"))
    known = rows.select("query_id", "clause", "c.sign", F.nullif(F.col("c.field"), F.lit("")).alias("field"), words.alias("words")).where(F.size("words") > 0)
    return known.withColumn("required", F.count_if(F.col("sign") == "+").over(Window.partitionBy("query_id")))


@dataclass
class Lexicon:
    """An index as build() has written it."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.folder = versions.current(self.spark, self.path)
        if self.folder is None:
            raise FileNotFoundError(self.path)
        self.manifest = json.loads(files.read_text(self.spark, f"{self.folder}/manifest.json"))

    def postings(self) -> DataFrame:
        kind = ENTRY.format(self.manifest["key"])
        return self.spark.read.schema(f"term string, field string, window int, n long, bound double, entries {kind}, bucket int").parquet(f"{self.folder}/postings")

    def asked(self, queries: DataFrame) -> DataFrame:
        """A row per query, clause, field, and place i in the clause's words; phrases
        that only repeat what was said count again, as in any sum."""
        fields = self.manifest["fields"]
        every = F.array(*map(F.lit, fields))
        rows = clauses(queries, list(fields)).withColumn("field", F.explode(F.when(F.col("field").isNull(), every).otherwise(F.array("field"))))
        boost = F.element_at(F.create_map(*[F.lit(x) for f, v in fields.items() for x in (f, v["boost"])]), F.col("field"))
        rows = rows.select("query_id", "required", "clause", "sign", "field", boost.alias("boost"), F.size("words").alias("size"), F.posexplode("words").alias("i", "term"))
        return rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))

    def met(self, asked: DataFrame, *columns: str) -> DataFrame:
        """asked with its blocks. Only the buckets of asked terms are read."""
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        blocks = self.postings().where(F.col("bucket").isin(buckets)) if buckets else self.postings().where(F.lit(False))
        return blocks.select("bucket", "term", "field", "window", *columns).join(asked, ["bucket", "term", "field"])

    def held(self, asked: DataFrame) -> DataFrame:
        """The numbers of the blocks of asked words, without entries."""
        return self.met(asked.select("bucket", "term", "field").distinct(), "n", "bound")

    def weighed(self, asked: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """asked with weight: boost and idf, summed over the words of a phrase. Words
        that no document has are left out, and so are phrases with one. held: held()
        of these words, if it is known already."""
        df = (held or self.held(asked)).groupBy("term", "field").agg(F.sum("n").alias("df"))
        n = F.lit(float(self.manifest["documents"]))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        w = Window.partitionBy("query_id", "clause", "field")
        known = asked.join(df, ["term", "field"]).withColumn("weight", F.col("boost") * F.sum(idf).over(w)).withColumn("_known", F.count("*").over(w))
        return known.where("_known = size").drop("_known", "df", "boost")

    def bounds(self, weighed: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """query_id, window, upper (no document of the window scores more) and
        entries (postings there). A phrase counts in a document no more often than
        its rarest word does. Windows without a required clause are left out."""
        met = (held or self.held(weighed)).join(weighed, ["bucket", "term", "field"]).groupBy("query_id", "required", "clause", "sign", "field", "window", "size", "weight").agg(F.count("*").alias("k"), F.min("bound").alias("bound"), F.sum("n").alias("n"))
        per = met.where("k = size").groupBy("query_id", "required", "clause", "sign", "window").agg(F.sum(F.when(F.col("sign") != "-", F.col("weight") * F.col("bound"))).alias("upper"), F.sum("n").alias("n"))
        found = per.groupBy("query_id", "required", "window").agg(F.coalesce(F.sum("upper"), F.lit(0.0)).alias("upper"), F.sum("n").alias("entries"), F.count_if(F.col("sign") == "+").alias("has"), F.count_if(F.col("sign") != "-").alias("wanted"))
        return found.where("has = required AND wanted > 0").select("query_id", "window", "upper", "entries")

    def scores(self, weighed: DataFrame, windows: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, key, score of all matches in the given (query_id, window), or of
        the k best of each. The postings of asked words are dealt by window once,
        whatever the number of queries, and scored there; of a window's matches only
        the k best leave its task. The queries' words go to all tasks."""
        words = weighed.groupBy("bucket", "term", "field").agg(F.max("size").alias("most"))
        asked = weighed.select("query_id", "required", "clause", "sign", "field", "size", "weight", "i", "term").collect()  # a row per query, clause, field and word
        of = weighed.sparkSession.sparkContext.broadcast(_queries(asked))
        phrases = any(r["size"] > 1 for r in asked)
        means = {f: v["mean"] for f, v in self.manifest["fields"].items()}
        here = self.met(F.broadcast(words), "entries").join(F.broadcast(windows.select("window").distinct()), "window", "left_semi")
        parts = ["entries.key", "entries.tf", "entries.length", *([F.when(F.col("most") > 1, F.col("entries.positions")).alias("positions")] if phrases else [])]
        held, wanted = here.select("window", "field", "term", *parts), windows.select("window", "query_id")

        def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
            found = _Postings(postings, means)
            out = [(q, *found.best(of.value[q], k)) for q in queries["query_id"].to_pylist() if q in of.value] if postings.num_rows else []
            size = [len(x) for _, x, _ in out]
            ids = pa.array([q for q, _, _ in out], queries.schema.field("query_id").type).take(pa.array(np.repeat(np.arange(len(out)), size)))
            at, score = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, d) for i, d in ((1, "int64"), (2, "float64")))
            return pa.table({"query_id": ids, "key": found.keys.take(pa.array(at)), "score": pa.array(score)})

        return held.groupBy("window").cogroup(wanted.groupBy("window")).applyInArrow(run, f"query_id {weighed.schema['query_id'].dataType.simpleString()}, key {self.manifest['key']}, score double")

    def search(self, queries: DataFrame, k: int, key: str = "key") -> DataFrame:
        """query_id, key, score, rank of the k best of each query, ties by key.

        Each query's FIRST windows by bound are scored; the kth score found there
        is a threshold, and of the other windows those are read whose bound
        reaches it. The result is that of a scan of all postings.
        """
        weighed, first, rest, best = self._planned(queries, k)
        found = best.unionByName(self.scores(weighed, rest, k))
        return retrieval.top(found, k, "key").withColumnRenamed("key", key)

    def plan(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The weighed words, the windows that are read first and the others that
        have to be, with the number of their entries."""
        return self._planned(queries, k)[:3]

    def _planned(self, queries: DataFrame, k: int) -> tuple[DataFrame, ...]:
        """plan and the k best of the windows that are read first."""
        asked = self.asked(queries)
        held = staged(self.held(asked), "lexicon-held")
        weighed = staged(self.weighed(asked, held), "lexicon-words")
        bounds = staged(self.bounds(weighed, held), "lexicon-bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "window")
        ranked = bounds.withColumn("_r", F.row_number().over(order))
        first, other = (ranked.where(c).drop("_r") for c in (f"_r <= {FIRST}", f"_r > {FIRST}"))
        best = staged(retrieval.top(self.scores(weighed, first, k), k, "key"), "lexicon-best")
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        # Scores are rounded to six places.
        rest = other.join(kth, "query_id", "left").where("kth IS NULL OR upper + 1e-6 >= kth").drop("kth")
        return weighed, first, rest, best.drop("rank")

    def reading(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, entries (postings of its words) and read (those search() reads)."""
        weighed, first, rest = self.plan(queries, k)
        every = self.bounds(weighed).groupBy("query_id").agg(F.sum("entries").alias("entries"))
        read = first.unionByName(rest).groupBy("query_id").agg(F.sum("entries").alias("read"))
        return every.join(read, "query_id")


def _queries(asked: list) -> dict:
    """required and clauses of each query: sign and (field, weight, words) of a clause."""
    out: dict = {}
    for r in sorted(asked, key=lambda r: (r.clause, r.field, r.i)):
        clauses = out.setdefault(r.query_id, (r.required, {}))[1]
        fields = clauses.setdefault(r.clause, (r.sign, {}))[1]
        fields.setdefault(r.field, (r.weight, []))[1].append(r.term)
    return {q: (n, [(sign, [(f, w, words) for f, (w, words) in fields.items()]) for sign, fields in clauses.values()]) for q, (n, clauses) in out.items()}


def rounded(score: np.ndarray) -> np.ndarray:
    """Six places, as SQL rounds the shortest decimal that stands for a number."""
    scaled = score * 1e6
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[i] = int((Decimal(repr(float(score[i]))) * 10**6).quantize(Decimal(1), ROUND_HALF_UP))
    return whole / 1e6


def _common(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers that all ascending lists hold, and where each list holds them."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    same, place = lists[order[0]], {order[0]: np.arange(len(lists[order[0]]))}
    for i in order[1:]:
        if not len(same):
            break
        at = np.minimum(np.searchsorted(lists[i], same), len(lists[i]) - 1)
        hit = lists[i][at] == same
        same, place = same[hit], {j: x[hit] for j, x in {**place, i: at}.items()}
    return same, [place.get(i, same) for i in range(len(lists))]


class _Postings:
    """The postings of asked words in one window, as arrays."""

    def __init__(self, rows: pa.Table, means: dict[str, float]):
        rows = rows.combine_chunks()
        flat = lambda c: rows[c].combine_chunks().flatten() if rows.num_rows else pa.array([], rows.schema.field(c).type.value_type)
        coded = flat("key").dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary, null_placement="at_start")
        self.keys, rank = coded.dictionary.take(order), np.empty(len(order), "int64")
        rank[order.to_numpy()] = np.arange(len(order))
        self.doc = rank[coded.indices.to_numpy()]
        n = pc.list_value_length(rows["key"]).to_numpy()
        self.last = np.cumsum(n)
        self.means, fields = means, rows["field"].to_pylist()
        self.length = flat("length").to_numpy()
        self.wide = int(self.length.max(initial=0)) + 1
        self.part = part(flat("tf").to_numpy(), self.length, np.repeat([float(means[f]) for f in fields], n))
        self.at = {w: (e - m, e) for w, e, m in zip(zip(fields, rows["term"].to_pylist()), self.last.tolist(), n.tolist())}
        if "positions" in rows.column_names:
            # A word without places has a null: its postings have no list.
            held = rows["positions"].combine_chunks()
            lists = held.flatten() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
            known = np.repeat(held.is_valid().to_numpy(zero_copy_only=False), n) if rows.num_rows else np.zeros(0, bool)
            self.list_of = np.cumsum(known) - 1
            self.size = pc.list_value_length(lists).to_numpy()
            self.begin, self.places = np.cumsum(self.size) - self.size, lists.flatten().to_numpy()

    def documents(self, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ascending numbers (key and length) of the documents of a word's postings,
        and these; of rows that share a key and a length there is none."""
        start, end = span
        own = self.doc[start:end] * self.wide + self.length[start:end]
        if (own[1:] > own[:-1]).all():
            return own, np.arange(start, end)
        known, first, times = np.unique(own, return_index=True, return_counts=True)
        return known[times == 1], start + first[times == 1]

    def phrase(self, field: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold the words side by side, and their parts."""
        none = np.zeros(0, "int64"), np.zeros(0)
        spans = [self.at.get((field, w)) for w in words]
        if None in spans:
            return none
        held = [self.documents(x) for x in spans]
        same, place = _common([x for x, _ in held])
        if not len(same):
            return none
        starts = []
        for i, (_, postings) in enumerate(held):
            lists = self.list_of[postings[place[i]]]
            size = self.size[lists]
            at = np.repeat(self.begin[lists] - np.cumsum(size) + size, size) + np.arange(size.sum())
            starts.append(np.repeat(np.arange(len(same)), size) << 32 | (self.places[at].astype("int64") - i + len(words)))
        freq = np.bincount(_common(starts)[0] >> 32, minlength=len(same))
        same, freq = same[freq > 0], freq[freq > 0]
        return same // self.wide, part(freq, same % self.wide, self.means[field])

    def best(self, query: tuple, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The documents that match a query of _queries and their scores; with k, the
        k best, ties by key."""
        required, clauses = query
        docs, parts = [np.zeros(0, "int64")], [np.zeros(0)]
        has, bad = np.zeros(len(self.keys) if required else 0, "int64"), []
        for sign, fields in clauses:
            own = []
            for field, weight, words in fields:
                if len(words) > 1:
                    doc, score = self.phrase(field, words)
                elif span := self.at.get((field, words[0])):
                    doc, score = self.doc[slice(*span)], self.part[slice(*span)]
                else:
                    continue
                own.append(doc)
                if sign != "-":
                    docs.append(doc)
                    parts.append(weight * score)
            if sign == "+" and own:
                has[np.unique(np.concatenate(own))] += 1
            elif sign == "-":
                bad += own
        doc = np.concatenate(docs)
        fits = np.bincount(doc, minlength=len(self.keys)) > 0
        if required:
            fits &= has == required
        for x in bad:
            fits[x] = False
        found = np.flatnonzero(fits)
        score = rounded(np.bincount(doc, np.concatenate(parts), minlength=len(self.keys))[found])
        if k is not None and len(found) > k:
            found, score = (x[score >= np.partition(score, len(score) - k)[len(score) - k]] for x in (found, score))
            order = np.lexsort((found, -score))[:k]
            found, score = found[order], score[order]
        return found, score
