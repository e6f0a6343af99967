"""N-gram Jaccard join by T-occurrence search.

Two sets of s and t shingles with Jaccard similarity of at least 4/5 share at
least T = ceil(4s/5) of the s, so that a match occurs on at least T of the
inverted lists of a query's shingles. The lists are divided as in DivideSkip:

* By a fixed random order (the shingle's hash) each set keeps its first
  s - T + l shingles. Matching sets share l of these kept ones at least.
* Their lists are counted over all sets. Of a set's kept lists the longest
  l - 1 are long; a match occurs on one of the others, the short lists. Lists
  of one set are dropped. What is left of the short lists is merged, sorted by
  shingle, by the shuffle.
* Sets on short lists are the candidates. Over all shingles of candidates, in
  the order of their counts, a set's first s - T + 1 make its prefix; a pair
  with overlap I meets among the first s - I + 1 and t - I + 1 of its prefixes.
* A pair's difference has at least as many shingles as the parity sketches of
  its sets (a bit per hash class, flipped by each shingle) differ in bits; a
  pair beyond (s + t) / 9 can't be similar and isn't emitted.
* Candidates probe the whole sets, long lists included, by binary search until
  they reach T occurrences or can't any more.

Equal sets are one class from the start. Within a short list candidates are
paired with a few leaders per round, and only while the list spans several
components, so that a list of n near copies makes n pairs instead of n*n; every
pair that could still join two components is tested in some round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, lower_words, map_arrow, read_table, staged
from .components import components

WORDS = 5
#: Candidate ids sent to all tasks at most; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SALTS = 8
#: Longs of a parity sketch: 2048 bits.
SKETCH = 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "uint64")
_HASHES: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes (uint64) of the text's 5-word shingles; of
    its whole sequence with fewer words; none without words."""
    words = lower_words(text)
    n = len(words) - WORDS + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], "uint64")
    if len(_HASHES) > 100_000:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_HASHES.__getitem__, words), "uint64", len(words))
    with np.errstate(over="ignore"):
        out = h[:n] * _ODD[0]
        for j in range(1, WORDS):
            out += h[j : j + n] * _ODD[j]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def parity(x: np.ndarray) -> np.ndarray:
    """SKETCH longs whose bits tell whether the shingles of a class are odd in number."""
    bits = np.bincount((x >> np.uint64(64 - 11)).astype("int64"), minlength=64 * SKETCH).astype("uint8") & 1
    return np.packbits(bits).view("int64")


def may_be_similar(n, m, p, q):
    """Whether |difference| <= (n + m) / 9 is still possible by the sketches p, q."""
    differ = sum((F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(SKETCH)), F.lit(0))
    return 9 * differ <= n + m


def least_overlap(s: int) -> int:
    """T: the occurrences that any match of a set of s has at least."""
    return -(-4 * s // 5)


def kept_short(s: int) -> int:
    """l: how many of the kept shingles a match shares at least, if its set is
    no smaller than s."""
    return min(least_overlap(s), s // 8 + 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, by binary probes of the larger set in
    blocks; it stops once the outcome is certain."""
    if len(a) > len(b):
        a, b = b, a
    need = -(-4 * (len(a) + len(b)) // 9)  # i >= 4/5 (a + b - i)
    if len(a) < need:
        return False
    found, step = 0, 256
    for i in range(0, len(a), step):
        part = a[i : i + step]
        at = np.searchsorted(b, part)
        at[at == len(b)] = 0
        found += int((b[at] == part).sum())
        if found >= need or found + len(a) - i - len(part) < need:
            break
    return found >= need


def _prepared(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            n, sig, kept, skip, sketch = [], [], [], [], []
            for text in b.column(1).to_pylist():
                x = shingles(text)
                s = len(x)
                n.append(s)
                sig.append(xxhash.xxh3_128_digest(x.tobytes()) if s else None)
                kept.append(x[: s - least_overlap(s) + kept_short(s)].view("int64"))
                skip.append(kept_short(max(1, least_overlap(s))) - 1)
                sketch.append(parity(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(kept, pa.list_(pa.int64())), pa.array(skip, pa.int32()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "kept", "skip", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, sig binary, kept array<long>, skip int, sketch array<long>")


def _short_lists(classes: DataFrame) -> DataFrame:
    """list, node, n: the short inverted lists of several nodes."""
    postings = classes.select("node", "n", "skip", F.explode("kept").alias("list"))
    counted = postings.withColumn("length", F.count("*").over(Window.partitionBy("list"))).where("length > 1")
    by_node = counted.groupBy("node").agg(F.max("n").alias("n"), F.max("skip").alias("skip"), F.sort_array(F.collect_list(F.struct("length", "list"))).alias("x"))
    return by_node.select("node", "n", F.explode(F.slice("x", F.lit(1), F.greatest(F.size("x") - F.col("skip"), F.lit(0)))).alias("p")).select(F.col("p.list").alias("list"), "node", "n")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, x (the whole set as longs) of the given nodes, from their texts."""

    def run(batches):
        for b in batches:
            x = [shingles(t).view("int64") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, x)), pa.int64()), pa.array(x, pa.list_(pa.int64()))], names=["node", "n", "x"])

    few = nodes.count() <= BROADCAST_IDS
    found = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(nodes) if few else nodes, "node")
    return map_arrow(found, run, "node long, n long, x array<long>")


def _prefix_lists(sets: DataFrame) -> DataFrame:
    """list, node, n, at: the lists of prefix shingles, with their place in the
    node's order. Shingles of one candidate come first and have no list."""
    length = F.count("*").over(Window.partitionBy("list"))
    counted = sets.select("node", "n", F.explode("x").alias("list")).withColumn("length", length).where("length > 1")
    here = Window.partitionBy("node")
    at = F.col("n") - F.count("*").over(here) + F.row_number().over(here.orderBy("length", "list"))
    return counted.select("list", "node", "n", at.alias("at")).where("at <= n div 5 + 1")


def _numpy(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j].view("uint64") for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _tested(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def run(batches):
        for b in batches:
            keep = pa.array([similar(p, q) for p, q in zip(_numpy(b.column(2)), _numpy(b.column(3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("x").alias("p")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("x").alias("q")), "b").select("a", "b", "p", "q")
    return staged(map_arrow(both, run, "a long, b long"), "jaccard-links")


def jaccard_components(docs: DataFrame, first: int = 1, more: int = 16) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Null and empty texts have no shingles and are their own component. Rows
    with one doc_id are one node. A row without doc_id has n_shingles and a
    null component. first, more: leaders per list in the first round, and the
    factor by which their number grows.
    """
    base = staged(_prepared(docs), "jaccard-base")
    own = base.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    copies = own.groupBy("sig").agg(F.min("doc_id").alias("node"), F.count("*").alias("k"))
    # Classes of several rows only, dealt over salts: one of them may hold a third of all rows.
    several = copies.where("k > 1").select(F.col("sig").alias("g"), "node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long"))
    member = base.select("doc_id", "n", "sig").join(several, (F.col("sig") == F.col("g")) & (salt == F.col("salt")), "left").select("doc_id", "n", "sig", F.coalesce("node", "doc_id").alias("node"))
    member = staged(member, "jaccard-members")
    nodes = member.where("doc_id = node AND sig IS NOT NULL").select("node", F.col("sig").alias("g")).distinct()
    classes = base.join(nodes, (F.col("doc_id") == F.col("node")) & (F.col("sig") == F.col("g")))
    candidates = staged(_short_lists(classes.select("node", "n", "skip", "kept")).select("node").distinct(), "jaccard-candidates")
    sketches = staged(classes.select("node", "sketch").join(candidates, "node", "left_semi"), "jaccard-sketches")
    drop_staged(base)
    sets = staged(_sets(docs, candidates), "jaccard-sets")
    drop_staged(candidates)
    lists = _prefix_lists(sets)
    order = Window.partitionBy("list").orderBy("node")
    size = Window.partitionBy("list")
    # A short list's members by number; a list of one node (by a repeated id) is no list.
    lists = staged(lists.withColumns({"rank": F.row_number().over(order), "size": F.count("*").over(size), "c": F.col("node")}).where("size > 1"), "jaccard-ranked")

    overlap = F.expr("(4 * (n + m) + 8) div 9")
    meets = (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")) & (F.col("at") <= F.col("n") - overlap + 1) & (F.col("z") <= F.col("m") - overlap + 1)
    seen = F.lit(True)
    links, found, done, step = None, None, 0, first
    while True:
        leaders = lists.where((F.col("rank") > done) & (F.col("rank") <= done + step)).withColumnsRenamed({"list": "own", "node": "a", "n": "m", "c": "d", "rank": "r", "at": "z", "sketch": "q"}).drop("size")
        met = lists.join(leaders, (F.col("list") == F.col("own")) & (F.col("rank") > F.col("r")) & (F.col("c") != F.col("d")) & meets & seen)
        pairs = staged(met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "jaccard-pairs")
        fresh = _tested(sets, pairs)
        links = fresh if links is None else links.union(fresh)
        drop_staged(pairs)
        found = staged(components(links), "jaccard-components")
        done, step = done + step, step * more
        now = lists.drop("c").join(found.select("node", "component"), "node", "left").select("list", "node", "n", "at", "rank", "size", F.coalesce("component", "node").alias("c"))
        spread = now.where(F.col("size") > done).groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("list")
        # From the second round on a list has many leaders: the sketches go with its members.
        following = staged(now.join(spread, "list", "left_semi").join(sketches, "node"), "jaccard-ranked")
        seen = may_be_similar(F.col("n"), F.col("m"), F.col("sketch"), F.col("q"))
        drop_staged(lists)
        lists = following
        if not lists.head(1):
            break
    drop_staged(lists)
    drop_staged(sketches)
    drop_staged(sets)
    return member.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
