"""Toxicity: a counterfactually regularised linear classifier over words.

Features are the words of a text and their beginnings, present or not. Those
tied to toxic labels are chosen by a log-odds test over all sampled rows, and
the identity terms are features in any case. In each sampled text with identity
terms, these are swapped for others of their group; into each text without, two
terms of one group are inserted in turn. The fit adds a penalty on the squared
change of the score, so that which group is mentioned doesn't move it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_staged, map_arrow, read_table, schema_with, staged
from .labelled import FIT_ROWS, read_labels, sample

#: Features kept, the least z value and documents of one, and how its parts are weighed.
VOCABULARY, LEAST_Z, LEAST_ROWS, RIDGE, COUNTERFACTUAL = 4096, 3.0, 3, 0.02, 4.0
REJECT = 0.5
SHORTEST, LONGEST = 3, 8

#: Identity terms by group (own choice, a parameter of the operator), in the
#: corpus' languages; no term is in two groups.
IDENTITY_GROUPS = (
    ("he", "she", "they"),
    ("his", "her", "their"),
    ("il", "elle"),
    ("ils", "elles"),
    ("er", "sie"),
    ("sein", "ihr"),
    ("él", "ella"),
    ("ellos", "ellas"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "natives", "foreigners", "locals"),
    ("elderly", "young", "disabled", "deaf", "blind"),
)

_WORD = re.compile(r"\w+")


def swaps(groups=IDENTITY_GROUPS) -> dict[str, str]:
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Linear:
    bias: float
    weight: dict[str, float]

    def word(self, token: str) -> tuple[tuple[str, float], ...]:
        """The known features of what stands between white space."""
        return tuple((f, self.weight[f]) for w in _WORD.findall(token) for f in word_features(w) if f in self.weight)


def fit(rows: list[tuple[list[int], list[int], int]], size: int, ridge: float = RIDGE, penalty: float = COUNTERFACTUAL, steps: int = 400, inserted: list[tuple[int, int]] = ()) -> tuple[float, np.ndarray]:
    """Bias and weights from (features, features after the swap, label) by
    full-batch Adam on log loss + ridge + penalty x mean squared score change.
    inserted: the two features that an inserted term has before and after."""
    y = np.array([r[2] for r in rows], float)
    if not len(y):
        return -7.0, np.zeros(size)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.array([f for r in rows for f in r[0]], "int64")
    pairs = [(set(a) - set(b), set(b) - set(a)) for a, b, _ in rows if set(a) != set(b)]
    pairs += [({a}, {b}) for a, b in inserted if a != b]
    swap_row = np.array([i for i, (a, b) in enumerate(pairs) for _ in (*a, *b)], "int64")
    swap_col = np.array([f for a, b in pairs for f in (*a, *b)], "int64")
    swap_sign = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    mean = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(size + 1)
    w[-1] = np.log(mean / (1 - mean))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(row, w[col], len(y))
        e = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(col, e[row], size) / len(y), e.mean())
        g[:-1] += ridge * w[:-1] / len(y)
        if pairs:
            change = np.bincount(swap_row, swap_sign * w[swap_col], len(pairs))
            g[:-1] += 2 * penalty * np.bincount(swap_col, swap_sign * change[swap_row], size) / len(pairs)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return float(w[-1]), w[:-1]


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, groups=IDENTITY_GROUPS, penalty: float = COUNTERFACTUAL) -> Linear:
    """Fit on a bounded sample outside the held-out fold. The feature counts are
    taken in tasks; at most `rows` lists of chosen features reach the driver."""
    swap = swaps(groups)
    terms = sorted(swap)
    fitted = staged(sample(docs, labels, "toxic", 5, 0, rows), "toxicity-sample")

    def found(batches):
        for b in batches:
            f, y = [], []
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = features(words_of(text))
                f.extend(own)
                y.extend([label] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32())], names=["f", "y"])

    total = fitted.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    if not total.bad or total.bad == total.n:
        drop_staged(fitted)
        return Linear(7.0 if total.bad else -7.0, {})
    counts = map_arrow(fitted, found, "f string, y int").groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= LEAST_ROWS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    z = (F.log(a / (total.bad + 1.0)) - F.log(b / (total.n - total.bad + 1.0))) / F.sqrt(1 / a + 1 / b)
    chosen = [r.f for r in counts.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(VOCABULARY).collect()]
    chosen += [t for g in groups for t in g if t not in set(chosen)]
    index = {f: i for i, f in enumerate(chosen)}

    def known(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                own = sorted(index[f] for f in features(words) if f in index)
                other = {swap.get(w, w) for w in words}
                out[0].append(own)
                out[1].append(own if other == words else sorted(index[f] for f in features(other) if f in index))
                out[2].append(label)
                term = terms[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(terms)] if terms and other == words else None
                out[3].append([] if term is None else [index[term], index[swap[term]]])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.list_(pa.int32())) for c in out[:2]), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int32()))], names=["x", "swapped", "y", "inserted"])

    data = map_arrow(fitted, known, "x array<int>, swapped array<int>, y int, inserted array<int>").toArrow()
    drop_staged(fitted)
    rows_ = sorted(zip(data["x"].to_pylist(), data["swapped"].to_pylist(), data["y"].to_pylist(), strict=True))
    bias, weight = fit(rows_, len(chosen), penalty=penalty, inserted=sorted(tuple(x) for x in data["inserted"].to_pylist() if x))
    return Linear(bias, {f: float(w) for f, w in zip(chosen, weight, strict=True) if w})


def score(docs: DataFrame, model: Linear, name: str = "score") -> DataFrame:
    """docs with the score (double, 0 to 1) of each whole text; null is empty."""
    kept = docs.drop(name)
    names, at = kept.columns, kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY features at most

    def run(batches):
        model, seen = shared.value, {}
        for b in batches:
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column(at).to_pylist()):
                if len(seen) > 150_000:
                    seen.clear()
                own: dict[str, float] = {}
                for token in set(text.lower().split()) if text else ():
                    if (hit := seen.get(token)) is None:
                        hit = seen[token] = model.word(token)
                    if hit:
                        own.update(hit)
                out[i] = model.bias + sum(own[f] for f in sorted(own))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=[*names, name])

    return map_arrow(kept, run, schema_with(kept, name, "double"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null texts count as empty; texts without words get the score of the bias
    alone; a score of just REJECT is toxic; equal texts have equal scores, and
    repeated rows a row each. A null id is in the fold of the empty text.
    Without labels nothing is toxic; an empty table gives no rows."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, rows))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_labels(spark, sf_dir))
