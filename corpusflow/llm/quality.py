"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete, of one depth, and kept as flat arrays (feature and
threshold per inner node, value per leaf), so that a batch of documents walks
all of them with a few numpy gathers per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, read_table, schema_with
from .labelled import FIT_ROWS, read_labels, sample

TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 80, 4, 0.15, 64, 1.0, 8
#: A document stays if its score reaches this.
ACCEPT = 0.7

SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER, _DIGIT, _BLANK, _LINE, _SYMBOL, _STOP, _OTHER_ASCII, _FOREIGN = range(9)


def _classes() -> np.ndarray:
    out = np.full(0x10000, _FOREIGN, "uint8")
    for c in range(0x80):
        s = chr(c)
        out[c] = _UPPER if s.isupper() else _LOWER if s.islower() else _DIGIT if s.isdigit() else _LINE if s == "\n" else _BLANK if s.isspace() else _SYMBOL if s in SYMBOLS else _STOP if s in ".!?" else _OTHER_ASCII
    return out


_CLASS = _classes()
FEATURES = ("log_chars", "log_words", "upper", "lower", "digit", "blank", "line", "symbol", "stop", "other", "foreign", "word_length", "distinct_words", "lone_words", "line_words", "distinct_lines", "entropy", "bang", "caps_words", "symbol_words", "longest_word", "bar_lines")


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text; all 0 without text."""
    out = np.zeros(len(FEATURES), "float32")
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    share = np.bincount(_CLASS[np.minimum(codes, 0xFFFF)], minlength=9) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), "uint8"), minlength=256)
    p = raw[raw > 0] / raw.sum()
    w = max(1, len(words))
    distinct = set(words)
    out[:2] = np.log1p((n, len(words)))
    out[2:11] = share
    out[11:] = (
        n / w,
        len(distinct) / w,
        sum(len(x) == 1 for x in distinct) / max(1, len(distinct)),
        w / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        -(p * np.log2(p)).sum(),
        raw[33] / n,
        sum(map(str.isupper, distinct)) / max(1, len(distinct)),
        sum(x[-1] in SYMBOLS for x in distinct) / max(1, len(distinct)),
        np.log1p(max(map(len, distinct), default=0)),
        raw[124] / max(1, len(lines)),
    )
    return out


@dataclass
class Trees:
    """feature, threshold: trees x (2**depth - 1); value: trees x 2**depth."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), "int64")
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def constant(score: float, depth: int = DEPTH) -> Trees:
    base = float(np.log(score / (1 - score)))
    return Trees(base, np.zeros((0, 2**depth - 1), "int64"), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosting with logistic loss over binned features, level by level."""
    if len(y) == 0:
        return constant(0.999, depth)  # nothing learned, nothing rejected
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = constant(float(mean), depth)
    if y.min() == y.max():
        return model
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], 1)
    inner = 2**depth - 1
    margin = np.full(n, model.base)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(inner, "int64"), np.full(inner, np.inf)
        node = np.zeros(n, "int64")
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first)[:, None] * bins + binned
            best = np.full(width, 1e-9)
            for j in range(k):
                gs = np.bincount(at[:, j], g, width * bins).reshape(width, bins)
                hs = np.bincount(at[:, j], h, width * bins).reshape(width, bins)
                cs = np.bincount(at[:, j], minlength=width * bins).reshape(width, bins)
                gl, hl, cl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1], cs.cumsum(1)[:, :-1]
                ga, ha, ca = gs.sum(1)[:, None], hs.sum(1)[:, None], cs.sum(1)[:, None]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(cl < LEAST) | (ca - cl < LEAST)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[i], f[first + i], t[first + i] = gain[i, top[i]], j, cuts[j][top[i]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        fs.append(f)
        ts.append(t)
        vs.append(value)
    return Trees(model.base, np.array(fs), np.array(ts), np.array(vs))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Fit on a bounded sample outside the held-out fold, on the driver: `rows`
    feature vectors at most."""

    def features(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32())), b.column(2)], names=["doc_id", "x", "y"])

    found = map_arrow(sample(docs, labels, "quality", 4, 2, rows), features, "doc_id long, x array<float>, y int").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x.astype("float64"), found["y"].to_numpy().astype("float64"))


def score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """docs with the model's score (double, 0 to 1) of each whole text."""
    kept = docs.drop(name)
    names, at = kept.columns, kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees x nodes, a fixed size

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], "float64").reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x))], names=[*names, name])

    return map_arrow(kept, run, schema_with(kept, name, "double"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts are scored like any text, from statistics that are 0.
    A score of just ACCEPT is accepted; equal texts have equal scores, and
    repeated rows a row each. A null id is in the fold of the empty text.
    Without labels every score is 0.999: nothing is rejected unlearned. An
    empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, rows))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_labels(spark, sf_dir))
