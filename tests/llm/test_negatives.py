"""Hard negatives against all scores, in plain Python."""

import math
import random

import numpy as np
import pytest

from corpusflow.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, u string, score long"


def plain(rows, positives=5, negatives_=10, low=30, high=90):
    known = set()
    for vec_id, x, label, *_ in rows:
        if None not in (vec_id, x, label) and all(c is not None and math.isfinite(c) for c in x):
            known.add((vec_id, label, tuple(math.floor(256 * float(np.float32(c))) for c in x)))
    anchors = {}
    for r in sorted(known, reverse=True):
        if r[0] % 100 == 0:
            anchors[r[0]] = r
    out = []
    for a in anchors.values():
        scored = sorted(((-sum(p * q for p, q in zip(a[2], r[2])), r[0], r[1]) for r in known if r[0] != a[0]))
        same = [(-s, i) for s, i, label in scored if label == a[1]][:positives]
        for p, i in same:
            fits = [(-s, j) for s, j, label in scored if label != a[1] and low * p <= 100 * -s <= high * p]
            out += [(a[0], i, k + 1, j, p, s) for k, (s, j) in enumerate(fits[:negatives_])]
    return sorted(out)


def mined(spark, rows, **options):
    whole = negatives.whole_vectors(spark.createDataFrame(rows, ROWS))
    return sorted(tuple(r) for r in negatives.hard_negatives(whole, whole.where("vec_id % 100 = 0"), **options).collect())


def some_rows(seed, n, size=8, clusters=6):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(clusters, size))
    near = [int(r.integers(clusters)) for _ in range(n)]
    return [(i, [float(x) for x in middle[k] + 0.3 * r.normal(size=size)], int(r.integers(3)) if seed % 2 else k % 3, "u", 0) for i, k in enumerate(near)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "CELL_BYTES", 1024)
    rows = some_rows(seed, 900)
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows) == want == mined(spark, rows, block=3)


def test_odd_rows(spark):
    rows = some_rows(3, 250)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 8, 1, "u", 0), (300, None, 1, "u", 0), (301, [1.0] * 8, None, "u", 0), (302, [1.0, None, 2.0], 1, "u", 0), (400, [nan] * 8, 1, "u", 0), (401, [inf] * 8, 1, "u", 0)]
    rows += [rows[7], rows[7], rows[100], (500, [0.5] * 3, 1, "u", 0), (500, [0.5] * 3, 0, "u", 0), (600, [], 2, None, None), (-100, [0.0] * 8, 2, "u", 0)]
    rows += [(700 + i, [1.0, 0.5] * 4, i % 3, "copies", 0) for i in range(150)]  # ties
    assert mined(spark, rows, negatives=4) == plain(rows, negatives_=4)


def test_large_components(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-3e5, 3e5) for _ in range(4)], i % 2, "u", 0) for i in range(120)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, [*rows, (1000, [1e30] * 4, 0, "u", 0)]) == plain(rows)  # past 62 bits: left out


def test_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1, "u", 0)]) == []


def test_bounds_leave_cells_out(spark, monkeypatch):
    """Far clusters are passed over: fewer scores are made than there are pairs."""
    made = []
    own = negatives.hits
    monkeypatch.setattr(negatives, "hits", lambda best, asked, x, *a: made.append(len(asked) * len(x)) or own(best, asked, x, *a))
    r = np.random.default_rng(5)
    centres = 40 * r.normal(size=(20, 8))
    x = np.rint(centres[np.arange(2000) % 20] + r.normal(size=(2000, 8))).astype("int64")
    lists = np.arange(20)
    import pyarrow as pa

    cells = [x[lists[c] :: 20].astype("<i4") for c in lists]
    ids = [np.arange(2000, dtype="<i8")[c::20] for c in lists]
    far = [float(np.sqrt(((v - centres[c]) ** 2).sum(axis=1).max())) for c, v in enumerate(cells)]
    kinds = [np.zeros(100, "<i8").tobytes()] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(far), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(kinds, pa.binary()), pa.array([v.tobytes() for v in cells], pa.binary())], names=list("abcde"))
    n = 40
    best = negatives.Best(negatives.Requests(x[:n], np.arange(n), np.zeros(n, "int64"), np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), True, 5))
    negatives.visit(best, batch, centres, 8, "float64")
    scores = x[:n] @ x.T
    scores[np.arange(n), np.arange(n)] = -(2**60)
    want = [(i, j) for i in range(n) for j in np.lexsort((np.arange(2000), -scores[i]))[:5]]
    assert list(zip(best.request.tolist(), best.ids.tolist())) == want and sum(made) < n * 2000 / 2
