"""Matches are scored where their window's postings lie; k rows of it leave."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import lexicon


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(30))) for _ in range(300)] + ["", None, "a b c a b c"]
    docs = spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    path = str(tmp_path_factory.mktemp("scores") / "i")
    monkey = pytest.MonkeyPatch()
    monkey.setattr(lexicon, "WORDS", 500)
    monkey.setattr(lexicon, "BATCH", 7)
    lexicon.build(docs, "doc_id", {"text": F.col("text")}, path)
    monkey.undo()
    return [(t or "").split() for t in texts], lexicon.Lexicon(spark, path)


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def plain(texts, n_words, clauses):
    """key: score of one query; clauses are (sign, words)."""
    mean, n, out = n_words / len(texts), len(texts), {}
    idf = lambda w: np.log(1 + (n - (d := sum(w in t for t in texts)) + 0.5) / (d + 0.5))
    weights = [sum(map(idf, words)) for _, words in clauses]
    for i, t in enumerate(texts):
        score, found, fits = 0.0, False, True
        for (sign, words), weight in zip(clauses, weights, strict=True):
            tf = sum(t[j : j + len(words)] == words for j in range(len(t)))
            fits &= sign != "+" or tf > 0
            fits &= sign != "-" or tf == 0
            if sign != "-" and tf:
                found, score = True, score + weight * lexicon.part(tf, len(t), mean)
        if fits and found:
            out[f"k{i:03d}"] = score
    return out


def test_windows_follow_the_words_too(index):
    texts, made = index
    words = sum(map(len, texts))
    assert made.manifest["windows"] == -(-words // 500) > 1
    held = made.postings().select("term", F.inline("entries")).collect()
    assert {(r.term, r.key, tuple(r.positions)) for r in held} == {(w, f"k{i:03d}", tuple(j for j, x in enumerate(t) if x == w)) for i, t in enumerate(texts) for w in t}


def test_signs_and_phrases_against_a_plain_version(spark, index):
    texts, made = index
    queries = [[("", ["a"]), ("", ["b"])], [("+", ["a", "b"]), ("", ["c"])], [("", ["a", "a"]), ("-", ["g", "f"])], [("+", ["a", "b", "c"]), ("+", ["d"]), ("-", ["e"])], [("-", ["a"]), ("", ["b", "c", "b"])]]
    rows = asked(spark, [" ".join(f'{s}"{" ".join(w)}"' for s, w in q) for q in queries])
    got = {(r.query_id, r["rank"]): (r.key, r.score) for r in made.search(rows, 5).collect()}
    for i, q in enumerate(queries):
        best = sorted((-round(s, 6), d) for d, s in plain(texts, sum(map(len, texts)), q).items())[:5]
        assert [got.get((i, n + 1)) for n in range(len(best))] == [(d, pytest.approx(-s, abs=2e-6)) for s, d in best] and (i, len(best) + 1) not in got


def test_the_best_alone_leave_a_window(spark, index):
    _, made = index
    weighed = made.weighed(made.asked(asked(spark, ["a b c", '"a b" g', "+a -b"])))
    every = made.bounds(weighed)
    window = {r.key: r.window for r in made.postings().select("window", F.inline("entries")).select("key", "window").distinct().collect()}
    full, best = {}, {}
    for out, rows in ((full, made.scores(weighed, every)), (best, made.scores(weighed, every, 2))):
        for r in rows.collect():
            out.setdefault((r.query_id, window[r.key]), []).append((-r.score, r.key))
    assert best.keys() == full.keys() and all(sorted(best[x]) == sorted(full[x])[:2] for x in full)
    assert sum(map(len, full.values())) > 3 * sum(map(len, best.values()))


def test_common_numbers_and_their_places():
    r = random.Random(8)
    for n in range(60):
        lists = [np.array(sorted(r.sample(range(40), r.randrange(40))), "int64") for _ in range(1 + n % 4)]
        same, place = lexicon._common(lists)
        assert same.tolist() == sorted(set.intersection(*(set(x.tolist()) for x in lists)))
        assert all(x[at].tolist() == same.tolist() for x, at in zip(lists, place, strict=True))


def test_rounded_as_sql(spark):
    r = np.random.default_rng(2)
    x = np.r_[r.random(2000) * 100, (r.integers(0, 10**9, 2000) + 0.5) / 1e6, 0.0, 2.5e-6, 12.0000005]
    want = [float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in x]
    assert lexicon.rounded(x).tolist() == want
    assert [s.s for s in spark.createDataFrame([(float(v),) for v in x[-400:]], "x double").select(F.round("x", 6).alias("s")).collect()] == want[-400:]


def test_a_search_scans_the_blocks_three_times(spark, index, monkeypatch):
    """Once for the numbers of the asked words' blocks, twice for entries."""
    _, made = index
    scans, met = [], lexicon.Lexicon.met
    monkeypatch.setattr(lexicon.Lexicon, "met", lambda self, asked, *columns: scans.append(columns) or met(self, asked, *columns))
    assert made.search(asked(spark, ["a b", '"b c" +d']), 3).count() == 6
    assert scans == [("n", "bound"), ("entries",), ("entries",)]
