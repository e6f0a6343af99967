"""Stored indexes, token corpora and versions against plain versions."""

import hashlib
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow import cli
from corpusflow.operators import lexicon, search, vectors
from corpusflow.sources import tokens, versions


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    common = [" ".join(f"w{int(x)}" for x in r.zipf(1.4, 40) % 300) for _ in range(600)]
    rows = [(i, f"Title {i % 7}", t + (" rare jewel here" if i in (3, 99) else " jewel rare" if i == 5 else "")) for i, t in enumerate(common)] + [(600, None, None), (601, "", ""), (602, "alpha beta", "alpha beta alpha beta, ALPHA-beta")]
    path = str(tmp_path_factory.mktemp("lexicon") / "i")
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string")
    monkey = pytest.MonkeyPatch()
    monkey.setattr(lexicon, "WINDOW", 40)
    monkey.setattr(lexicon, "BATCH", 50)
    lexicon.build(docs, "doc_id", {"title": F.col("title"), "content": F.col("content")}, path, {"title": 2.0})
    monkey.undo()
    return docs, path


def found(spark, path, texts, k=5):
    index = lexicon.Lexicon(spark, path)
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return index, asked, sorted((r.query_id, r["rank"], r.doc_id) for r in index.search(asked, k, "doc_id").collect())


def test_phrases_fields_and_signs(spark, words):
    texts = ['"rare jewel"', '"jewel rare"', "+jewel +rare", '+jewel -"rare jewel"', "title:alpha", "content:alpha", '"alpha beta alpha"', "alpha-beta", "-jewel", '" " + -', "+nowhere jewel", "nofield:here", ""]
    _, _, rows = found(spark, words[1], texts)
    of = lambda i: {d for q, _, d in rows if q == i}
    assert of(0) == {3, 99} and of(1) == {5} and of(2) == {3, 5, 99} and of(3) == {5} and of(4) == of(5) == of(6) == of(7) == {602}
    assert all(of(i) == set() for i in (8, 9, 10, 12)) and of(11) == set()


def test_bounds_give_the_top_of_a_full_scan(spark, words):
    docs, path = words
    texts = ["w1 w250 w17", "rare jewel w3", "w2", "title w1", '"w1 w1" w299 w200']
    index, asked, rows = found(spark, path, texts, 3)
    weighed = index.weighed(index.asked(asked))
    every = index.bounds(weighed)
    full = index.scores(weighed, every).collect()
    for q in range(len(texts)):
        best = sorted(((-r.score, r.key) for r in full if r.query_id == q))[:3]
        assert [d for i, _, d in rows if i == q] == [d for _, d in best]
    read = {r.query_id: (r.entries, r.read) for r in index.reading(asked, 3).collect()}
    assert all(b <= a for a, b in read.values()) and read[1][1] < read[1][0] / 2
    uppers = {(r.query_id, r.window): r.upper for r in every.collect()}
    windows = {r.key: r.window for r in index.postings().select("window", F.inline("entries")).select("key", "window").distinct().collect()}
    assert all(r.score <= uppers[r.query_id, windows[r.key]] + 1e-6 for r in full)


def test_a_term_is_in_one_bucket(spark, words):
    index = lexicon.Lexicon(spark, words[1])
    per = index.postings().groupBy("term").agg(F.count_distinct("bucket").alias("n"), F.max(F.size("entries")).alias("most")).agg(F.max("n"), F.max("most")).first()
    assert per[0] == 1 and per[1] <= 90
    with pytest.raises(FileExistsError):
        lexicon.build(words[0], "doc_id", {"title": F.col("title")}, words[1])
    with pytest.raises(ValueError):
        lexicon.build(words[0].limit(0), "doc_id", {"title": F.col("title")}, words[1] + "-none")


def test_exact_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 6 * 5)
    monkeypatch.setattr(vectors, "STRIPE", 3)
    monkeypatch.setattr(vectors, "ROWS", 50)
    r = np.random.default_rng(1)
    x = np.rint(4 * r.normal(size=(400, 6)))  # ties
    x[7] = 0
    rows = [(f"k{i:03d}", [float(c) for c in v]) for i, v in enumerate(x)] + [("null", None)]
    corpus = spark.createDataFrame(rows, "k string, embedding array<float>")
    asked = corpus.where("k < 'k023'").select(F.col("k").alias("query_id"), F.col("embedding").alias("query"))
    got = {(a.query_id, a["rank"]): (a.k, a.score) for a in vectors.exact_top(corpus, asked, "k", 4, decimals=6, itself=False).collect()}
    u = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    for i in range(23):
        s = np.round(u @ u[i], 6)
        best = sorted((-s[j], j) for j in range(400) if j != i)[:4]
        assert [got[f"k{i:03d}", n + 1] for n in range(4)] == [(f"k{j:03d}", pytest.approx(-v)) for v, j in best]
    assert vectors.exact_top(corpus.limit(0), asked, "k", 4).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quantised_index_recall(spark, tmp_path, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = search.dense_search(v, "vec_id")(q, 10)
    vectors.Quantised.build(v, "vec_id", str(tmp_path / "i"))
    index = vectors.Quantised(spark, str(tmp_path / "i"))  # from what was written
    result = index.search(q, 10)
    assert search.recall(result, exact, "vec_id").first().recall >= 0.9
    read = index.candidates(q, 50).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert read < 0.2 * v.count()
    both = result.join(exact.withColumnRenamed("score", "e"), ["query_id", "vec_id"]).select(F.max(F.abs(F.col("score") - F.col("e")))).first()[0]
    assert both <= 1e-6
    with pytest.raises(FileExistsError):
        vectors.Quantised.build(v, "vec_id", str(tmp_path / "i"))


def corpus_of(spark, lists):
    return spark.createDataFrame([(i, x, "s" if i % 2 else "t", "v") for i, x in enumerate(lists)], "n long, ids array<int>, source string, verification string")


def flat_of(spark, path):
    rows, manifest = tokens.read(spark, path, verify=True)
    return [t for r in sorted(tokens.ids_of(rows, manifest["dtype"]).collect()) for t in r.ids], manifest


def test_token_corpus(spark, tmp_path):
    r = np.random.default_rng(2)
    lists = [[int(t) for t in r.integers(0, 65_000, n)] for n in (5, 0, 70, 1, 33, 12)]
    flat = sum(lists, [])
    path = str(tmp_path / "c")
    manifest = tokens.write(corpus_of(spark, lists), path, 65_535, 100, block=16)
    got, known = flat_of(spark, path)
    assert got == flat[:100] and known == manifest and len(set(known) & {"format_version", "dtype", "vocab_size", "tokens", "bytes", "documents", "duplicates_removed", "contaminated_removed", "truncated_documents", "source_documents", "verification", "tokenizer_sha256", "sha256"}) == 13
    assert (known["dtype"], known["tokens"], known["bytes"], known["documents"], known["truncated_documents"], known["source_documents"]) == ("uint16", 100, 200, 5, 1, {"s": 2, "t": 3})
    raw = str(tmp_path / "raw.bin")
    assert tokens.export_raw(tokens.read(spark, path)[0], manifest, raw) == 200 and np.fromfile(raw, "<u2").tolist() == flat[:100]
    back = tokens.ids_of(tokens.read_raw(spark, raw, "uint16", 100), "uint16").orderBy("first").collect()
    assert sum((x.ids for x in back), []) == flat[:100]
    hashes = [hashlib.sha256(np.array(flat[i : min(100, i + 16)], "<u2").tobytes()).hexdigest() for i in range(0, 100, 16)]
    assert manifest["sha256"] == hashlib.sha256("".join(hashes).encode()).hexdigest()
    with pytest.raises(ValueError):
        tokens.read_raw(spark, raw, "uint16", 99)
    with pytest.raises(ValueError):
        tokens.write(corpus_of(spark, [[], []]), str(tmp_path / "none"), 10, 5)
    wide = tokens.write(corpus_of(spark, [[70_000, 2]]), path, 70_001, 100)
    assert wide["dtype"] == "uint32" and flat_of(spark, path)[0] == [70_000, 2]


@pytest.mark.parametrize("ratio", [0.0, 0.37, 1.0])
def test_mixture_of_tokens_resumes_anywhere(spark, tmp_path, ratio):
    own = {"reasoning": list(range(1000, 1023)), "general": list(range(2000, 2111))}
    held = {}
    for name, x in own.items():
        tokens.write(corpus_of(spark, [x[:9], x[9:]]), str(tmp_path / name), 65_535, 10**6, block=8)
        rows, m = tokens.read(spark, str(tmp_path / name))
        held[name] = (rows, m["tokens"])
    total, chunk = 301, 50
    quota, want = round(total * ratio), []
    at = lambda n: round(n * quota / total)
    for base in range(0, total, chunk):
        end = min(total, base + chunk)
        want += [own["reasoning"][i % 23] for i in range(at(base), at(end))] + [own["general"][i % 111] for i in range(base - at(base), end - at(end))]
    for a, b in ((0, None), (13, 274), (77, 78), (300, 999), (50, 50)):
        got = tokens.mixture(spark, held, total, ratio, "uint16", chunk, a, b, block=8).orderBy("start").collect()
        assert sum((r.ids for r in got), []) == want[a:b] and [r.start for r in got] == [s for s in range(0, total, chunk) if s + chunk > a and s < min(total, b or total)][:0] + [max(a, s) for s in range(0, total, chunk) if min(total, s + chunk) > a and s < min(total, b or total) and a < min(total, b or total)]
    with pytest.raises(ValueError, match="empty"):
        tokens.mixture(spark, {"reasoning": (held["reasoning"][0], 0), "general": (held["general"][0], 0)}, 10, 0.5, "uint16", 5)


def test_prepare_data_writes_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    (tmp_path / "m.json").write_text(json.dumps({"g": {"revision": "a" * 40, "license": "x", "role": "general"}}))
    texts = [f"Plain words of document {i} " + "that go on and on about one thing or another. " * 8 for i in range(6)]
    (tmp_path / "g.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in [*texts, texts[2].upper()]))
    out = cli.main(["prepare-data", "--manifest", str(tmp_path / "m.json"), "--output", str(tmp_path / "p"), "--general", str(tmp_path / "g.jsonl"), "--tokenizer", path, "--general-cap", "250"], spark)["general"]
    t = Tokenizer.from_file(path)
    ids = sum((t.encode(x.strip(), add_special_tokens=False).ids for x in texts), [])
    got, known = flat_of(spark, str(tmp_path / "p" / "general"))
    assert got == ids[:250] and out["tokens"] == 250 and out["truncated_documents"] == 1 and out["vocab_size"] == 50_257 and out["duplicates_removed"] == 1
    assert known["tokenizer_sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest() and known["filtering"]["rows_seen"] == 7


def test_readers_beside_a_writer_always_see_a_version(spark, tmp_path):
    path, seen, stop = str(tmp_path / "v"), [], threading.Event()
    assert versions.current(spark, path) is None
    versions.write_text(spark, path, "0")

    def read():
        while not stop.is_set():
            seen.append(int(versions.read_text(spark, path)))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 101):
        versions.write_text(spark, path, str(i))
    stop.set()
    reader.join()
    assert len(seen) > 20 and seen == sorted(seen) and versions.read_text(spark, path) == "100"
    assert len(list((tmp_path / "v").glob("data-*"))) == 3

    def fails(folder):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        versions.publish(spark, path, fails)
    (tmp_path / "v" / versions.POINTERS / "000000000999").write_text("data-half")  # a writer that died
    assert versions.read_text(spark, path) == "100"
    writers = [threading.Thread(target=versions.write_text, args=(spark, path, f"20{i}")) for i in range(6)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert versions.read_text(spark, path).startswith("20")


def test_staged_tables_go_with_their_scope(spark):
    from pathlib import Path

    from corpusflow.plans import stage

    held = lambda df: Path(df.inputFiles()[0].removeprefix("file:"))
    with stage.scope(spark):
        inner = held(stage.staged(spark.range(3), "x"))
        with stage.scope(spark):
            deepest = held(stage.staged(spark.range(3), "x"))
        assert inner.exists() and not deepest.exists()
    assert not inner.exists() and held(stage.staged(spark.range(3), "x")).exists()
