"""What a worker holds of a search by codes doesn't grow with the queries."""

import uuid

import numpy as np

from corpusflow.operators import vectors


def test_blocks_of_queries_give_the_same_rows(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(3).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    index = vectors.Quantised.build(rows, "vec_id", f"{tmp_path}/{uuid.uuid4().hex}")
    whole = sorted(map(tuple, index.candidates(queries, 20).collect()))
    monkeypatch.setattr(vectors, "HELD", 400)
    blocks, made = [], vectors.blocks_of

    def counted(*args):
        for ids, q in made(*args):
            blocks.append(len(ids))
            yield ids, q

    monkeypatch.setattr(vectors, "blocks_of", counted)
    assert sorted(map(tuple, index.candidates(queries, 20).collect())) == whole
    assert len(blocks) == 3 and sum(blocks) == 60  # dealt by hash, 20 a block on average
