"""The vector index against brute force."""

import numpy as np
import pytest

from lodeseek.operators import vector_index as index
from lodeseek.plans import fixtures

MIDDLE = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    """query id -> its k nearest others as (id, cosine); rows: id -> vector."""
    ids = sorted(rows)
    a = np.array([rows[i] for i in ids], float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = a @ a[ids.index(q)]
        out[q] = [(ids[j], s[j]) for j in np.lexsort((ids, -s.round(12))) if ids[j] != q][:k]
    return out


def test_registered_query_by_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()}
    truth = brute(rows, [i for i in rows if i % 50 == 0], 20)
    got = {}
    for r in fixtures.dense_index_topk(spark, MIDDLE).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(truth) and all(sorted(x) == list(range(1, 21)) for x in got.values())
    of = lambda q: {i for i, _ in got[q].values()}
    assert np.mean([len(of(q) & {i for i, _ in t}) / 20 for q, t in truth.items()]) >= 0.95
    for q, found in got.items():
        scores = [found[r][1] for r in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
        for i, s in found.values():
            x, y = np.array(rows[i], float), np.array(rows[q], float)
            assert s == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-12)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40, 90)]  # more than half are one vector
    bad = [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, [float("inf")] * 6), (106, [])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>").repartition(3)
    book = index.learned(df, "vec_id", "embedding", cells=4, parts=3)
    held = index.filed(df, "vec_id", "embedding", book).persist()
    assert {r.id for r in held.collect()} == set(range(90))
    counts = index.cell_counts(held, book)
    told = index.search(held, df, df, "vec_id", "embedding", book, counts, len(counts), 5, False).collect()
    truth = brute({i: np.float32(v) for i, v in good}, range(90), 5)
    assert sorted((r.query_id, r.rank, r.id) for r in told) == sorted((q, n, i) for q, t in truth.items() for n, (i, _) in enumerate(t, 1))
    assert 1 <= index.calibrated(df, "vec_id", "embedding", book, 5, 0.9) <= 4
    with_self = index.search(held, df, df.where("vec_id = 41"), "vec_id", "embedding", book, counts, 1, 3).collect()
    assert [(r.rank, r.id) for r in sorted(with_self, key=lambda r: r.rank)] == [(1, 40), (2, 41), (3, 42)]
    assert index.search(held, df, df.where("vec_id >= 100"), "vec_id", "embedding", book, counts, 1, 3).count() == 0
    assert index.learned(df.where("vec_id = 100"), "vec_id", "embedding") is None and index.learned(df.where("vec_id = 101"), "vec_id", "embedding") is None


def test_cells_are_read_until_they_hold_enough():
    counts, order = np.array([1, 50, 0, 400]), np.array([[0, 2, 1, 3], [3, 0, 1, 2]])
    assert index.probed(order, counts, 1, 5).tolist() == [3, 1] and index.probed(order, counts, 4, 5).tolist() == [4, 4] and index.probed(order, counts, 1, 100).tolist() == [4, 4]
