import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, itq

FIELDS = "vec_id long, embedding array<float>, label int, rank int, score double, node long"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base[i % 20] + rng.normal(size=(1, 16)) * s for i, s in enumerate([0.02, 0.1, 0.25, 0.5] * 15)])
    same = np.repeat(base[:1], 25, axis=0)
    matrix = np.concatenate([base, near, same, 3 * base[5:8]]).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0, 1, 1.0, 1) for i, v in enumerate(matrix)]
    odd = [None, [0.0] * 16, [None] + [1.0] * 15, [math.nan] * 16, [math.inf] * 16, [1.0] * 3, []]
    rows += [(1000 + 20 * i, v, None, None, None, None) for i, v in enumerate(odd)]
    rows += [(None, [1.0] * 16, 0, 0, 0.0, 0)]
    return matrix.astype(np.float64), rows


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame(vectors[1], FIELDS).repartition(3).cache()


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**dims))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def exact_neighbours(matrix, query, top):
    scores = matrix @ matrix[query]
    order = [i for i in np.lexsort((np.arange(len(matrix)), -scores.round(9))) if i != query]
    return order[:top], scores


def test_search(table, vectors):
    matrix, _ = vectors
    found = ann.search(table, F.col("vec_id") % 20 == 0, window=1.0, curves=1).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(range(0, len(matrix), 20))
    for query, rows in by_query.items():
        rows.sort(key=lambda r: r["rank"])
        order, scores = exact_neighbours(matrix, query, 20)
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [r.vec_id for r in rows] == order
        assert all(r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in rows)


def test_search_window_recall(spark, table, vectors):
    matrix, _ = vectors
    found = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    hits = Counter(r.query_id for r in found if r.vec_id in exact_neighbours(matrix, r.query_id, 20)[0])
    assert sum(hits.values()) >= 0.9 * 20 * len(range(0, len(matrix), 20))


def test_search_small_and_empty(spark, table):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 5, 0.5)]
    assert ann.search(table.where("false"), F.lit(True)).collect() == []
    assert ann.search(table.where("embedding IS NULL"), F.lit(True)).collect() == []


def test_repeated_ids_are_one_candidate(spark):
    rng = np.random.default_rng(9)
    matrix = rng.normal(size=(60, 8))
    near = matrix[0] * 3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    rows += [(60, [float(x) for x in near])] * 100 + [(61, [float(x) for x in near * (1 - k / 500)]) for k in range(100)]
    found = ann.search(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") == 0, window=1.0, curves=1
    ).orderBy("rank").collect()
    scores = {i: float(v @ matrix[0]) for i, v in enumerate([*matrix, near, near]) if i}
    assert [r.vec_id for r in found] == sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:20]
    assert [r["rank"] for r in found] == list(range(1, 21))
    assert all(r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in found)


def test_near_copies(table, vectors):
    matrix, rows = vectors
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(len(matrix)))
    for i, j in zip(*np.nonzero(near)):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    found = {r.vec_id: r for r in itq.classes_of_vectors(table).collect()}
    assert len(found) == len(rows)
    got = np.array([found[i].n_links for i in range(len(matrix))])
    links = near.sum(axis=1)
    assert (got <= links).all() and got.sum() >= 0.97 * links.sum()
    assert np.mean([found[i].component_id == root[i] for i in range(len(matrix))]) >= 0.97
    for i, r in found.items():
        assert r.kept == (r.component_id == i)
        if i is None or i >= 1000:
            assert (r.n_links, r.component_id, r.kept) == (0, i, True)


def test_near_copies_of_nothing(table):
    assert itq.classes_of_vectors(table.where("false")).collect() == []
    alone = itq.classes_of_vectors(table.where("embedding IS NULL")).collect()
    assert [(r.n_links, r.kept) for r in alone] == [(0, True)]


def test_tables_follow_the_number_of_rows():
    sample = np.random.default_rng(0).normal(size=(200, 16))
    small, large = itq.learn(sample, 1000, 0.95), itq.learn(sample, 10**8, 0.95)
    assert small.width == 16 and large.width == 27 and large.tables > small.tables
    assert large.bits(sample).shape == (200, large.width * large.tables)
