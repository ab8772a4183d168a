import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import negatives, whitening
from graphloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, component int, rank int, n map<string,int>"
ODD = [None, [], [0.0, float("nan")], [0.5, None], [float("inf"), 0.1]]


def plain_whiten(vectors, most=16):
    """vectors: {key: list}.  The contract by an eigensolver, signs left open."""
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in vectors}
    fit = [list(t) for t in sorted({tuple(v) for v in x.values()})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    order = [i for i in order if values[i] > 1e-9 * values.sum()]
    out = {}
    for key, v in x.items():
        apart = [n * a - s for a, s in zip(v, sums)]
        projected = np.array(apart, float) / n @ axes[:, order] / np.sqrt(values[order])
        out[key] = (sum(a * a for a in apart), projected, values[order] / values.sum())
    return n, out


def compare(result, vectors, most=16):
    n, expected = plain_whiten(vectors, most)
    got = defaultdict(dict)
    for r in result.collect():
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error <= 1e-9
    kept = {k: v for k, v in expected.items() if len(v[1])}
    assert set(got) == set(kept)
    signs = None
    for key, (deviation, projected, explained) in kept.items():
        rows = [got[key][c] for c in range(1, len(projected) + 1)]
        assert len(got[key]) == len(projected)
        assert {r.deviation for r in rows} == {deviation}
        np.testing.assert_allclose([r.explained for r in rows], explained, rtol=1e-9)
        mine = np.array([r.whitened for r in rows])
        if signs is None:
            signs = np.ones(len(mine))
        for i, (a, b) in enumerate(zip(mine, projected)):  # one sign for all rows
            if abs(b) > 1e-3:
                signs[i] = np.sign(a * b) if key == next(iter(kept)) else signs[i]
    all_mine = np.array([[got[k][c].whitened for c in range(1, len(kept[k][1]) + 1)] for k in kept])
    all_plain = np.array([kept[k][1] for k in kept])
    signs = np.sign((all_mine * all_plain).sum(axis=0))
    np.testing.assert_allclose(all_mine * signs, all_plain, atol=1e-7)


def random_vectors(rng, count, size, spread=1.0):
    return [(i, [float(np.float32(rng.gauss(j % 3, spread / (1 + j)))) for j in range(size)]) for i in range(count)]


def frame(spark, vectors):
    rows = [(k, v, 1, 7, 8, {"a": 1}) for k, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_whitening_with_odd_rows_and_copies(spark):
    rng = random.Random(1)
    vectors = random_vectors(rng, 120, 6)
    vectors += [(200 + i, vectors[5][1]) for i in range(40)]
    df = frame(spark, vectors + [(900 + i, v) for i, v in enumerate(ODD)])
    compare(whitening.whiten(df), vectors)
    compare(whitening.whiten(df, most=3, exact_to=1), vectors, 3)


def test_whitening_of_repeated_values_few_rows_and_another_length(spark):
    corners = [(i, [float(i >> b & 1) for b in range(3)]) for i in range(8)]  # three equal eigenvalues
    result = whitening.whiten(frame(spark, corners)).collect()
    assert len(result) == 24 and {round(r.explained, 12) for r in result} == {round(1 / 3, 12)}
    assert max(r.identity_error for r in result) < 1e-12
    rng = random.Random(2)
    few = random_vectors(rng, 3, 8)  # rank 2
    compare(whitening.whiten(frame(spark, few)), few)
    other = [(500 + k, v) for k, v in random_vectors(rng, 30, 4)]
    both = whitening.whiten(frame(spark, few + other)).cache()
    compare(both.where("vec_id < 500"), few)
    compare(both.where("vec_id >= 500"), other)


def test_whitening_without_components(spark):
    one = frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.where("false")).count() == 0
    huge = frame(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [-3e38, 2.0])])
    assert {r.deviation for r in whitening.whiten(huge).collect()} >= {None}


def test_whitening_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    result = QUERIES["op12_bidiagonal_whitening"](spark, "/root/testdata/sf0.001").cache()
    assert result.count() == 16 * len(vectors)
    compare(result, vectors)


def plain_negatives(rows, every, positives=5, negatives=10):
    rows = [(k, l, [math.floor(256 * float(c)) for c in v]) for k, l, v in rows]
    rows = [r for n, r in enumerate(rows) if r not in rows[:n]]
    out = []
    for anchor in rows:
        if anchor[0] % every:
            continue
        scored = [(sum(a * b for a, b in zip(anchor[2], r[2])), r) for r in rows if r is not anchor and len(r[2]) == len(anchor[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for score, positive in [s for s in scored if s[1][1] == anchor[1]][:positives]:
            hard = [s for s in scored if s[1][1] != anchor[1] and 30 * score <= 100 * s[0] <= 90 * score]
            out += [(anchor[0], positive[0], n + 1, s[1][0], score, s[0]) for n, s in enumerate(hard[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("size, scale", [(5, 1.0), (70, 1.0), (130, 40.0)])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, size, scale):
    monkeypatch.setattr(negatives, "SLICE_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 8)
    rng = random.Random(size)
    rows = [(i, rng.randrange(4), [float(np.float32(rng.gauss(0.2, scale))) for _ in range(size)]) for i in range(300)]
    rows += [(1000 + i, rng.randrange(3), rows[0][2]) for i in range(60)]  # ties
    rows += [rows[10], rows[10], (10, 1, rows[11][2])]  # repeated rows, an id twice
    rows += [(2000 + i, i % 2, [1.0] * (size - 1)) for i in range(20)]  # another length
    odd = [(3000 + 10 * i, v, 1, 0, 0, None) for i, v in enumerate(ODD)] + [(None, rows[0][2], 1, 0, 0, None), (10, rows[0][2], None, 0, 0, None)]
    df = spark.createDataFrame([(k, v, l, 0, 0, None) for k, l, v in rows] + odd, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0).collect())
    assert got == plain_negatives(rows, 10) and got
    assert negatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_residues_give_exact_scores():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(1 << 20), 1 << 20, (40, 200)), rng.integers(-(1 << 20), 1 << 20, (30, 200))
    primes = negatives.primes_for(200 << 40)
    got = negatives.Residues(y, primes).scores(negatives.Residues(x, primes), slice(0, 30))
    assert np.array_equal(got, y @ x.T)
    assert primes[0] == negatives.LARGEST_PRIME and negatives.INNER * (primes[0] // 2) ** 2 < 1 << 24
