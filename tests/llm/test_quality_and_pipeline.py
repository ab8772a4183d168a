import importlib
import os
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401

from graphloom.llm import quality

SF_DIR = "/root/testdata/sf0.001"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([3, 1, 5, 2])
    margin, change = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2))
    good, expected = quality.marginals(margin, change, counts)
    total, at = np.zeros((2, 2)), 0
    for n in counts:
        weights, ones, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(margin[at + i] * s for i, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
            weights += weight
            ones += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                moves[a, b] += weight
        assert np.allclose(good[at : at + n], ones / weights)
        total += moves / weights
        at += n
    assert np.allclose(expected, total)


def test_lines_are_counted_in_whole_texts():
    texts = [b"Ab c.\n\nDE!! 12 |\n", None, b"", b"\n", "é x x x".encode()]
    found = quality.describe(texts, None)
    assert found.counts.tolist() == [4, 1, 1, 2, 1]
    assert found.weight.tolist() == [6, 1, 10, 1, 1, 1, 1, 1, 9]
    words = np.expm1(found.features[:, 1]).round().tolist()
    assert words == [2, 0, 3, 0, 0, 0, 0, 0, 4]
    assert found.features[8, 12] == 0.5  # two words of four
    # A batch gives every text what it gets alone.
    for i, text in enumerate(texts):
        alone = quality.describe([text], None)
        start = int(found.counts[:i].sum())
        assert np.allclose(alone.features, found.features[start : start + found.counts[i]])


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("" if good else "$$") for _ in range(9)) + ("." if good else "")  # noqa: B023,E731
        rows.append((i, "\n".join(line() for _ in range(rng.randrange(1, 9))), 1.0))
        labels.append((i, int(good)))
    labels += [(i, 1 - y) for i, y in labels[:8]] + [(None, 0), (3, None)]  # unsure ones
    return spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3), spark.createDataFrame(
        labels, "doc_id long, quality int"
    )


def test_held_out_accuracy(made, odd_docs):
    docs, labels = made
    model = quality.fit(docs, labels)
    held = quality.score(docs, model).where(~quality.in_training(F.col("doc_id"))).collect()
    assert len(held) > 40
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 > 0) for r in held]) >= 0.97
    out = quality.score(odd_docs, model)
    assert out.count() == odd_docs.count() and set(out.columns) == set(odd_docs.columns) - {"text"} | {"text"}
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_without_a_choice_of_labels(made, no_docs):
    docs, labels = made
    assert quality.fit(docs, labels.where("false")).constant == 1.0
    assert quality.fit(docs, labels.where("quality = 0 AND doc_id > 20")).constant == 0.0
    assert quality.fit(no_docs, labels).constant == 1.0
    assert quality.score(no_docs, quality.Chain(constant=1.0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the supplied tables")
def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input, against plain Python."""
    from test_line_dedup import plain
    from test_simhash import near_copy_classes

    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing",
    ]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, inputs = docs.columns, []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        inputs.append(docs.orderBy("doc_id").collect())
        docs = stage(spark, docs, SF_DIR)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert docs.columns == columns
    start, scored, lined, single, mixed = inputs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in scored}
    known = [r.doc_id for r in start if r.doc_id in labels]
    assert np.mean([(i in kept) == (labels[i] == 1) for i in known]) >= 0.9
    expected = {r.doc_id: p for r, p in zip(scored, plain([r.text for r in scored], 30))}
    assert {r.doc_id: r.text for r in lined} == {i: t for i, (t, n, gone) in expected.items() if gone < n}
    roots = near_copy_classes([r.text for r in lined])
    assert [r.doc_id for r in single] == [r.doc_id for i, r in enumerate(lined) if roots[i] == i]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in packed) <= 2048
    pieces = docs.where("start = 0").count()
    assert pieces == len(mixed)
