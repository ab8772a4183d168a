"""Vectors of several lengths, long training documents, and columns without a hash."""

import importlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401

from graphloom.llm import ann, itq, line_dedup, mixing, quality, simhash


@pytest.fixture(scope="module")
def two_lengths(spark):
    """Vectors of length 16 (most), 12 and 5, where those of another length are scaled first parts."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(70, 16))
    by_id = {i: v for i, v in enumerate(base)}
    by_id |= {100 + i: base[i, :12] for i in range(40)}
    by_id |= {140 + i: base[i, :12] + rng.normal(size=12) * 0.02 for i in range(20)}
    by_id |= {200 + i: base[0, :5] * (i + 1) for i in range(3)}
    by_id[240] = base[0, :7]
    rows = [(i, [float(x) for x in v]) for i, v in by_id.items()]
    return by_id, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).cache()


def test_search_within_each_length(two_lengths):
    by_id, table = two_lengths
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, window=1.0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    for query, v in by_id.items():
        if query % 20:
            continue
        scores = {i: float(v @ w) for i, w in by_id.items() if i != query and len(w) == len(v)}
        order = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:20]
        found = got.get(query, {})
        assert [found[k].vec_id for k in sorted(found)] == order
        assert all(r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in found.values())
    assert 240 not in got  # alone with its length
    assert {r.vec_id for r in got[200].values()} == {201, 202}


def test_near_copies_within_each_length(two_lengths):
    by_id, table = two_lengths
    found = {r.vec_id: r for r in itq.classes_of_vectors(table).collect()}
    assert found.keys() == by_id.keys()
    for i, v in by_id.items():
        links = [
            j for j, w in by_id.items()
            if i != j and len(v) == len(w) and v @ w >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)
        ]
        assert found[i].n_links == len(links)
        assert found[i].component_id == min([i, *links])


def test_one_class_in_long_documents_only(spark):
    rng = random.Random(7)
    line = lambda mark: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + mark for _ in range(6))
    rows = [(i, "\n".join(line("" if i % 2 else "$$") for _ in range(3 if i % 2 else 500))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    for lines in (quality.SAMPLE_LINES, 4000):
        scored = quality.score(docs, quality.fit(docs, labels, lines=lines)).collect()
        assert np.mean([(r.score >= 0.3) == (r.doc_id % 2 == 1) for r in scored]) >= 0.97


def test_a_label_that_the_sample_misses_raises(spark):
    rows = [(i, f"text {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.where(quality.in_training(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id != ids[-1].doc_id)) for r in ids], "doc_id long, quality int")
    with pytest.raises(ValueError, match="label 0"):
        quality.fit(docs, labels, rows=5)
    # A single document of a label is enough, and ids without a document do not use up the sample.
    model = quality.fit(docs, labels)
    assert model.constant is None
    many = labels.unionByName(spark.range(1000, 3000).selectExpr("id AS doc_id", "1 AS quality"))
    assert np.allclose(quality.fit(docs, many, rows=len(ids)).weights, model.weights)


def test_repeated_ids_train_alike(spark):
    rows = [(i, "a b c." if i % 2 else "$$ $$") for i in range(80)] + [(i, "$$ 11 $$\n22") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    models = [
        quality.fit(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels)
        for step, n in ((1, 2), (-1, 5))
    ]
    assert np.allclose(models[0].weights, models[1].weights) and models[0].bias == pytest.approx(models[1].bias)


def with_maps(docs):
    """Columns that Spark cannot hash or compare."""
    return docs.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn(
        "deep", F.array(F.struct(F.create_map(F.lit(1), F.lit(None).cast("string")).alias("x")))
    )


@pytest.mark.parametrize(
    "operator",
    [line_dedup.remove_repeated_lines, mixing.mixed_documents, simhash.keep_first, lambda d: simhash.keep_first(d, similarity=0.8)],
)
def test_columns_of_maps(odd_docs, no_docs, operator):
    mapped, plain = operator(with_maps(odd_docs)), operator(odd_docs)
    assert set(mapped.columns) - set(plain.columns) == {"m", "deep"}
    as_rows = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())
    if operator is mixing.mixed_documents:  # its order is a hash of whole rows, so other columns draw other rows
        assert set(as_rows(mapped)) <= set(as_rows(odd_docs)) and len(as_rows(mapped)) > 0
    else:
        assert as_rows(mapped) == as_rows(plain)
    assert all(r.m == {"k": r.doc_id} for r in mapped.collect())
    assert operator(with_maps(no_docs)).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, repeats, clashing and map columns go through all stages."""
    pipeline = importlib.import_module("corpus_pipeline")
    labels = [(i, int(i % 3 > 0)) for i in range(30)] + [(None, 1), (2, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("odd", with_maps(odd_docs)), ("none", with_maps(no_docs))):
        columns = docs.columns
        for i, (stage_name, stage) in enumerate(pipeline.STAGES):
            before = docs.count()
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{name}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{i}"))
            if stage_name != "packing":
                assert docs.columns == columns
            if stage_name in ("quality classifier", "line dedup", "SimHash near-dedup"):
                assert docs.count() <= before
        assert (docs.count() > 0) == (name == "odd")
