import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401

from graphloom.llm import mixing, sharding
from graphloom.storage import StageTables


def test_interleave(spark, odd_docs, odd_rows, no_docs):
    out = sharding.interleave(odd_docs, tie=("doc_id", "text"))
    assert set(out.columns) == set(odd_docs.columns)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in odd_rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    sizes = [len(shards[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    sources = Counter(r.source for r in rows)
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        for source, n in Counter(r.source for r in held).items():
            assert abs(n - sources[source] / 8) <= 2
    again = sharding.interleave(odd_docs.repartition(5), tie=("doc_id", "text")).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, rows))
    assert sharding.interleave(no_docs).collect() == []


def test_interleave_few_rows(spark):
    docs = spark.createDataFrame([(i, "s") for i in range(3)], "doc_id long, source string")
    assert sorted(r.slot for r in sharding.interleave(docs).collect()) == [0, 0, 0]


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not over:
            return {**fixed, **{s: share * weight[s] for s in open_}}
        fixed.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 50, "c": 10, None: 40},
        {"a": 1, "b": 1, "c": 1000},
        {"a": 0, "b": 5},
        {"a": 0},
        {"é": 7, "z": 900, "A": 3, "B": 0, "C": 11, "D": 13},
    ],
)
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = plain_targets(sizes)
    assert {r.source for r in rows} == set(sizes)
    assert all(r.target == pytest.approx(expected[r.source], abs=1e-9) for r in rows)


def counted(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(spark, odd_docs, odd_rows, no_docs):
    docs = odd_docs.select("doc_id", "source", "text", mixing.words(F.col("text")).alias("size"))
    rows = mixing.mix(docs, StageTables(spark, "t"), tie=("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.text, r.size) for r in rows) == Counter((r[0], r[1], counted(r[1])) for r in odd_rows)
    taken, sizes = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size
    targets = plain_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert taken[r.source] == int(r.target + 0.5)
    # At most one row of a source gives part of its words.
    parts = Counter(r.source for r in rows if r.size and r.taken % r.size)
    assert all(n == 1 for n in parts.values())
    again = mixing.mix(docs.repartition(5), StageTables(spark, "t"), tie=("doc_id", "text")).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, rows))
    assert mixing.mix(docs.where("false"), StageTables(spark, "t")).collect() == []


def test_mixed_documents(spark, odd_docs, odd_rows, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    texts = {(r[0], r[1]) for r in odd_rows}
    assert {(r.doc_id, r.text) for r in rows} <= texts
    taken, sizes, largest = Counter(), Counter(), Counter()
    for r in rows:
        taken[r.source] += counted(r.text)
    for r in odd_rows:
        sizes[r[3]] += counted(r[1])
        largest[r[3]] = max(largest[r[3]], counted(r[1]))
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    empty = Counter((r.doc_id, r.text) for r in rows if not counted(r.text))
    assert all(empty[(r[0], r[1])] for r in odd_rows if not counted(r[1]))
    assert mixing.mixed_documents(no_docs).collect() == []
