"""Near copies among vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal axes is learned so that signs lose as little as possible (Gong and
Lazebnik, 2011); the signs of every vector are its code.  Several rotations give a code as long as
wanted.  The code is cut into tables of substrings; two vectors meet if in some table their
substrings differ in at most one bit: one side stores its substring, the other looks up its own and
every one-bit variant.  Pairs that meet and whose whole codes are near enough are compared by the
cosine of their original vectors.

Width and number of tables follow from the number of vectors: the width grows with its logarithm,
which keeps chance meetings in proportion to the vectors, and the number is what a pair at the
least similarity needs to be found with the wanted probability.

Vectors of different lengths have no cosine: every length has codes and tables of its own, and the
number of a table, which is part of the join key, says of which length it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.ann import by_length, usable, vectors_of
from graphloom.llm.common import components, in_order, ship
from graphloom.storage import StageTables

SAMPLE_ROWS = 4096
MISSED = 0.005


@dataclass
class Codes:
    """mean and one projection (dimensions x bits) per rotation; width and number of the tables."""

    mean: np.ndarray
    planes: list[np.ndarray]
    width: int
    tables: int
    most: int  # largest Hamming distance of whole codes that is reranked

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.mean
        signs = np.concatenate([unit @ p > 0 for p in self.planes], axis=1)
        return signs[:, : self.width * self.tables]


def rotation(data: np.ndarray, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """An orthogonal matrix that brings the rows of data near to sign vectors."""
    turn = np.linalg.qr(rng.normal(size=(data.shape[1], data.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(data @ turn).T @ data)
        turn = (u @ v).T
    return turn


def learn(sample: np.ndarray, rows: int, similarity: float, seed: int = 42) -> Codes:
    """Codes for `rows` vectors, fitted on a sample of them."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    # Signs are taken about the origin, where a bit differs with the angle's share of a half turn.
    mean = np.zeros(unit.shape[1])
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    data = unit @ axes
    # A bit of a random sign code differs with probability angle / pi.
    p = math.acos(similarity) / math.pi
    width = min(32, max(16, math.ceil(math.log2(max(2, rows)))))
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    tables = math.ceil(math.log(MISSED) / math.log(1 - meet))
    rng = np.random.default_rng(seed)
    planes = []
    while sum(x.shape[1] for x in planes) < width * tables:
        planes.append(axes @ rotation(data, rng))
    length = width * tables
    most = math.ceil(length * p + 5 * math.sqrt(length * p * (1 - p)))
    return Codes(mean, planes, width, tables, most)


def near_pairs(classes: DataFrame, stage: StageTables, similarity: float, seed: int) -> DataFrame:
    """(a, b, score), a < b: pairs of rows of classes (node, v, n rows) with cosine >= similarity.

    v: usable vectors; those of different lengths make no pair.  The driver learns one set of codes for
    each length from at most SAMPLE_ROWS vectors, one length after the other.
    """
    spark = classes.sparkSession
    ship(spark)
    classes = classes.withColumn("size", F.size("v"))
    # One row per length of vectors; a single vector of its length has no partner.
    sizes = classes.groupBy("size").count().where("count > 1").orderBy("size").collect()
    codes: dict[int, Codes] = {}
    for row in sizes:
        alike = classes.where(F.col("size") == row["size"]).select("v")
        picked = alike.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).collect()  # bounded
        codes[row["size"]] = learn(np.array([r["v"] for r in picked], np.float64), row["count"], similarity, seed)
    if not codes:
        return spark.createDataFrame([], "a long, b long, score double")
    words = max(-(-c.width * c.tables // 64) for c in codes.values())
    firsts = dict(zip(codes, np.cumsum([0, *[c.tables for c in codes.values()]]).tolist()))
    shared = spark.sparkContext.broadcast((codes, firsts))  # some matrices of dimensions x dimensions

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = shared.value
        for size, batch in by_length(batches, "v"):
            if size not in known:
                continue
            c, count = known[size], batch.num_rows
            signs = c.bits(vectors_of(batch.column("v")))
            weight = 1 << np.arange(c.width, dtype=np.int64)
            parts = signs.reshape(count, c.tables, c.width) @ weight
            padded = np.zeros((count, words * 64), np.uint8)
            padded[:, : signs.shape[1]] = signs
            code = np.packbits(padded, axis=1).view(np.int64).reshape(count, words)
            as_lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.int64()))
            same = [pa.array(np.full(count, x, np.int32)) for x in (first[size], c.width, c.most)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *same, as_lists(code), as_lists(parts)],
                names=["node", "first", "width", "most", "code", "parts"],
            )

    fields = "node long, first int, width int, most int, code array<long>, parts array<long>"
    coded, _ = stage.put(classes.select("node", "v").mapInArrow(encode, fields), "codes")
    flat = coded.select("node", "first", "width", "most", "code", F.posexplode("parts").alias("t", "part"))
    key = F.shiftleft((F.col("first") + F.col("t")).cast("long"), 40)
    stored = flat.select((key + F.col("part")).alias("key"), F.col("node").alias("a"), F.col("code").alias("code_a"))
    flips = [F.lit(1 << i).cast("long") for i in range(max(c.width for c in codes.values()))]
    variants = F.slice(F.array(F.lit(0).cast("long"), *flips), F.lit(1), F.col("width") + 1)
    asked = flat.select("node", "most", "code", key.alias("base"), "part", F.explode(variants).alias("flip")).select(
        (F.col("base") + F.col("part").bitwiseXOR(F.col("flip"))).alias("key"),
        F.col("node").alias("b"),
        F.col("code").alias("code_b"),
        "most",
    )
    apart = sum(
        (F.bit_count(F.col("code_a")[i].bitwiseXOR(F.col("code_b")[i])) for i in range(words)), F.lit(0)
    )
    met = asked.join(stored, "key").where((F.col("a") < F.col("b")) & (apart <= F.col("most"))).select("a", "b").distinct()
    met, _ = stage.put(met, "met")
    left = classes.select(F.col("node").alias("a"), F.col("v").alias("va"))
    right = classes.select(F.col("node").alias("b"), F.col("v").alias("vb"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in by_length(batches, "va"):
            a, b = vectors_of(batch.column("va")), vectors_of(batch.column("vb"))
            score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            near = np.flatnonzero(score >= similarity)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(near)), batch.column("b").take(pa.array(near)), pa.array(score[near])],
                names=["a", "b", "score"],
            )

    both = met.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    return both.mapInArrow(rerank, "a long, b long, score double")


def classes_of_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = 0.95, seed: int = 42
) -> DataFrame:
    """One row per row of df: key, n_links, component_id, kept.

    n_links: other rows whose cosine in double precision is at least `similarity`, as far as found;
    component_id: smallest key reachable over such links, itself included; kept: key equals
    component_id.  Equal vectors are compared once, as a class with its number of rows, so a vector
    that a third of the rows repeat makes no pairs.  Vectors link with those of their own length only.
    Vectors that are not usable (see ann.usable) or without a key link with nothing: 0 links, their
    own key, kept.  Rows that repeat a key are rows of their own.
    """
    spark = df.sparkSession
    stage = StageTables(spark, "vectors")
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    rows = rows.withColumn("good", F.col("id").isNotNull() & usable("v"))
    alike = rows.where("good").withColumn("h", F.xxhash64("v"))
    grouped = alike.groupBy("h", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = in_order(grouped, ["first", "h"], stage, "classes")
    classes = placed.withColumn("node", F.shiftleft(F.col("_gl_part").cast("long"), 33) + F.col("_gl_row"))
    pairs, _ = stage.put(near_pairs(classes, stage, similarity, seed), "pairs")
    sized = classes.select("node", "n")
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    linked = ends.join(sized.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.sum("n").alias("more"))
    # Nodes rise with the smallest id, so the root of a component holds it.
    roots = components(pairs.select("a", "b"), stage, "rounds")
    named = classes.select(F.col("node").alias("root"), F.col("first").alias("component_id"))
    found = (
        classes.select("node", "h", "v", "n", "first")
        .join(linked, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .join(named, "root")
        .select("h", "v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    )
    good = alike.join(found, ["h", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = good.unionByName(alone)
    return result.select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
