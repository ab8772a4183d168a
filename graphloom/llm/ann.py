"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, and sorted along a Hilbert curve, several times
with projections and shifts of their own.  Each order is range-partitioned over all tasks and cut
into blocks of neighbouring keys; a query is compared with the blocks around its own place on every
curve, and the best of all curves are merged.

Inner products are reduced to nearness by one more coordinate sqrt(M^2 - |x|^2) (M: the largest
norm; queries have 0 there), so that a curve brings large inner products together.  Vectors of
different lengths have no inner product: every length has curves of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import in_order, partitions, ranked, ship
from graphloom.storage import StageTables

DIMENSIONS = 6
BITS = 10
BLOCK_ROWS = 8192


def usable(vector: str) -> Column:
    """True for vectors that are not null, hold no null or non-finite component, and are not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & ~bad & some, F.lit(False))


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows) for each length of the lists of a column in each batch; the column has no nulls."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
        lengths = np.unique(sizes)
        for size in lengths.tolist():
            yield size, batch if len(lengths) == 1 else batch.take(pa.array(np.flatnonzero(sizes == size)))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by the transposed-index method of
    Skilling (2004), for dimensions * bits up to 62."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(vectors: np.ndarray, most: float, curve: int, seed: int) -> np.ndarray:
    """Keys on one curve.  most: the largest norm; projections of unit spread cover +-3 of it."""
    rng = np.random.default_rng([seed, curve])
    norms = np.einsum("ij,ij->i", vectors, vectors)
    lift = np.sqrt(np.maximum(most * most - norms, 0))
    plane = rng.normal(size=(vectors.shape[1] + 1, DIMENSIONS)) / math.sqrt(vectors.shape[1] + 1)
    flat = (vectors @ plane[:-1] + lift[:, None] * plane[-1]) / most * math.sqrt(vectors.shape[1] + 1)
    shift = rng.random(DIMENSIONS)
    cells = ((np.clip(flat, -3, 3) + 3) / 7 + shift / 7) * ((1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


def best_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, top: int):
    """The `top` ids of largest inner product with each query, never its own id.

    Rows that repeat an id are one candidate, with its best score.  Products of whole blocks pick the
    rows; their scores are then summed in one fixed order, so that equal vectors tie exactly and the
    smaller id comes first.  Yields (query row, ids, scores).
    """
    # Rows of one id side by side, so that a block gives one rough score per id.
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    single, group = ids[starts], np.repeat(np.arange(len(starts)), np.diff([*starts, len(ids)]))
    step = max(1, (8 << 20) // max(1, len(ids)))
    for at in range(0, len(queries), step):
        block = queries[at : at + step]
        rough = block @ vectors.T
        rough[own[at : at + step][:, None] == ids[None, :]] = -np.inf
        best = rough if len(starts) == len(ids) else np.maximum.reduceat(rough, starts, axis=1)
        if len(starts) > top:
            edge = np.partition(best, len(starts) - top, axis=1)[:, len(starts) - top]
        else:
            edge = np.full(len(block), -np.inf)
        slack = 1e-9 * (1 + np.abs(edge))
        for i in range(len(block)):
            rows = np.flatnonzero((rough[i] >= edge[i] - slack[i]) & (rough[i] > -np.inf))
            exact = (vectors[rows] * block[i]).sum(axis=1)
            found, place = np.unique(group[rows], return_inverse=True)
            score = np.full(len(found), -np.inf)
            np.maximum.at(score, place, exact)
            order = np.lexsort((single[found], -score))[:top]
            yield at + i, single[found][order], score[order]


def search(
    df: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    top: int = 20,
    curves: int = 4,
    window: float = 0.42,
    seed: int = 42,
) -> DataFrame:
    """The `top` rows of largest inner product found for each query row of df.

    Returns query_id, rank (from 1), vec_id, score (inner product in double precision); nearest
    first, ties to the smaller id; a row is never its own neighbour.  window: share of each curve
    that a query is compared with (blocks around its own place, rounded up to whole blocks).
    Vectors meet those of their own length only, so a query whose length is rare has fewer rows.
    Unusable vectors (see `usable`) and null ids take no part; rows that repeat an id are one
    candidate, with its best score.  The driver holds one norm for each length.
    """
    spark = df.sparkSession
    ship(spark)
    stage = StageTables(spark, "curves")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).withColumn("n", F.size("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, seen = stage.put(rows.withColumn("norm", norm), "rows", rows=F.count(F.lit(1)))
    fields = "query_id long, rank int, vec_id long, score double"
    if not seen["rows"]:
        return spark.createDataFrame([], fields)
    sizes = rows.groupBy("n").agg(F.max("norm").alias("most")).orderBy("n").collect()
    most = {r["n"]: (i * curves, math.sqrt(r["most"])) for i, r in enumerate(sizes)}  # first curve, largest norm

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in by_length(batches, "v"):
            vectors, (first, largest) = vectors_of(batch.column("v")), most[size]
            for curve in range(curves):
                made = curve_keys(vectors, largest, curve, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(made), first + curve, np.int32)), pa.array(made), *batch.columns],
                    names=["curve", "place", *batch.schema.names],
                )

    kind = df.schema[vector].dataType.simpleString()
    placed = rows.select("id", "v", "q").mapInArrow(keys, f"curve int, place long, id long, v {kind}, q boolean")
    ordered = in_order(placed, ["curve", "place", "id"], stage, "curves")
    # Blocks of at most BLOCK_ROWS rows; 24 on each curve if they then hold some times `top` rows.
    count, blocks = F.col("count"), F.col("blocks")
    most_blocks = F.greatest(F.least(F.lit(24), F.floor(count / (4 * top))), F.ceil(count / BLOCK_ROWS)).cast("long")
    block = (F.col("r") * blocks / count).cast("long")
    cut = ranked(ordered, ["curve"], "r", total="count").withColumn("blocks", most_blocks)
    cut = cut.withColumn("block", block).drop("r", "place", "count")
    cut, _ = stage.put(cut, "blocks")
    reach = F.greatest(F.lit(1), F.ceil((F.lit(window) * blocks - 1) / 2)).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.least(F.col("block") - reach, blocks - 1 - 2 * reach))
    last = F.least(blocks - 1, first + 2 * reach)
    sent = cut.where("q").select("curve", F.explode(F.sequence(first, last)).alias("block"), "id", "v", F.lit(True).alias("asks"))
    both = sent.unionByName(cut.select("curve", "block", "id", "v", F.lit(False).alias("asks")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come block by block, its vectors before the queries that visit it: only the vectors of
        # one block are held, however many queries there are.
        at, held, known = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, block, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "block", "asks"))
            ids = batch.column("id").to_numpy()
            edges = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
                if at != (curve[start], block[start]):
                    at, held, known = (curve[start], block[start]), [], None
                vectors = vectors_of(batch.column("v").slice(start, stop - start))
                if not asks[start]:
                    held.append((ids[start:stop].copy(), vectors.copy()))
                    continue
                if not held:
                    continue
                if known is None:
                    known = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                own, out = ids[start:stop], []
                for row, found, scores in best_of(vectors, known[0], known[1], own, top):
                    out.append((np.full(len(found), own[row]), found, scores))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"]
                )

    keyed = both.repartition(partitions(spark), "curve", "block").sortWithinPartitions("curve", "block", "asks", "id")
    met = keyed.mapInArrow(compare, "query_id long, vec_id long, score double")
    single = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # A query has at most top * blocks * curves rows here.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score"
    )
