"""Hard negatives by exact integer scores: a residue number system and float32 matrix products.

Components are integers.  For each of several small primes the matrices are reduced to residues
about zero, so small that a float32 product of them is exact; the residues of the products give the
signed scores by the Chinese remainder theorem, as the primes together exceed twice the largest
possible score.  Anchors and rows meet in blocks: a row slice is copied to every block of anchors,
so a cell of the grid is one task's work and bounded on both sides.  A cell returns the best few
rows for each of its anchors; a window over the cells' lists picks the final ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, ship
from graphloom.llm.whitening import finite, packed_integers, unpacked
from graphloom.storage import StageTables

# Dimensions of one float32 product: residues of primes up to LARGEST_PRIME are at most half of it, and
# INNER squares of that stay below 2^24, where float32 holds every integer.
INNER = 64
LARGEST_PRIME = 1021
SLICE_ROWS, BLOCK_ROWS = 4096, 1024


def primes_for(bound: int) -> list[int]:
    """Falling primes whose product exceeds twice the bound."""
    out, product, candidate = [], 1, LARGEST_PRIME
    while product <= 2 * bound + 1:
        if all(candidate % d for d in range(2, int(candidate**0.5) + 1)):
            out.append(candidate)
            product *= candidate
        candidate -= 1
        if candidate < 2:
            raise ValueError("scores are too large")
    return out


def _residues(x: np.ndarray, prime: int) -> np.ndarray:
    half = prime // 2
    return ((x + half) % prime - half).astype(np.float32)


class Residues:
    """Integer rows as residue matrices, one for each prime."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [_residues(x, p) for p in primes]

    def scores(self, other: Residues, rows: slice) -> np.ndarray:
        """Exact inner products of some rows with all rows of the other (64-bit integers)."""
        total, scale = None, 1
        for prime, mine, theirs in zip(self.primes, self.parts, other.parts):
            product = np.zeros((rows.stop - rows.start, len(theirs)), np.int64)
            for at in range(0, mine.shape[1], INNER):
                product += (mine[rows, at : at + INNER] @ theirs[:, at : at + INNER].T).astype(np.int64)
            if total is None:
                total, scale = product % prime, prime
                continue
            # The next digit in mixed radix: total + scale * digit has all residues so far.
            digit = (product - total) % prime * pow(scale, -1, prime) % prime
            total += scale * digit
            scale *= prime
        return np.where(total > scale // 2, total - scale, total)


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` allowed rows of highest score, ties by smaller id."""
    places = np.flatnonzero(allowed)
    if len(places) > most:
        held = scores[places]
        least = np.partition(held, len(held) - most)[len(held) - most]
        places = places[held >= least]
    order = np.lexsort((ids[places], -scores[places]))
    return places[order[:most]]


def _grid(
    rows: DataFrame, anchors: DataFrame, slices: int, blocks: int, primes: list[int], fields: str, pick
) -> DataFrame:
    """What `pick` returns for the anchors of every cell of (length, slice, block).

    pick(scores of one anchor, anchor row, ids, labels, vectors) -> list of result tuples.
    """
    cell = ["_gl_size", "_gl_slice", "_gl_block"]
    side = rows.withColumn("_gl_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.withColumn("_gl_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = pa.schema([(n, pa.int64()) for n in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            size = left.column("_gl_size")[0].as_py()
            x = unpacked(left.column("_gl_x").combine_chunks(), size)
            y = unpacked(right.column("_gl_x").combine_chunks(), size)
            ids, labels = left.column("_gl_id").to_numpy(), left.column("_gl_label").to_numpy()
            table, questions = Residues(x, primes), Residues(y, primes)
            given = right.drop_columns(["_gl_x"]).to_pylist()
            for start in range(0, len(given), 64):
                some = slice(start, min(start + 64, len(given)))
                for n, scores in enumerate(questions.scores(table, some), start):
                    out += pick(scores, given[n], y[n], ids, labels, x)
        columns = list(zip(*out)) if out else [[] for _ in names]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kinds)

    return side.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, fields)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component c counts as floor(scale * c), a score is the integer inner product with the anchor;
    higher scores come first, ties by smaller id.  An anchor's positives are its first other rows of
    the same label; the negatives of a pair are the first rows of another label with low percent of the
    positive score <= negative score <= high percent of it; a pair without any gives no row.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no
    part; other columns do not matter.  Rows equal in id, label and vector count once; rows that share an id
    but differ are rows of their own.  Vectors of different lengths do not meet; empty ones score 0.  Empty tables
    give an empty result.  Scores beyond a long raise a ValueError.
    """
    spark = vectors.sparkSession
    ship(spark)
    stage = StageTables(spark, "negatives")
    usable = vectors.where(finite(vector)).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    usable = usable.select(
        F.col(key).cast("long").alias("_gl_id"),
        F.col(label).cast("long").alias("_gl_label"),
        F.coalesce(is_anchor, F.lit(False)).alias("_gl_asks"),
        F.col(vector).alias("_gl_vector"),
    )
    distinct = packed_integers(usable, "_gl_vector", scale, 0).distinct()
    norm = _square_norm(distinct)
    rows, seen = stage.put(
        norm, "rows", rows=F.count(F.lit(1)), asks=F.count_if("_gl_asks"), norm=F.ceil(F.max("_gl_norm"))
    )
    slices = max(1, -(-seen["rows"] // SLICE_ROWS), min(partitions(spark), seen["rows"] // 256))
    blocks = max(1, -(-seen["asks"] // BLOCK_ROWS))
    bound = seen["norm"] + 1
    if bound >= 1 << 61:
        raise ValueError("scores do not fit a long")
    primes = primes_for(bound)

    rows = rows.drop("_gl_norm")
    spread = F.pmod(F.xxhash64("_gl_id", "_gl_label", "_gl_x"), F.lit(slices)).cast("int")
    asked = rows.where("_gl_asks").withColumn("_gl_no", F.monotonically_increasing_id())
    asked = asked.withColumn("_gl_block", F.pmod(F.xxhash64("_gl_no"), F.lit(blocks)).cast("int")).drop("_gl_asks")
    asked, _ = stage.put(asked, "anchors")
    side = rows.drop("_gl_asks").withColumn("_gl_slice", spread)

    def same_label(scores, anchor, own, ids, labels, x):
        allowed = labels == anchor["_gl_label"]
        for place in np.flatnonzero(allowed & (ids == anchor["_gl_id"])).tolist():
            if np.array_equal(x[place], own):
                allowed[place] = False
        picked = _best(scores, ids, allowed, positives)
        return [(anchor["_gl_no"], int(ids[p]), int(scores[p])) for p in picked.tolist()]

    found = _grid(side, asked, slices, blocks, primes, "no long, positive_id long, positive_score long", same_label)
    nearest = Window.partitionBy("no").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= positives)
    found, _ = stage.put(found, "positives")

    # At most `positives` scores for each anchor.
    wanted = found.groupBy(F.col("no").alias("_gl_no")).agg(F.collect_set("positive_score").alias("_gl_wanted"))
    asked_again, _ = stage.put(asked.join(wanted, "_gl_no"), "wanted")

    def other_label(scores, anchor, own, ids, labels, x):
        out, others = [], labels != anchor["_gl_label"]
        for wanted in anchor["_gl_wanted"]:
            # Bounds in whole numbers: 100 * score between low * wanted and high * wanted.
            least, largest = -(-low * wanted // 100), high * wanted // 100
            picked = _best(scores, ids, others & (scores >= least) & (scores <= largest), negatives)
            out += [(anchor["_gl_no"], wanted, int(ids[p]), int(scores[p])) for p in picked.tolist()]
        return out

    fields = "no long, positive_score long, negative_id long, negative_score long"
    hard = _grid(side, asked_again, slices, blocks, primes, fields, other_label)
    nearest = Window.partitionBy("no", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
    names = asked.select(F.col("_gl_no").alias("no"), F.col("_gl_id").alias("anchor_id"))
    return (
        found.drop("place")
        .join(hard, ["no", "positive_score"])
        .join(names, "no")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _square_norm(packed: DataFrame) -> DataFrame:
    """Adds `_gl_norm`, the squared length of each vector, a little above it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields) + ", _gl_norm double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([0, *batch.column("_gl_size").to_pylist()])
            flat = np.frombuffer(b"".join(batch.column("_gl_x").to_pylist()), "<i8").astype(np.float64)
            # Rounding is far within the part in 10^9 that is added.
            norms = [float(np.dot(flat[a:b], flat[a:b])) * (1 + 1e-9) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms)], names=[*batch.schema.names, "_gl_norm"])

    return packed.mapInArrow(run, fields)
