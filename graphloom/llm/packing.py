"""Packing of whole documents into sequences by minimum bin slack over lengths.

Pieces: a document is cut only where it is longer than a window, at multiples of the window.  The
plan works on the histogram of piece lengths (at most `window` rows whatever the corpus holds):
each step takes the longest length left and lets a bitset subset-sum find the multiset of the
remaining lengths that comes closest to filling the window; the backtracked counts are used for as
many sequences at once as the histogram allows.  A step exhausts a length down to less than one
use, so the number of steps has a bound that depends on the window alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ship, slices
from graphloom.llm.tokens import encoder
from graphloom.storage import StageTables

WINDOW = 2048

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("_gl_part", pa.int32()),
        ("_gl_row", pa.int64()),
    ]
)


def fill(target: int, counts: dict[int, int], order: list[int]) -> dict[int, int]:
    """The multiset of lengths, no more of each than counts allow, whose sum is nearest below target.

    Bit s of `reach` says that s is a sum of the lengths seen so far.  A length with c copies counts
    as items of 1, 2, 4, ... copies.  It ends early once the target itself is reached.
    """
    reach, mask, goal = 1, (1 << (target + 1)) - 1, 1 << target
    items: list[tuple[int, int, int]] = []
    for length in order:
        left = min(counts[length], target // length) if length <= target else 0
        copies = 1
        while left > 0 and not reach & goal:
            take = min(copies, left)
            items.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(items):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths in a sequence with their counts, number of such sequences), in order."""
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left, reverse=True)
    steps = []
    while order:
        longest = order[0]
        left[longest] -= 1
        used = fill(window - longest, left, order)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        steps.append((used, times))
        order = [k for k in order if left[k]]
    return steps


def places(steps: list[tuple[dict[int, int], int]], window: int) -> dict[str, np.ndarray]:
    """For each length, from which rank on its pieces go to which sequence: sorted by (length, rank)."""
    rows, given, sequence = [], {}, 0
    for used, times in steps:
        offset = 0
        for length in sorted(used, reverse=True):
            rank = given.get(length, 0)
            rows.append((length, rank, used[length], sequence, offset))
            given[length] = rank + used[length] * times
            offset += length * used[length]
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {n: table[:, i].copy() for i, n in enumerate(("length", "rank", "need", "sequence", "offset"))}


def cut_pieces(docs: DataFrame, window: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """One row per piece, numbered within (task, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist())):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, total, part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES
            )

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _gl_part int, _gl_row long"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, fields)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Packs all rows of docs (doc_id, text) into sequences of at most `window` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is the end id alone; repeated rows and null doc_ids are packed like any
    others; no rows give no rows.  Rows of one length are numbered over all tasks by one count per
    (task, length), so a length that a third of the pieces share is still placed in parallel.
    """
    spark = docs.sparkSession
    ship(spark)
    stage = StageTables(spark, "pack")
    pieces, _ = stage.put(cut_pieces(docs, window, end_id, tokenizer), "pieces")
    counts, _ = stage.put(pieces.groupBy("length", "_gl_part").agg(F.count(F.lit(1)).alias("_gl_n")), "counts")
    # At most `window` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_gl_n").alias("n")).collect()}
    table = places(plan(histogram, window), window)
    earlier = Window.partitionBy("length").orderBy("_gl_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("length").alias("_gl_l"),
        F.col("_gl_part").alias("_gl_p"),
        F.coalesce(F.sum("_gl_n").over(earlier), F.lit(0)).alias("_gl_base"),
    )
    numbered = (
        pieces.join(offsets, (F.col("length") == F.col("_gl_l")) & (F.col("_gl_part") == F.col("_gl_p")))
        .withColumn("_gl_rank", F.col("_gl_row") + F.col("_gl_base"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_gl_rank")
    )
    shared = spark.sparkContext.broadcast(table)  # bounded by the window, see above

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        # Ranks stay below the sum of all counts, so (length, rank) becomes one sortable number.
        width = int(max(histogram.values(), default=0)) + 1
        keys = t["length"] * width + t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_gl_rank"))
            row = np.searchsorted(keys, length * width + rank, side="right") - 1
            k, need = rank - t["rank"][row], t["need"][row]
            sequence, offset = t["sequence"][row] + k // need, t["offset"][row] + k % need * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return numbered.mapInArrow(place, fields)
