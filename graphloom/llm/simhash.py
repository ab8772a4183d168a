"""SimHash fingerprints and their near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `radius` (even) bits share a variant: a value within half
the radius of both.  Every fingerprint stands for all its variants (2081 for radius 4); rows that
share one are linked.  To keep the shuffle small the variants are made behind it: the space of
64-bit values is cut into 2^k slices by k parity bits (bit g is the parity of the bits at g, g+k,
g+2k, ...).  Flipping one bit flips one parity, so all variants of a fingerprint fall into the few
slices whose number differs from its own in at most half the radius of bits (37 of 256 for k = 8);
the fingerprint goes there, and each slice makes exactly its own variants.  Every variant is made
once, in the slice that all holders of it reach.  k grows with the number of fingerprints, so that
a slice stays small; parities depend on all bits, so groups of near copies spread over slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ROW, components, ship, slices, with_copy, with_row_name
from graphloom.storage import StageTables

VARIANTS_PER_SLICE = 1 << 22
VARIANTS_AT_ONCE = 1 << 23
# The wider search of `keep_first`: words of a shingle, bands, and orders of shingles in a band.
WIDE_WIDTH = 5
BANDS = 20
BAND_ROWS = 5
# Rounds in which the rows of a band are compared with its representatives alone.
WHOLE_ROUNDS = 2


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of a text, A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends)])
    count = len(starts)
    totals = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):  # bounded memory for texts of any length
        part = np.frombuffer(hashes, np.uint8)[8 * at : 8 * min(count, at + (1 << 16))]
        totals += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    # Digests are big-endian, so the first bit is the highest.
    return int.from_bytes(np.packbits(totals * 2 > count).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """The columns of df but the text, and `fp`, the fingerprint of the whole text as a signed long."""
    ship(df.sparkSession)
    keys = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_gl_text"):
            found = [fingerprint(t, width) for t in batch.column("_gl_text").to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(signed)], names=[*keys, "fp"])

    source = df.select(*keys, F.col(text).cast("binary").alias("_gl_text"))
    schema = df.select(*keys, F.lit(0).cast("long").alias("fp")).schema
    return source.mapInArrow(run, schema)


def slice_number(fp: np.ndarray, bits: int) -> np.ndarray:
    found = np.zeros(len(fp), np.int64)
    for g in range(bits):
        mask = sum(1 << i for i in range(g, 64, bits))
        found |= (np.bitwise_count(fp & np.uint64(mask)).astype(np.int64) & 1) << g
    return found


@lru_cache(maxsize=4)
def flips(bits: int, half: int) -> dict[int, np.ndarray]:
    """All ways to flip at most `half` of 64 bits, by the change of the slice number."""
    ways: dict[int, list[int]] = {}
    for weight in range(half + 1):
        for places in combinations(range(64), weight):
            change = mask = 0
            for i in places:
                change ^= 1 << i % bits
                mask |= 1 << i
            ways.setdefault(change, []).append(mask)
    return {k: np.array(v, np.uint64) for k, v in ways.items()}


def slice_links(fp: np.ndarray, number: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints that share a variant in one slice, as a spanning forest."""
    ways = flips(bits, radius // 2)
    change = slice_number(fp, bits) ^ number
    groups = [(np.flatnonzero(change == c), ways[int(c)]) for c in np.unique(change) if int(c) in ways]
    total = sum(len(rows) * len(masks) for rows, masks in groups)
    passes = -(-total // VARIANTS_AT_ONCE)
    label = np.arange(len(fp))
    for turn in range(passes):  # a crowded slice takes its variants in turns, by their hash
        values, owners = [], []
        for rows, masks in groups:
            step = max(1, VARIANTS_AT_ONCE // len(masks))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                made = (fp[some][:, None] ^ masks[None, :]).ravel()
                owner = np.repeat(some, len(masks))
                if passes > 1:
                    mine = (made * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(passes) == turn
                    made, owner = made[mine], owner[mine]
                values.append(made)
                owners.append(owner)
        values, owners = np.concatenate(values), np.concatenate(owners)
        ordered = np.sort(values)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        # A table of low bits leaves few values to look up.
        seen = np.zeros(1 << 20, bool)
        fold = lambda v: ((v ^ v >> np.uint64(23)) & np.uint64((1 << 20) - 1)).astype(np.int64)
        seen[fold(shared)] = True
        likely = np.flatnonzero(seen[fold(values)])
        values, owners = values[likely], owners[likely]
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        at, owners = at[hit], owners[hit]
        # All holders of a variant are within the radius of each other: link each to the first.
        first = np.full(len(shared), len(fp), np.int64)
        np.minimum.at(first, at, owners)
        pairs = np.unique(np.stack([first[at], owners], axis=1), axis=0)
        near = np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]) <= radius
        join_labels(label, pairs[near])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def join_labels(label: np.ndarray, pairs: np.ndarray) -> None:
    """Merges labels along pairs in place; a label ends as the smallest index of its class."""
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        la, lb = la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def links(distinct: DataFrame, count: int, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect all fingerprints linked by chains of pairs within the radius.

    distinct: column fp without repeats; count: its number of rows, which sets the slices.
    """
    if radius % 2 or radius < 2:
        raise ValueError("radius must be even and at least 2")
    ship(distinct.sparkSession)
    half = radius // 2
    variants = sum(math.comb(64, w) for w in range(half + 1))
    bits = min(24, max(8, math.ceil(math.log2(max(1, count * variants / VARIANTS_PER_SLICE)))))
    number = F.lit(0).cast("long")
    for g in range(bits):
        mask = sum(1 << i for i in range(g, 64, bits))
        mask -= (mask >> 63) << 64
        parity = F.bit_count(F.col("fp").bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)).cast("long")
        number = number.bitwiseOR(F.shiftleft(parity, g))
    near = [sum(1 << g for g in gs) for w in range(half + 1) for gs in combinations(range(bits), w)]
    sent = distinct.select("fp", number.alias("own")).select(
        "fp", F.explode(F.array(*[F.lit(d).cast("long") for d in near])).alias("change"), "own"
    )
    sent = sent.select("fp", F.col("own").bitwiseXOR(F.col("change")).alias("slice"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        a, b = slice_links(fp, key[0].as_py(), bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("slice").applyInArrow(run, "a long, b long")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The columns of df but the text, `fp`, `component_id` and `class_fp` (a fingerprint of the class).

    component_id is the smallest key reachable over fingerprints that differ in at most radius bits.
    Equal fingerprints are one node, so copies add no links.  Null and empty texts have fingerprint
    0 and link to each other and to what is near 0.  Null keys get the class of their fingerprint
    and never name it (null where a class holds no key).
    """
    stage = StageTables(df.sparkSession, "simhash")
    marked, _ = stage.put(fingerprints(df, text, width), "marked")
    distinct, seen = stage.put(
        marked.groupBy("fp").agg(F.min(key).alias("first")), "distinct", rows=F.count(F.lit(1))
    )
    edges, _ = stage.put(links(distinct.select("fp"), seen["rows"], radius), "edges")
    found, _ = stage.put(components(edges, stage, "rounds"), "roots")
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(named, "root").select("fp", "component_id", F.col("root").alias("class_fp"))
    return marked.join(ids, "fp")


def shingles(text: bytes | None, width: int = WIDE_WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles of a text, A-Z lower-cased; empty without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - width + 1)
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), 42) for i in range(count)], np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band: a hash of its number and its least shingles in BAND_ROWS orders."""
    odd = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.int64).view(np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 12):  # bounded memory for texts of any length
        part = (found[at : at + (1 << 12), None] ^ odd[0]) * (odd[1] | np.uint64(1))
        np.minimum(least, (part ^ part >> np.uint64(32)).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def rare_pairs(rows: DataFrame, sets: DataFrame, similarity: float, stage: StageTables) -> DataFrame:
    """Pairs (row, rep) of different roots that may reach the similarity: all that do, and few others.

    rows: row, root and n, the size of its set in sets.  Sets of n and m shingles with a similarity t or more
    share t / (1 + t) (n + m) of them or more, so in any one order of all shingles their first common one is
    among the first n - t n + 1 of either.  Here shingles come first that few rows hold: what many rows
    share, a passage say, is seldom among these.  Rows meet by these first shingles, each at its place in
    either set: behind the first common one enough must be left.  Rows outside the largest root of a shingle
    meet all its rows, so large groups that are one class by now meet no more.
    """
    held = rows.join(sets, "row").select("row", "root", "n", F.explode("set").alias("shingle"))
    held, _ = stage.put(held, "held")
    holders = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    # Shingles of one row alone come before all these.
    own = Window.partitionBy("row")
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    place = alone + F.row_number().over(own.orderBy("holders", "shingle"))
    ranked = held.join(holders, "shingle").withColumn("place", place.cast("int"))
    first = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1).drop("holders")
    first, _ = stage.put(first, "first")
    company = first.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("company"))
    spans = company.groupBy("shingle").agg(F.max(F.struct("company", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    parts, _ = stage.put(first.join(spans.where("roots > 1").select("shingle", F.col("top.root").alias("top")), "shingle"), "parts")
    others = parts.select("shingle", "top", *(F.col(c).alias(f"rep_{c}") for c in ("row", "root", "n", "place")))
    met = parts.where("root != top").drop("top").join(others, "shingle").where("root != rep_root")
    met = met.where((F.col("rep_root") == F.col("top")) | (F.col("root") < F.col("rep_root")))
    left = F.least(F.col("n") - F.col("place"), F.col("rep_n") - F.col("rep_place")) + 1
    met = met.where(F.least("n", "rep_n") >= F.greatest("n", "rep_n") * similarity - 1e-6)
    met = met.where(left >= (F.col("n") + F.col("rep_n")) * (similarity / (1 + similarity)) - 1e-6)
    return met.select("row", F.col("rep_row").alias("rep")).distinct()


def similar_classes(marked: DataFrame, named: DataFrame, text: str, similarity: float, stage: StageTables) -> DataFrame:
    """Edges (a, b) between classes that hold texts of a Jaccard similarity of `similarity` or more.

    marked: ROW and class_fp of every row of named.  Texts whose least shingles agree in a whole band
    are candidates (at 0.8 all but 4 in 10,000 pairs are).  First a band that spans classes elects one representative by a
    hash of band and row, so bands elect different ones, and its rows are compared with it alone,
    shingle by shingle.  Rows that are similar to it, or share its class, leave the band; the rest elect two
    in the second stored round.  So groups of similar rows become one class with few comparisons.  Then all rows of
    bands that still span joined classes, those that have left too, meet by their rare shingles (see rare_pairs):
    each similar pair of different classes is compared there.  Nothing is capped.
    """
    ship(named.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_gl_text"):
            sets = [shingles(t) for t in batch.column("_gl_text").to_pylist()]
            keys = [band_keys(x) if len(x) else np.zeros(0, np.int64) for x in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], pa.uint64()).view(pa.int64()),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                ],
                names=[*ROW, "same", "n", "keys"],
            )

    source = named.select(*ROW, F.col(text).cast("binary").alias("_gl_text"))
    made = source.mapInArrow(describe, "_gl_d long, _gl_h long, same long, n int, keys array<long>").where("n > 0")
    made, _ = stage.put(made, "bands")
    # Equal rows have one name, and equal sets of shingles in one class are one node.
    nodes = marked.select(*ROW, "class_fp").distinct().join(made, ROW).groupBy("same", "class_fp")
    nodes = nodes.agg(F.min(F.struct(*ROW)).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes, _ = stage.put(nodes, "nodes")
    flat = nodes.select(F.explode("keys").alias("band"), "class_fp", "row", "n")
    spans = flat.groupBy("band").agg(F.min("class_fp").alias("least"), F.max("class_fp").alias("most"))
    spans, _ = stage.put(spans.where("least != most").select("band"), "spans")
    flat, _ = stage.put(flat.join(spans, "band"), "flat")
    # Shingles once for each row that is compared.
    wanted = flat.select("row").distinct().select("row.*")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_gl_text"):
            sets = [shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=[*ROW, "set"])

    texts = source.join(wanted, ROW, "left_semi").dropDuplicates(ROW)
    sets = texts.mapInArrow(shingle, "_gl_d long, _gl_h long, set array<long>").select(F.struct(*ROW).alias("row"), "set")
    sets, _ = stage.put(sets, "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column("set"), batch.column("rep_set")]
            values = [c.values.to_numpy() for c in both]
            ends = [c.offsets.to_numpy() for c in both]
            good = []
            for i in range(batch.num_rows):
                one, two = (v[e[i] : e[i + 1]] for v, e in zip(values, ends))
                common = len(np.intersect1d(one, two, assume_unique=True))
                if common >= similarity * (len(one) + len(two) - common):
                    good.append(i)
            yield batch.select(["row", "rep"]).take(pa.array(good, pa.int64()))

    kind = "struct<_gl_d: long, _gl_h: long>"

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.join(sets, "row").join(sets.select(F.col("row").alias("rep"), F.col("set").alias("rep_set")), "rep")
        return stage.put(pairs.mapInArrow(compare, f"row {kind}, rep {kind}"), name)[0]

    whole, found, round_no = flat, None, 0
    while round_no < WHOLE_ROUNDS:
        turn = Window.partitionBy("band").orderBy(F.xxhash64("band", "row", F.lit(round_no)), "row", "class_fp")
        chosen = flat.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= 1 << round_no)
        chosen = chosen.select("band", F.col("row").alias("rep"), F.col("class_fp").alias("rep_class"), F.col("n").alias("rep_n"))
        chosen, _ = stage.put(chosen, f"chosen-{round_no}")
        met = flat.join(chosen, "band")
        near = F.least("n", "rep_n") >= F.greatest("n", "rep_n") * similarity
        apart = met.where((F.col("class_fp") != F.col("rep_class")) & near).select("band", "row", "class_fp", "rep", "rep_class")
        good = alike(apart.select("row", "rep").distinct(), f"good-{round_no}")
        own = met.where("class_fp = rep_class").select("band", "row", "class_fp", "rep_class")
        placed = apart.join(good, ["row", "rep"]).select(own.columns).unionByName(own)
        placed, _ = stage.put(placed, f"placed-{round_no}")
        linked = placed.where("class_fp != rep_class").select(F.col("class_fp").alias("a"), F.col("rep_class").alias("b"))
        found = linked if found is None else found.unionByName(linked)
        rest = flat.join(placed.select("band", "row", "class_fp").distinct(), ["band", "row", "class_fp"], "left_anti")
        rest, _ = stage.put(rest, f"rest-{round_no}")
        ends = rest.groupBy("band").agg(F.min("class_fp").alias("least"), F.max("class_fp").alias("most"))
        ends = ends.where("least != most").select("band")
        flat, seen = stage.put(rest.join(ends, "band"), f"flat-{round_no}", n=F.count(F.lit(1)))
        round_no += 1
    # Rows of bands that still span what is joined by now, with those that have left.
    roots = components(found.distinct(), stage, "joined").withColumnRenamed("node", "class_fp")
    joined = nodes.select("class_fp", "row", "n").join(roots, "class_fp", "left").withColumn("root", F.coalesce("root", "class_fp"))
    joined, _ = stage.put(joined, "rooted")
    bands = whole.select("band", "row").join(joined, "row")
    ends = bands.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("band")
    rows, seen = stage.put(bands.join(ends, "band").select("row", "class_fp", "root", "n").distinct(), "open", n=F.count(F.lit(1)))
    if not seen["n"]:
        return found.distinct()
    good = alike(rare_pairs(rows, sets, similarity, stage), "good")
    ends = rows.select("row", "class_fp")
    linked = good.join(ends.withColumnRenamed("class_fp", "a"), "row").join(ends.select(F.col("row").alias("rep"), F.col("class_fp").alias("b")), "rep")
    return found.unionByName(linked.select("a", "b")).distinct()


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """One row of each class of near copies: the smallest key, then the smallest hash of the row.

    All columns of docs are kept.  Rows without a key come last in their class.  similarity: classes
    that hold texts of at least this Jaccard similarity of five-word shingles are one class.
    """
    stage = StageTables(docs.sparkSession, "keep")
    named = with_row_name(docs, key)
    marked, _ = stage.put(classes(named.select(key, text, *ROW), key, text), "classes")
    if similarity is not None:
        edges, _ = stage.put(similar_classes(marked, named, text, similarity, stage), "similar")
        roots = components(edges, stage, "similar").withColumnRenamed("node", "class_fp")
        marked = marked.join(roots, "class_fp", "left").withColumn("class_fp", F.coalesce("root", "class_fp"))
    order = F.struct(F.col(key).isNull().alias("n"), F.col("_gl_d").alias("d"), F.col("_gl_h").alias("h"))
    best = marked.groupBy("class_fp").agg(F.min(order).alias("b"))
    kept = best.select(F.col("b.d").alias("_gl_d"), F.col("b.h").alias("_gl_h"))
    return with_copy(named.join(kept, ROW, "left_semi")).where("_gl_copy = 1").select(*docs.columns)
