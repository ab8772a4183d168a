"""What the operators share: shipping the package, global orders, prefix sums, components.

Internal columns begin with `_gl_`; input columns of that prefix are not supported.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.storage import StageTables

_shipped: set[str] = set()

# monotonically_increasing_id keeps the partition above this bit and the row below.
ROW_BITS = 33


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application; Spark serves the archive."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "graphloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a binary column holds about `most` bytes in each (a row stays whole)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def in_order(df: DataFrame, keys: list[str], stage: StageTables, name: str) -> DataFrame:
    """The rows sorted by range over all tasks and stored, with their place.

    Adds `_gl_part` (range number) and `_gl_row` (row in it from 0); the pair rises with the keys.
    """
    at = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_gl_at", at)
        .withColumn("_gl_part", F.shiftright("_gl_at", ROW_BITS).cast("int"))
        .withColumn("_gl_row", F.col("_gl_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_gl_at")
    )
    return stage.put(placed, name)[0]


def ranked(placed: DataFrame, groups: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds the rank from 0 within each group to rows of `in_order` sorted by the groups first.

    Only one row per group and range is gathered for it, so a hot group stays spread over tasks.
    total: also adds the rows of the group under this name.
    """
    starts = placed.groupBy("_gl_part", *groups).agg(
        F.count(F.lit(1)).alias("_gl_n"), F.min("_gl_row").alias("_gl_first")
    )
    # Without groups the window covers one row per range.
    window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_gl_part")
    before = F.coalesce(F.sum("_gl_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns: list[Column] = [(before - F.col("_gl_first")).alias("_gl_base")]
    if total:
        whole = Window.partitionBy(*(groups or [F.lit(0)]))
        columns.append(F.sum("_gl_n").over(whole).alias(total))
    offsets = starts.select(
        F.col("_gl_part").alias("_gl_p"), *[F.col(g).alias(f"_gl_g{i}") for i, g in enumerate(groups)], *columns
    )
    match = F.col("_gl_part") == F.col("_gl_p")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_gl_g{i}"))
    joined = placed.join(offsets, match)
    extra = ["_gl_p", "_gl_base", "_gl_part", "_gl_row"] + [f"_gl_g{i}" for i in range(len(groups))]
    return joined.withColumn(name, F.col("_gl_row") + F.col("_gl_base")).drop(*extra)


def prefix_sums(placed: DataFrame, groups: list[str], weight: str, name: str) -> DataFrame:
    """Adds the sum of `weight` over earlier rows of the group to rows of `in_order`.

    Sums run within one range of a group; one total per group and range carries them over.
    """
    run = Window.partitionBy("_gl_part", *groups).orderBy("_gl_row").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_gl_part", *groups).agg(F.sum(weight).alias("_gl_sum"))
    over = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_gl_part")
    carried = totals.select(
        F.col("_gl_part").alias("_gl_p"),
        *[F.col(g).alias(f"_gl_g{i}") for i, g in enumerate(groups)],
        F.coalesce(F.sum("_gl_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_gl_base"),
    )
    match = F.col("_gl_part") == F.col("_gl_p")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_gl_g{i}"))
    local = placed.withColumn("_gl_local", F.coalesce(F.sum(weight).over(run), F.lit(0)))
    extra = ["_gl_p", "_gl_base", "_gl_local", "_gl_part", "_gl_row"] + [f"_gl_g{i}" for i in range(len(groups))]
    return local.join(carried, match).withColumn(name, F.col("_gl_local") + F.col("_gl_base")).drop(*extra)


# Columns that together name a row among those of its table; equal rows share them.
ROW = ["_gl_d", "_gl_h"]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return _holds_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType)


def with_row_name(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds `_gl_d` (the key, 0 for null) and `_gl_h` (hash of all columns).

    Maps have no hash and are taken as JSON.  Both are never null, so a join on them and a window over them share one shuffle of the rows.
    """
    hashed = [F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if _holds_map(f.dataType) else F.col(f.name) for f in df.schema]
    return df.withColumn("_gl_h", F.xxhash64(*hashed)).withColumn("_gl_d", F.coalesce(key, F.lit(0)).cast("long"))


def with_copy(named: DataFrame) -> DataFrame:
    """Adds `_gl_copy`, a number from 1 among rows of one name (equal rows, so any order will do)."""
    return named.withColumn("_gl_copy", F.row_number().over(Window.partitionBy(*ROW).orderBy(F.lit(0))))


def components(edges: DataFrame, stage: StageTables, label: str) -> DataFrame:
    """The smallest node reachable from each linked node: rows (node, root).

    edges: (a, b) of type long.  Alternating large-star and small-star rounds (Kiveris et al.,
    2014): each links the neighbours of a node to the smallest one, once for larger and once for
    smaller neighbours, until only stars are left; about log(nodes) rounds.  A round is stored, so
    a lost executor costs that round at most.  Smallest neighbours are grouped minima, joined back
    on the node; they are stored first, so that AQE can split the join at hubs.
    """
    rising = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = F.xxhash64("u", "v").bitwiseAND(F.lit(0x3FFFFFFF))
    measures = {"rows": F.count(F.lit(1)), "mark": F.sum(mark)}
    current, seen = stage.put(rising, f"{label}-0", **measures)
    rounds = 0
    while seen["rows"]:
        rounds += 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least, _ = stage.put(least, f"{label}-{rounds}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, _ = stage.put(large, f"{label}-{rounds}-large")
        least, _ = stage.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-{rounds}-inner")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        current, now = stage.put(small, f"{label}-{rounds}", **measures)
        if now == seen:
            break
        seen = now
    tips = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tips.unionByName(tips.select(F.col("root").alias("node"), "root").distinct())
