"""Shards that all hold the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import in_order, ranked
from graphloom.storage import StageTables


def interleave(
    df: DataFrame, stratum: str = "source", shards: int = 8, seed: int = 42, tie: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Puts all rows of df into shards; adds `shard` (from 0) and `slot` (place in it, from 0).

    Rows are shuffled by a seeded hash of the tie columns and ranked within their stratum; the
    fractional rank (rank + 1/2) / rows of the stratum sorts all strata into each other, and equal
    cuts of that order give shards whose row counts differ by at most one and whose share of every
    stratum is within about one row of its share of df.

    Both sorts are by range over all tasks, so a stratum with a third of all rows stays spread.
    A null stratum is a stratum of its own; rows equal in all tie columns are interchangeable;
    columns of df named shard or slot are replaced; no rows give no rows.
    """
    stage = StageTables(df.sparkSession, "interleave")
    rows = df.drop("shard", "slot").withColumn("_gl_h", F.xxhash64(F.lit(seed), *tie))
    first = in_order(rows, [stratum, "_gl_h", *tie], stage, "by-stratum")
    mixed = ranked(first, [stratum], "_gl_rank", total="_gl_size").withColumn(
        "_gl_at", (F.col("_gl_rank") + 0.5) / F.col("_gl_size")
    )
    second = in_order(mixed.drop("_gl_rank", "_gl_size"), ["_gl_at", "_gl_h", stratum, *tie], stage, "mixed")
    placed = ranked(second, [], "_gl_rank", total="_gl_size")
    shard = F.expr(f"_gl_rank * {shards} div _gl_size")
    # The first rank of shard s is the smallest r with r * shards >= s * size.
    start = F.expr(f"(shard * _gl_size + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("_gl_rank") - start)
        .withColumn("shard", F.col("shard").cast("int"))
        .select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes the rows of df into one folder per shard, in the order of their slots."""
    placed = interleave(df, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(
        path
    )
