"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ROW, in_order, prefix_sums, with_copy, with_row_name
from graphloom.storage import StageTables

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def words(text: Column) -> Column:
    """Number of words (runs without ASCII white space) of a text; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with `target`: the sizes of all sources shared out by weight.

    Sources in code-point order, null last, take the weights in turn.  No target is above `most`
    times its source's size; what that leaves over is shared by weight among the others until none
    is above.  That is target = min(most * size, rate * weight) with one rate for all: in order of
    most * size / weight the first sources reach their limit, and the rest share what remains.
    The windows cover one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size") * most)
    rows = rows.withColumn("ratio", F.col("limit") / F.col("w")).withColumn("all", F.sum("source_size").over(every))
    upto = every.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    full = F.sum("limit").over(upto) + F.col("ratio") * (F.sum("w").over(every) - F.sum("w").over(upto))
    rows = rows.withColumn("capped", full <= F.col("all"))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(every), F.lit(0))
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(
        left * F.col("w") / open_weight
    )
    return rows.select("source", "source_size", target.alias("target"))


def mix(df: DataFrame, stage: StageTables, seed: int = 42, tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What the mix takes of each row of df (source, size and the tie columns).

    Adds source_size, target and `taken`: whole epochs of the source, then rows in hash order until
    the budget (the target rounded to words) is used up exactly; the row at the edge gives part of
    its words.  So the words taken from a source equal its budget, and no row gives more than 3
    times its size.  Rows equal in all tie columns are interchangeable; a null source is a source.
    The order is by range over all tasks and carries one sum per source and range, so a source of
    any size stays spread.  The hash is md5 of the seed and the tie columns.
    """
    sums = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals, _ = stage.put(targets(sums), "targets")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(t).cast("string"), F.lit("-")) for t in tie]))
    placed = in_order(df.withColumn("_gl_key", key), ["source", "_gl_key", *tie], stage, "ordered")
    summed = prefix_sums(placed, ["source"], "size", "_gl_before")
    goals = goals.withColumnRenamed("source", "_gl_source")
    rows = summed.join(goals, F.col("source").eqNullSafe(F.col("_gl_source")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("div(_gl_budget, source_size)")).otherwise(F.lit(0))
    rows = rows.withColumn("_gl_budget", budget).withColumn("_gl_epochs", epochs)
    rest = F.col("_gl_budget") - F.col("_gl_epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_gl_before")))
    taken = F.col("_gl_epochs") * F.col("size") + part
    return rows.withColumn("taken", taken.cast("long")).drop("_gl_source", "_gl_budget", "_gl_epochs", "_gl_before")


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of the mix: every document of docs as often as the mix takes it, texts whole.

    A document of which only a part is taken in the last epoch counts there if it is at least half.
    Documents without words follow the order of the others: they are taken once per whole epoch.
    All columns of docs are kept.  Equal rows are interchangeable.
    """
    stage = StageTables(docs.sparkSession, "mix")
    named = with_row_name(docs)
    # The number of words behind the hash stands for the text from here on.
    slim, _ = stage.put(named.select(*ROW, "source", words(F.col("text")).alias("size")), "sizes")
    plan = mix(slim, stage, seed, tie=tuple(ROW))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.greatest(whole, F.lit(1)))
    # Equal rows add up, and one of them stands for all.
    plan = plan.groupBy(*ROW).agg(F.sum(times).cast("int").alias("_gl_times")).where("_gl_times > 0")
    plan, _ = stage.put(plan, "plan")
    rows = with_copy(named.join(plan, ROW)).where("_gl_copy = 1")
    again = F.explode(F.sequence(F.lit(1), F.col("_gl_times")))
    return rows.withColumn("_gl_turn", again).select(*docs.columns)
