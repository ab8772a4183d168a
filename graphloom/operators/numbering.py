"""Row numbers, suffixes and first-wins picks that hold up when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import StageTables

_SLOTS = 65_536


def _range_sorted(df: DataFrame, group: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The rows in one range sort over group and order, with their task (_task) and a number
    that grows in sort order (_at).  A hot group spreads over many tasks.  Of the columns only
    group and `keep` are stored, if it is given."""
    keys = group + [c for c in order if c not in group]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stage = StageTables(df.sparkSession, "sorted")
    kept = ranged.columns if keep is None else [*group, *[c for c in keep if c not in group]]
    placed, _ = stage.put(ranged.select(*kept, F.monotonically_increasing_id().alias("_at")), "rows")
    return placed.withColumn("_task", F.shiftright("_at", 33))


def _per_task(placed: DataFrame, group: list[str], tasks: DataFrame) -> DataFrame:
    """Joins the table with one row per group and task to the sorted rows."""
    renamed = tasks.withColumnRenamed("_task", "_t")
    match = placed["_task"] == renamed["_t"]
    for i, g in enumerate(group):
        renamed = renamed.withColumnRenamed(g, f"_g{i}")
        match = match & placed[g].eqNullSafe(renamed[f"_g{i}"])
    return placed.join(renamed, match, "left")


def _tasks_before(group: list[str]):
    # At most one row per group and range partition, so this window stays small.
    return Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)


def _large_groups(stored: DataFrame, group: list[str], most: int) -> tuple[Column | None, bool]:
    """Condition for rows whose group may have more than `most` rows, None if no group has, and whether
    there are other rows.

    Rows are counted by a hash of their group, so the count has a bounded size however many groups
    there are; a hash that several groups share at worst makes small ones count as large.  At most
    one hash per `most` rows reaches the driver."""
    slot = F.pmod(F.xxhash64(*group), F.lit(_SLOTS))
    counts = stored.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    found = [r["slot"] for r in counts.select(F.when(F.col("n") > most, F.col("slot")).alias("slot")).distinct().collect()]
    large = [s for s in found if s is not None]
    return slot.isin(large) if large else None, None in found


def number_rows(
    df: DataFrame, group: list[str], order: list[str], name: str = "seq", most: int = 200_000, by: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """row_number() over (partition by group order by order), for groups of any size.

    Groups of up to `most` rows are numbered by a window, one shuffle in all.  Larger ones go
    through one range sort that spreads them over many tasks: each task numbers its own rows, and the
    small table of per-task counts gives it its starting number.  `order` must be total within a
    group.  The input is read once and stored.

    by: a column of the group that the rows are bucketed by (see StageTables.put); they are numbered
    where they are, by a window alone.  keep: the columns of the result beside the number, all by default.
    """
    columns = df.columns if keep is None else keep
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if by is not None:
        return df.select(*columns, place.alias(name))
    stage = StageTables(df.sparkSession, "unnumbered")
    stored, _ = stage.put(df, "rows")
    large, others = _large_groups(stored, group, most)
    if large is None:
        return stored.select(*columns, place.alias(name))
    if not others:
        spread = _number_spread(stored, group, order, name, columns)
        # The sorted rows are stored; these are not read again.
        stage.drop("rows")
        return spread
    usual = stored.filter(~large).select(*columns, place.alias(name))
    return usual.unionByName(_number_spread(stored.filter(large), group, order, name, columns))


def _number_spread(df: DataFrame, group: list[str], order: list[str], name: str, columns: list[str]) -> DataFrame:
    placed = _range_sorted(df, group, order, columns)
    counts = placed.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(_tasks_before(group)), F.lit(0))
    starts = counts.select(*group, "_task", "_first", before.alias("_before"))
    position = (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")
    return _per_task(placed, group, starts).select(*columns, position.alias(name))


def running_last(
    df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], most: int = 200_000, by: str | None = None
) -> DataFrame:
    """Adds, per name, the last non-null value at or before each row of its group; large groups are
    spread over tasks as in `number_rows`, rows bucketed by a column of the group stay where they are."""
    here = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(c, ignorenulls=True).over(here).alias(n) for n, c in values.items()]
    if by is not None:
        return df.select(*df.columns, *last)
    stored, _ = StageTables(df.sparkSession, "untraced").put(df, "rows")
    large, _ = _large_groups(stored, group, most)
    if large is None:
        return stored.select(*df.columns, *last)
    return stored.filter(~large).select(*df.columns, *last).unionByName(_last_spread(stored.filter(large), group, order, values))


def _last_spread(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    placed = _range_sorted(df, group, order)
    placed = placed.select("*", *[c.alias(f"_v_{n}") for n, c in values.items()])
    tails = placed.groupBy(*group, "_task").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_tail_{n}") for n in values]
    )
    carried = [F.last(f"_tail_{n}", ignorenulls=True).over(_tasks_before(group)).alias(f"_carry_{n}") for n in values]
    carry = tails.select(*group, "_task", *carried)
    here = Window.partitionBy(*group, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = [F.last(f"_v_{n}", ignorenulls=True).over(here).alias(f"_local_{n}") for n in values]
    merged = _per_task(placed.select("*", *local), group, carry)
    return merged.select(*df.columns, *[F.coalesce(f"_local_{n}", f"_carry_{n}").alias(n) for n in values])


def running_marks(df: DataFrame, group: list[str], order: list[str], mark: Column) -> DataFrame:
    """Adds `row` (the row number in its group from 1), `marks` (marked rows at or before it) and `at`
    (the number of the last of these, 0 if there is none); groups are spread over tasks and sorted once."""
    placed = _range_sorted(df.withColumn("_mark", mark), group, order)
    here = Window.partitionBy(*group, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.col("_mark").cast("long")
    local = placed.withColumn("_row", F.row_number().over(here).cast("long")).withColumn("_marks", F.sum(marked).over(here))
    local = local.withColumn("_last", F.max(F.when(F.col("_mark"), F.col("_row"))).over(here))
    last = F.max(F.when(F.col("_mark"), F.col("_at"))) - F.min("_at") + 1
    tasks = placed.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.sum(marked).alias("_k"), last.alias("_end"))
    before = _tasks_before(group)
    none = F.lit(0).cast("long")
    tasks = tasks.withColumn("_rows_before", F.coalesce(F.sum("_n").over(before), none))
    tasks = tasks.select(
        *group, "_task", "_rows_before",
        F.coalesce(F.sum("_k").over(before), none).alias("_marks_before"),
        F.coalesce(F.max(F.col("_rows_before") + F.col("_end")).over(before), none).alias("_last_before"),
    )
    return _per_task(local, group, tasks).select(
        *df.columns,
        (F.col("_rows_before") + F.col("_row")).alias("row"),
        (F.col("_marks_before") + F.col("_marks")).alias("marks"),
        F.coalesce(F.col("_rows_before") + F.col("_last"), "_last_before").alias("at"),
    )


def repeat_rows(df: DataFrame, copies: str, name: str = "copy", chunk: int = 100_000) -> DataFrame:
    """Each row as often as its `copies` says, numbered from 1.  Copies are cut into chunks that
    are spread over tasks before they are unfolded."""
    last = F.floor((F.col(copies) - 1) / chunk).cast("long")
    chunks = df.filter(F.col(copies) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_chunk"))
    chunks = chunks.repartition(*[F.col(c) for c in df.columns if c != copies][:3], F.col("_chunk"))
    size = F.least(F.lit(chunk), F.col(copies) - F.col("_chunk") * chunk).cast("int")
    inner = F.explode(F.sequence(F.lit(1), size)).alias("_inner")
    return chunks.select("*", inner).select(*df.columns, (F.col("_chunk") * chunk + F.col("_inner")).alias(name))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key; `order` must be total within a key."""
    rest = [c for c in df.columns if c not in key]
    fields = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)] + [F.col(c) for c in rest if c not in order]
    best = df.groupBy(*key).agg(F.min(F.struct(*fields)).alias("_best"))
    source = {c: f"_best._o{i}" for i, c in enumerate(order)}
    return best.select(*key, *[F.col(source.get(c, f"_best.{c}")).alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows per group.  Spark keeps only n rows per group and task before the
    shuffle (window group limit), so a hot group costs n rows per task."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def label_duplicates(df: DataFrame, label: str, group: list[str], order: list[str], name: str) -> DataFrame:
    """Repeated labels become `x (2)`, `x (3)` in order."""
    numbered = number_rows(df, group + [label], order, "_n")
    text = F.when(F.col("_n") == 1, F.col(label)).otherwise(F.format_string("%s (%d)", F.col(label), F.col("_n")))
    return numbered.withColumn(name, text).drop("_n")


def suffix_duplicates(df: DataFrame, base: str, group: list[str], order: list[str], name: str, by: str | None = None) -> DataFrame:
    """Unique ids from base ids: the first user in order takes the base itself, later ones
    probe `base_2`, `base_3`, ... and skip ids that are taken.

    The n-th user of a base can do no better than `base_n`, so it asks for that first.  When
    two rows ask for one id the earlier row keeps it; the later one asks for the next number,
    and so do the users of its base that stand right behind it, whose ids it now needs.  Most
    rows settle in the first pass; further passes happen only while ids clash.  by: as in number_rows.
    """
    stage = StageTables(df.sparkSession, "suffix")
    ranked = number_rows(df, group + [base], order, "_rank", by=by)
    ranked = number_rows(ranked, group, order, "_ord", by=by).withColumn("_shift", F.lit(0).cast("long"))
    current, _ = stage.put(ranked, "pass=0", by)
    passes = 0
    while True:
        number = F.col("_rank") + F.col("_shift")
        asked = F.when(number == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), number.cast("string")))
        asking = current.withColumn(name, asked)
        holders = asking.groupBy(*group, name).agg(F.min("_ord").alias("_holder"), F.count(F.lit(1)).alias("_n"))
        clashes, seen = stage.put(holders.filter("_n > 1").drop("_n"), f"clash={passes}", by, n=F.count(F.lit(1)))
        if not seen["n"]:
            return asking.drop("_rank", "_ord", "_shift")
        losers = asking.join(clashes, [*group, name]).filter("_ord > _holder")
        first = losers.groupBy(*group, base, "_shift").agg(F.min("_rank").alias("_from"))
        moved = current.join(first, [*group, base, "_shift"], "left")
        step = F.when(F.col("_rank") >= F.col("_from"), 1).otherwise(0)
        passes += 1
        moved = moved.withColumn("_shift", F.col("_shift") + step).select(*current.columns)
        current, _ = stage.put(moved, f"pass={passes}", by)
