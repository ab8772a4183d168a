"""Data counterparts of declared model facts: column profiles, unique keys, references."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...schemas import ONE_TO_MANY, ONE_TO_ONE

_SKETCH_BITS = 12
_WORD_BITS = 62
_SLICES = (1024, 64, 8)
_LEAST_ROWS = 1_000
_LEAST_VALUES = 16
_HASHES_PER_TASK = 1_000_000


def profile_columns(df: DataFrame, table: str) -> DataFrame:
    """Rows, nulls, distinct values and longest text per column; columns of arrays, maps and structs
    have no profile.

    Values are unpivoted and counted per (column, value) first, so exact distinct counts need
    one map-side combined shuffle and no expanded row per distinct aggregate.  The table is read
    once; long texts travel as digests."""
    flat = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    pairs = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), _value_key(f).alias("value"), F.length(F.col(f.name).cast("string")).alias("length"))
            for f in flat
        ]
    )
    counted = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    rows = counted.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.max("length").alias("max_length"),
    )
    texts = [f.name for f in flat if isinstance(f.dataType, T.StringType)]
    shown = F.when(F.col("column").isin(texts), F.col("max_length"))
    return rows.select(F.lit(table).alias("table"), "column", "row_count", "null_count", "distinct_count", shown.alias("max_length"))


def _value_key(field: T.StructField) -> Column:
    """Text that is equal for equal values only: zeros have no sign, bytes are written out, texts
    of more than 64 characters are digested."""
    value = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")
    if isinstance(field.dataType, T.BinaryType):
        value = F.hex(value)
    elif not isinstance(field.dataType, T.StringType):
        return value.cast("string")
    return F.when(F.length(value) > 64, F.concat(F.lit("d"), F.sha2(value, 256))).otherwise(F.concat(F.lit("t"), value))


def candidate_keys(df: DataFrame, table: str, candidates: list[list[str]]) -> DataFrame:
    """Column sets that are never null and unique.  The table is read once: every row asks once per
    set, and equal keys of a set are counted with a map-side combine."""
    fields = {f.name: f for f in df.schema.fields}
    asked = F.array(
        *[F.struct(F.lit(i).alias("i"), F.array(*[_value_key(fields[c]) for c in cs]).alias("key")) for i, cs in enumerate(candidates)]
    )
    groups = df.select(F.inline(asked)).groupBy("i", "key").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("whole", F.forall("key", lambda x: x.isNotNull()))
    found = groups.groupBy("i").agg(F.max("n").alias("most"), F.bool_and("whole").alias("whole"))
    names = df.sparkSession.createDataFrame([(i, ",".join(cs)) for i, cs in enumerate(candidates)], "i int, columns string")
    unique = (F.coalesce("most", F.lit(0)) <= 1) & F.coalesce("whole", F.lit(True))
    return names.join(found, "i", "left").select(F.lit(table).alias("table"), "columns", unique.alias("is_key"))


def _hash_of(fields: dict[str, T.StructField], columns: list[str]) -> Column:
    """A number that is equal for equal values of the columns; zeros have no sign."""
    plain = lambda c: F.col(f"`{c}`") + F.lit(0.0) if isinstance(fields[c].dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{c}`")
    return F.xxhash64(*[plain(c) for c in columns])


def _repeated_sets(df: DataFrame, sets: list[list[str]], slices: int = 1, pivots: list[str] | None = None, parts: int | None = None) -> set[int]:
    """Numbers of the sets that hold a value twice among the rows of their slice: those whose hash, of
    the set's pivot column or else of the whole set, falls into one of `slices`.  What is found is
    certain; sets not found are open, or free of repeats if there is but one slice.

    Hashes of 64 bits move in place of values.  Rows that share one are compared whole: at first those
    of two hashes per set and, where these are no repeats, all rows of the set.  `parts`: tasks for the count."""
    fields = {f.name: f for f in df.schema.fields}
    used = sorted({c for cs in sets for c in cs} | set(pivots or []))
    hashes = {c: _hash_of(fields, [c]) for c in used}
    rows = df
    if slices > 1 and pivots is not None:
        rows = df.where(reduce(lambda x, y: x | y, [F.pmod(hashes[c], F.lit(slices)) == 0 for c in sorted(set(pivots))]))
    width = max(map(len, sets))
    numbers = ["i", "pivot", *[f"c{k}" for k in range(width)]]
    at = lambda c: F.when(F.col(c) >= 0, F.get("hashes", F.col(c)))
    named = [F.col(f"`{c}`") for c in used]

    def asked(numbered: list[int]) -> DataFrame:
        """Rows of the slice, once per set.  Sets are numbers of columns, so code does not grow with them."""
        listed = [(i, used.index(pivots[i]) if pivots else -1, *[used.index(c) for c in sets[i]], *[-1] * (width - len(sets[i]))) for i in numbered]
        listed = F.array(*[F.struct(*[F.lit(n).alias(name) for n, name in zip(row, numbers)]) for row in listed])
        each = rows.select(*named, F.array(*hashes.values()).alias("hashes")).select(*named, "hashes", F.inline(listed))
        each = each.withColumn("h", F.xxhash64(*[at(f"c{k}") for k in range(width)]))
        return each.where(F.pmod(F.coalesce(at("pivot"), "h"), F.lit(slices)) == 0) if slices > 1 else each

    # Nearly all hashes differ: they are counted behind their move, where each task has its share of them.
    moved = asked(list(range(len(sets)))).select("i", "h")
    moved = moved.repartition(parts, "i", "h") if parts else moved.repartition("i", "h")
    groups = moved.groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"))
    shared = groups.where("n > 1").groupBy("i").agg(F.min("h").alias("least"), F.max("h").alias("most")).collect()
    if not shared:
        return set()
    witnesses = [(r["i"], h, [used.index(c) for c in sets[r["i"]]]) for r in shared for h in {r["least"], r["most"]}]
    found = df.sparkSession.createDataFrame(witnesses, "i int, h long, columns array<int>")
    whole = F.array(*[_value_key(fields[c]) for c in used])
    met = asked([r["i"] for r in shared]).join(F.broadcast(found), ["i", "h"]).select("i", "columns", whole.alias("whole"))
    met = met.select("i", F.transform("columns", lambda c: F.col("whole")[c]).alias("key"))
    repeated = {r["i"] for r in met.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i").distinct().collect()}
    unsure = [r["i"] for r in shared if r["i"] not in repeated]
    if unsure and slices == 1:
        found = {r["columns"] for r in candidate_keys(df, "", [sets[i] for i in unsure]).where("not is_key").collect()}
        repeated |= {i for i in unsure if ",".join(sets[i]) in found}
    return repeated


def minimal_keys(df: DataFrame, table: str, most: int = 3) -> DataFrame:
    """(table, columns): all smallest sets of up to `most` columns that are never null and unique.

    Sets grow by a column per level, and a set that holds a key is not looked at.  A set is ruled out by a
    repeated value, which is looked for in growing slices of the rows: rows that are equal in the set are
    equal in its column of most values, so a slice by that column's hash holds all of them.  Only sets
    that show none meet all rows.  Sketches choose that column; no result rests on them.  Columns of arrays,
    maps and structs take no part; of an empty table every column is a key.  Only numbers per set and sets of
    column names reach the driver.
    """
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    fields = {f.name: f for f in df.schema.fields}
    hashed = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), _hash_of(fields, [c])).alias(f"h{i}") for i, c in enumerate(flat)])
    size_of = [F.hll_sketch_estimate(F.hll_sketch_agg(f"h{i}", F.lit(_SKETCH_BITS))).alias(f"e{i}") for i in range(len(flat))]
    whole = hashed.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"h{i}").alias(f"n{i}") for i in range(len(flat))], *size_of).first()
    filled = [c for i, c in enumerate(flat) if whole[f"n{i}"] == whole["rows"]]
    values = {c: whole[f"e{i}"] or 0 for i, c in enumerate(flat)}
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        near = [list(s) for s in combinations(filled, size) if not any(set(k) <= set(s) for k in keys)]
        for slices in _SLICES:
            if near and whole["rows"] >= slices * _LEAST_ROWS:
                # A column of few values may have none in the slice; then the rows are cut by the best one of all.
                best = [max(s, key=lambda c: values[c]) for s in near]
                best = [c if values[c] >= slices * _LEAST_VALUES else max(filled, key=lambda c: values[c]) for c in best]
                repeated = _repeated_sets(df, near, slices, best)
                near = [s for i, s in enumerate(near) if i not in repeated]
        if near:
            # As many tasks as keep the hashes of one in memory.
            repeated = _repeated_sets(df, near, parts=-(-whole["rows"] * len(near) // _HASHES_PER_TASK) or 1)
            keys += [tuple(s) for i, s in enumerate(near) if i not in repeated]
    return df.sparkSession.createDataFrame([(table, ",".join(k)) for k in keys], "table string, columns string")


def inclusion_dependencies(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, ref_table, ref_column): every value of a column is also a value of the other.

    All integer and text columns of all tables are compared in one shuffle: a value gathers the columns
    that hold it as bits, and a column keeps the bits that all its values have.  Both are combined
    map-side, so a hot value is one row per task.  Nulls are no values; a column without values is
    left out; integers meet integers of any width, texts meet texts.
    """
    columns = [
        (name, field)
        for name, df in tables.items()
        for field in df.schema.fields
        if isinstance(field.dataType, (T.IntegralType, T.StringType))
    ]
    words = range(-(-len(columns) // _WORD_BITS))
    bits = lambda i: [F.lit(1 << i % _WORD_BITS if i // _WORD_BITS == w else 0).cast("long").alias(f"w{w}") for w in words]
    parts = []
    for name, df in tables.items():
        mine = [F.struct(_value_key(f).alias("v"), *bits(i)) for i, (t, f) in enumerate(columns) if t == name]
        if mine:
            parts.append(df.select(F.inline(F.array(*mine))).where("v IS NOT NULL"))
    if not parts:
        raise ValueError("no table has an integer or text column")
    held = reduce(DataFrame.unionByName, parts).groupBy("v").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in words])
    has = lambda i: F.col(f"w{i // _WORD_BITS}").bitwiseAND(F.lit(1 << i % _WORD_BITS)) != 0
    holders = F.array_compact(F.array(*[F.when(has(i), F.lit(i)) for i in range(len(columns))]))
    shared = held.select(F.explode(holders).alias("i"), *[f"w{w}" for w in words])
    shared = shared.groupBy("i").agg(*[F.bit_and(f"w{w}").alias(f"w{w}") for w in words])
    pairs = shared.select("i", F.explode(holders).alias("j")).where("i != j")
    named = df.sparkSession.createDataFrame([(i, t, f.name) for i, (t, f) in enumerate(columns)], "i int, table string, column string")
    other = named.toDF("j", "ref_table", "ref_column")
    return pairs.join(named, "i").join(other, "j").select("table", "column", "ref_table", "ref_column")


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v, n): how often column number i has a value, from one scan."""
    fields = {f.name: f for f in df.schema.fields}
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), _value_key(fields[c]).alias("v")) for i, c in enumerate(columns)])
    return df.select(F.inline(pairs)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))


def inclusion_checks(child: DataFrame, references: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Per reference (column, parent, parent column, name): how many child rows have no parent, and how
    many have no value.  The child table is read once for all its references."""
    values = _values(child, [column for column, *_ in references])
    keys = None
    for i, (_, parent, column, _) in enumerate(references):
        part = parent.select(F.lit(i).alias("i"), _value_key(parent.schema[column]).alias("v")).distinct()
        keys = part if keys is None else keys.unionByName(part)
    joined = values.join(keys.withColumn("known", F.lit(True)), ["i", "v"], "left")
    orphan = F.col("v").isNotNull() & F.col("known").isNull()
    found = joined.groupBy("i").agg(
        F.sum(F.when(orphan, F.col("n"))).alias("orphans"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls")
    )
    names = child.sparkSession.createDataFrame([(i, r[3]) for i, r in enumerate(references)], "i int, reference string")
    return names.join(found, "i", "left").select(
        "reference", F.coalesce("orphans", F.lit(0)).alias("orphans"), F.coalesce("nulls", F.lit(0)).alias("nulls")
    )


def cardinalities_from_data(child: DataFrame, references: list[tuple[str, str, str]]) -> DataFrame:
    """Per reference (column, src, dst): one-to-one when no parent has more than one child row; required
    when no value is null.  The child table is read once for all its references."""
    totals = _values(child, [column for column, *_ in references]).groupBy("i").agg(
        F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("most"), F.bool_and(F.col("v").isNotNull()).alias("filled")
    )
    names = child.sparkSession.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(references)], "i int, src string, dst string")
    kind = F.when(F.coalesce("most", F.lit(0)) > 1, ONE_TO_MANY).otherwise(ONE_TO_ONE)
    return names.join(totals, "i", "left").select("src", "dst", kind.alias("rel_type"), F.coalesce("filled", F.lit(True)).alias("is_required"))
