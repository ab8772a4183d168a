"""Nested data and its schema: structs are owned entities, arrays of structs owned collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.types import VALUE_TYPES
from ...schemas import ENTITIES, PROPERTIES
from ...storage import StageTables
from ..numbering import number_rows

# Described names of the Spark types.
TYPE_NAMES = {
    "integer": "int",
    "long": "long",
    "short": "short",
    "byte": "byte",
    "boolean": "bool",
    "float": "float",
    "double": "double",
    "decimal": "decimal",
    "string": "string",
    "binary": "byte[]",
    "date": "DateOnly",
    "timestamp": "DateTimeOffset",
    "timestamp_ntz": "DateTime",
}


def described_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return f"List<{described_type(data_type.elementType)}>"
    name = data_type.typeName()
    return "TimeSpan" if name.startswith("interval") else TYPE_NAMES.get(name, name)


def _owned_struct(data_type: T.DataType) -> tuple[T.StructType | None, bool]:
    if isinstance(data_type, T.StructType):
        return data_type, False
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType):
        return data_type.elementType, True
    return None, False


def describe_schema(model_id: str, name: str, schema: T.StructType) -> tuple[list[tuple], list[tuple]]:
    """Entity and property rows of one table schema; works on metadata only."""
    entities, properties = [], []

    def walk(key: str, label: str, struct: T.StructType, owner: str | None, nav: str | None, many: bool) -> None:
        entities.append((model_id, key, label, None, False, owner is not None, owner, nav, many))
        for position, field in enumerate(struct.fields):
            inner, is_many = _owned_struct(field.dataType)
            if inner is not None:
                walk(f"{key}.{field.name}", field.name, inner, key, field.name, is_many)
                continue
            shown = described_type(field.dataType)
            sized = isinstance(field.dataType, T.DecimalType)
            properties.append(
                (
                    model_id, key, position, field.name, shown, False, False, not field.nullable,
                    shown.lower() in {t.lower() for t in VALUE_TYPES}, False, False, None,
                    field.dataType.precision if sized else None,
                    field.dataType.scale if sized else None,
                    None,
                )
            )

    walk(name, name, schema, None, None, False)
    return entities, properties


def catalog_entities(spark: SparkSession, tables: dict[str, DataFrame] | None = None, model_id: str = "catalog") -> tuple[DataFrame, DataFrame]:
    """Entity and property tables of the given tables, or of the current catalog database.
    The first table of a name wins."""
    if tables is None:
        tables = {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    entities, properties = [], []
    for name, table in tables.items():
        found, columns = describe_schema(model_id, name, table.schema)
        entities += found
        properties += columns
    return spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(properties, PROPERTIES)


def describe_properties(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return catalog_entities(spark, tables)[1]


class ModelChoiceError(ValueError):
    """No single model was chosen; `models` holds all model ids as a table."""

    def __init__(self, message: str, models: DataFrame):
        super().__init__(message)
        self.models = models


def list_models(entities: DataFrame, name: str | None = None) -> DataFrame:
    """Model ids; with a name, that model, which must exist."""
    models = entities.select("model_id").distinct()
    if name is None:
        return models
    chosen = models.filter(F.col("model_id") == name)
    if chosen.isEmpty():
        raise ModelChoiceError(f"no model {name!r}; there are {models.count()} models", models)
    return chosen


def only_model(entities: DataFrame, name: str | None = None) -> str:
    """The one model id of the table; several need a name, none is an error."""
    if name is not None:
        return list_models(entities, name).first().model_id
    models = list_models(entities)
    found = models.limit(2).collect()
    if not found:
        raise ModelChoiceError("no model found", models)
    if len(found) > 1:
        raise ModelChoiceError(f"name one of the {models.count()} models", models)
    return found[0].model_id


def flatten_nested(df: DataFrame) -> DataFrame:
    """Folds structs into `{Nav}_{Field}` columns at any depth; arrays stay as they are."""

    def leaves(struct: T.StructType, path: list[str]) -> list[list[str]]:
        out = []
        for field in struct.fields:
            here = [*path, field.name]
            out += leaves(field.dataType, here) if isinstance(field.dataType, T.StructType) else [here]
        return out

    columns = [F.col(".".join(f"`{p}`" for p in path)).alias("_".join(path)) for path in leaves(df.schema, [])]
    return df.select(*columns)


def split_nested(df: DataFrame, name: str, key: list[str]) -> dict[str, DataFrame]:
    """Tables of a nested table: arrays of structs become `{Owner}_{Nav}` tables that carry the
    owner's key and their position; structs are folded; nested arrays split further."""
    flat = flatten_nested(df)
    lists = [f.name for f in flat.schema.fields if _owned_struct(f.dataType)[1]]
    tables = {name: flat.drop(*lists)}
    for column in lists:
        position = f"{column}_Ordinal"
        items = flat.select(*key, F.posexplode(column).alias(position, "_item")).select(*key, position, "_item.*")
        tables.update(split_nested(items, f"{name}_{column}", [*key, position]))
    return tables


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    return _orderable(data_type.elementType) if isinstance(data_type, T.ArrayType) else not isinstance(data_type, (T.MapType, T.VariantType))


def _numbered_items(children: DataFrame, key: list[str], position: str) -> DataFrame:
    """(key, _seq, _item): children without key and position as structs, numbered from 0 within their key
    by position, equal positions by their other columns."""
    rest = [f for f in children.schema.fields if f.name not in (*key, position)]
    order = [position, *[f.name for f in rest if _orderable(f.dataType)]]
    item = F.struct(*[F.col(f"`{f.name}`") for f in rest])
    numbered = number_rows(children, key, order, "_seq")
    return numbered.select(*key, (F.col("_seq") - 1).alias("_seq"), item.alias("_item"))


def _gathered(items: DataFrame, by: list[str], name: str) -> DataFrame:
    """One row per `by` with its items as an array in order of _seq."""
    ordered = F.array_sort(F.collect_list(F.struct("_seq", "_item")), lambda a, b: F.when(a["_seq"] < b["_seq"], -1).otherwise(1))
    return items.groupBy(*by).agg(F.transform(ordered, lambda r: r["_item"]).alias(name))


def nested_parts(children: DataFrame, key: list[str], position: str, name: str, size: int = 1000) -> DataFrame:
    """(key, part, name): the children of a key as arrays of `size` rows (the last one of a key may
    hold fewer), parts from 0, in order of position.  A key of any size is spread over many rows.

    Null keys are a key of their own; a table without rows gives none.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    items = _numbered_items(children, key, position).withColumn("part", F.floor(F.col("_seq") / size).cast("long"))
    return _gathered(items, [*key, "part"], name)


def nest_children(parents: DataFrame, children: DataFrame, key: list[str], position: str, name: str, at_most: int) -> DataFrame:
    """Parents with their children as one array column, in order of position.

    One array is one row, so the caller states how many children a parent may have: a parent with
    more raises before anything is gathered, `nested_parts` takes such tables.  A parent without
    children has an empty array; children without a parent are dropped; parents that repeat a key
    all get its children.
    """
    stage = StageTables(parents.sparkSession, "nest")
    items, seen = stage.put(_numbered_items(children, key, position), "items", most=F.max(F.col("_seq") + 1))
    if seen["most"] > at_most:
        raise ValueError(f"a row has {seen['most']} items in {name}, more than the {at_most} stated")
    renamed = _gathered(items, key, name)
    for i, k in enumerate(key):
        renamed = renamed.withColumnRenamed(k, f"_k{i}")
    match = F.lit(True)
    for i, k in enumerate(key):
        match = match & parents[k].eqNullSafe(renamed[f"_k{i}"])
    none = F.array().cast(renamed.schema[name].dataType)
    return parents.join(renamed, match, "left").select(*[parents[c] for c in parents.columns], F.coalesce(renamed[name], none).alias(name))


def unflatten(df: DataFrame, schema: T.StructType, keep: list[str]) -> DataFrame:
    """The inverse of `flatten_nested`: `keep`, then the fields of the schema, structs made of their
    `{Nav}_{Field}` columns.  A struct all of whose fields are null comes back as null."""

    def built(field: T.StructField, path: list[str]):
        here = [*path, field.name]
        if not isinstance(field.dataType, T.StructType):
            return F.col(f"`{'_'.join(here)}`")
        parts = [built(f, here) for f in field.dataType.fields]
        whole = F.struct(*[p.alias(f.name) for p, f in zip(parts, field.dataType.fields, strict=True)])
        return F.when(_any_set(parts), whole)

    return df.select(*keep, *[built(f, []).alias(f.name) for f in schema.fields if f.name not in keep])


def _any_set(parts):
    found = F.lit(False)
    for p in parts:
        found = found | p.isNotNull()
    return found


def join_nested(tables: dict[str, DataFrame], name: str, key: list[str], schema: T.StructType, at_most: int) -> DataFrame:
    """The inverse of `split_nested`: the nested table of this schema from its tables.

    Innermost arrays are filled first.  Arrays that were null come back empty, as both split into
    no rows; `at_most` bounds the items of one array (see `nest_children`).
    """
    out = tables[name]

    def filled(out: DataFrame, struct: T.StructType, path: list[str]) -> DataFrame:
        for field in struct.fields:
            here = [*path, field.name]
            inner, many = _owned_struct(field.dataType)
            if many:
                column = "_".join(here)
                position = f"{column}_Ordinal"
                items = join_nested(tables, f"{name}_{column}", [*key, position], inner, at_most)
                out = nest_children(out, items, key, position, column, at_most)
            elif inner is not None:
                out = filled(out, inner, here)
        return out

    return unflatten(filled(out, schema, []), schema, key)
