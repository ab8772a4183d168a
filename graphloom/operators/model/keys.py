"""Primary and foreign keys by declaration and naming convention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import is_conventional_key
from ...functions.types import guess_type, is_value_type
from ..numbering import number_rows

ENTITY = ["model_id", "entity_key"]


def effective_entities(entities: DataFrame) -> DataFrame:
    """Adds effective_key (key or name) and effective_table (table name or name)."""
    key = F.coalesce(F.expr("nullif(entity_key, '')"), F.col("name"))
    table = F.coalesce(F.expr("nullif(table_name, '')"), F.col("name"))
    return entities.withColumn("effective_key", key).withColumn("effective_table", table)


def _with_entity_name(entities: DataFrame, properties: DataFrame) -> DataFrame:
    return properties.join(entities.select(*ENTITY, F.col("name").alias("_entity")), ENTITY)


def primary_keys(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """Declared keys and keys by name.  An optional column `declaring_type` names the base
    type a property was inherited from."""
    declaring = F.col("declaring_type") if "declaring_type" in properties.columns else None
    named = _with_entity_name(entities, properties)
    marked = F.col("is_pk") | is_conventional_key("name", "_entity", declaring)
    return named.withColumn("is_pk", marked).select(*properties.columns)


def primary_key_fallback(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """Entities without any key get one: `Id` before `<Entity>Id`, first declared first."""
    named = _with_entity_name(entities, properties)
    name, entity = F.lower("name"), F.lower("_entity")
    rank = F.when(name == "id", 0).when(name == F.concat(entity, F.lit("id")), 1)
    choice = named.groupBy(*ENTITY).agg(
        F.bool_or("is_pk").alias("_keyed"),
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("ordinal")))).alias("_best"),
    )
    choice = choice.filter("not _keyed and _best is not null").select(*ENTITY, F.col("_best.ordinal").alias("_pick"))
    joined = properties.join(choice, ENTITY, "left")
    picked = F.coalesce(F.col("ordinal") == F.col("_pick"), F.lit(False))
    return joined.withColumn("is_pk", F.col("is_pk") | picked).select(*properties.columns)


def root_navigations(entities: DataFrame, navigations: DataFrame) -> DataFrame:
    """Navigations between declared entities; owned entities take no part."""
    known = entities.filter(~F.col("is_owned")).select("model_id", "name").distinct()
    return navigations.join(known.withColumnRenamed("name", "entity"), ["model_id", "entity"], "left_semi").join(
        known.withColumnRenamed("name", "target"), ["model_id", "target"], "left_semi"
    )


def foreign_keys(entities: DataFrame, properties: DataFrame, navigations: DataFrame) -> DataFrame:
    """Marks foreign keys by name: `<nav>Id` or `<Target>Id` beside a reference, `<Source>Id`
    on the target of a collection.  Case is ignored."""
    named = F.when(
        F.col("is_collection"),
        F.array(F.struct(F.col("target").alias("_entity"), F.concat(F.lower("entity"), F.lit("id")).alias("_fk"))),
    ).otherwise(
        F.array(
            F.struct(F.col("entity").alias("_entity"), F.concat(F.lower("nav"), F.lit("id")).alias("_fk")),
            F.struct(F.col("entity").alias("_entity"), F.concat(F.lower("target"), F.lit("id")).alias("_fk")),
        )
    )
    wanted = root_navigations(entities, navigations).select("model_id", F.inline(named)).distinct()
    wanted = wanted.withColumn("_hit", F.lit(True))
    roots = entities.filter(~F.col("is_owned")).select(*ENTITY, F.col("name").alias("_entity"))
    keyed = properties.join(roots, ENTITY, "left").withColumn("_fk", F.lower("name"))
    joined = keyed.join(wanted, ["model_id", "_entity", "_fk"], "left")
    return joined.withColumn("is_fk", F.col("is_fk") | F.coalesce("_hit", F.lit(False))).select(*properties.columns)


def declared_foreign_keys(properties: DataFrame, declared: DataFrame, by: str | None = None) -> DataFrame:
    """Marks declared foreign keys (model_id, entity_key, name); a declared one that does not
    exist is added with a type guessed from its name.  by: the column both tables are bucketed by."""
    declared = declared.select(*ENTITY, "name").distinct()
    marked = properties.join(declared.withColumn("_hit", F.lit(True)), [*ENTITY, "name"], "left")
    marked = marked.withColumn("is_fk", F.col("is_fk") | F.coalesce("_hit", F.lit(False))).select(*properties.columns)
    missing = declared.join(properties.select(*ENTITY, "name"), [*ENTITY, "name"], "left_anti")
    return marked.unionByName(_guessed(properties, missing, by).withColumn("is_fk", F.lit(True)))


def _guessed(properties: DataFrame, missing: DataFrame, by: str | None = None) -> DataFrame:
    """Property rows known by name only, numbered behind the declared ones by name."""
    last = properties.groupBy(*ENTITY).agg(F.max("ordinal").alias("_last"))
    missing = number_rows(missing, ENTITY, ["name"], "_seq", by=by).join(last, ENTITY, "left")
    known = {
        "type": guess_type("name"),
        "is_value_type": is_value_type(guess_type("name")),
        "is_type_inferred": F.lit(True),
        "ordinal": F.coalesce("_last", F.lit(0)) + F.col("_seq"),
    }
    columns = []
    for field in properties.schema.fields:
        if field.name in missing.columns:
            columns.append(F.col(field.name))
        elif field.name in known:
            columns.append(known[field.name].cast(field.dataType).alias(field.name))
        elif field.dataType.typeName() == "boolean":
            columns.append(F.lit(False).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return missing.select(*columns)


def add_missing_properties(
    properties: DataFrame, wanted: DataFrame, flag: str | None = None, by: str | None = None
) -> DataFrame:
    """Properties that only configuration mentions (model_id, entity_key, name), once each; `flag`
    names a column that is true for the added ones, `by` the column both tables are bucketed by."""
    wanted = wanted.select(*ENTITY, "name").distinct()
    missing = wanted.join(properties.select(*ENTITY, "name"), [*ENTITY, "name"], "left_anti")
    added = _guessed(properties, missing, by)
    if flag is None:
        return properties.unionByName(added)
    return properties.withColumn(flag, F.lit(False)).unionByName(added.withColumn(flag, F.lit(True)))


def materialize_missing(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities that only configuration mentions (model_id, name), once each."""
    wanted = wanted.select("model_id", "name").distinct()
    missing = wanted.join(entities.select("model_id", "name"), ["model_id", "name"], "left_anti")
    columns = []
    for field in entities.schema.fields:
        if field.name in ("model_id", "name"):
            columns.append(F.col(field.name))
        elif field.name == "entity_key":
            columns.append(F.col("name").alias("entity_key"))
        elif field.dataType.typeName() == "boolean":
            columns.append(F.lit(False).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return entities.unionByName(missing.select(*columns))


def priority_union(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """All of the left table and those rows of the right one whose key the left lacks."""
    return left.unionByName(right.join(left.select(*key), key, "left_anti"))
