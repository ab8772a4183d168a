"""Schemas of the graph and model tables.  Every table is keyed by graph_id or model_id,
so one job works on a whole corpus of graphs or models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("graph_id", T.StringType(), False),
        T.StructField("node_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("version", T.StringType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("graph_id", T.StringType(), False),
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("edge_type", T.StringType(), False),
        T.StructField("label", T.StringType()),
        T.StructField("cardinality", T.StringType()),
    ]
)

ENTITIES = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("entity_key", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("table_name", T.StringType()),
        T.StructField("is_join", T.BooleanType(), False),
        T.StructField("is_owned", T.BooleanType(), False),
        T.StructField("owner_key", T.StringType()),
        T.StructField("nav", T.StringType()),
        T.StructField("is_collection", T.BooleanType(), False),
    ]
)

PROPERTIES = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("entity_key", T.StringType(), False),
        T.StructField("ordinal", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("is_pk", T.BooleanType(), False),
        T.StructField("is_fk", T.BooleanType(), False),
        T.StructField("is_required", T.BooleanType(), False),
        T.StructField("is_value_type", T.BooleanType(), False),
        T.StructField("is_explicitly_required", T.BooleanType(), False),
        T.StructField("is_type_inferred", T.BooleanType(), False),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("precision", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
        T.StructField("default_value", T.StringType()),
    ]
)

RELATIONSHIPS = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("rel_type", T.StringType(), False),
        T.StructField("is_required", T.BooleanType(), False),
    ]
)

# Node kinds in their sort order, and the kinds a breakdown always lists.
NODE_KINDS = ["Library", "Executable", "Test", "Other", "Package"]
BREAKDOWN_KINDS = ["Library", "Executable", "Test", "Other"]

# Edge types of dependency graphs and of type graphs.
PROJECT_REFERENCE = "ProjectReference"
PACKAGE_REFERENCE = "PackageReference"
TYPE_EDGE_KINDS = ["Inheritance", "Realization", "Association", "Dependency"]

# Relationship types in their sort order.
ONE_TO_ONE = "OneToOne"
ONE_TO_MANY = "OneToMany"
MANY_TO_MANY = "ManyToMany"
RELATIONSHIP_TYPES = [ONE_TO_ONE, ONE_TO_MANY, MANY_TO_MANY]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a table schema: missing nullable columns become NULL, missing flags false."""
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.BooleanType):
            columns.append(F.lit(False).alias(field.name))
        elif field.nullable:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"column {field.name!r} is required")
    return df.select(*columns)
