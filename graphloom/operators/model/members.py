"""Declared members of entity classes split into scalar properties and navigations.

members: model_id, entity_key, level (0 for the class itself, 1 for its base, ...), ordinal,
name, type, is_static, is_indexer, has_setter, is_required, max_length, column_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.types import (
    decimal_spec,
    element_type,
    is_navigation,
    is_nullable,
    is_to_many,
    is_value_type,
    type_name,
)
from ...schemas import PROPERTIES, conform
from ..numbering import first_wins, number_rows

MEMBER = ["model_id", "entity_key", "name"]


def scalar_members(members: DataFrame) -> DataFrame:
    """Members that are columns: instance, settable, no indexer, no navigation.  Along the
    base chain the most derived declaration of a name wins."""
    usable = ~F.col("is_static") & ~F.col("is_indexer") & F.col("has_setter") & ~is_navigation("type")
    return first_wins(members.filter(usable), MEMBER, ["level", "ordinal"])


def describe_members(members: DataFrame) -> DataFrame:
    """Property rows of scalar members: required unless nullable, lengths and decimal sizes
    where declared."""
    spec = decimal_spec("column_type")
    # Members of the class itself come before those of its bases.
    numbered = number_rows(scalar_members(members).drop("seq"), ["model_id", "entity_key"], ["level", "ordinal", "name"])
    described = numbered.select(
        "model_id",
        "entity_key",
        F.col("seq").alias("ordinal"),
        "name",
        "type",
        (~is_nullable("type") | F.col("is_required")).alias("is_required"),
        F.col("is_required").alias("is_explicitly_required"),
        is_value_type("type").alias("is_value_type"),
        "max_length",
        spec["precision"].alias("precision"),
        spec["scale"].alias("scale"),
    )
    return conform(described, PROPERTIES)


def navigation_members(members: DataFrame) -> DataFrame:
    """Navigations that the class itself declares (model_id, ordinal, entity, nav, target,
    is_collection, is_nullable); those of its bases do not count."""
    own = members.filter((F.col("level") == 0) & is_navigation("type"))
    return own.select(
        "model_id",
        "ordinal",
        F.col("entity_key").alias("entity"),
        F.col("name").alias("nav"),
        type_name(element_type("type")).alias("target"),
        is_to_many("type").alias("is_collection"),
        is_nullable("type").alias("is_nullable"),
    )
