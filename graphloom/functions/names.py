"""Identifier and label expressions for diagrams, and name-based rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_column, blank_to_null


def sanitize_graph_id(name: Column | str) -> Column:
    return F.translate(as_column(name), ".- ", "___")


def sanitize_type_id(name: Column | str) -> Column:
    marks = ".`<>[],+?: "
    return F.translate(as_column(name), marks, "_" * len(marks))


def quote_entity(name: Column | str) -> Column:
    name = as_column(name)
    return F.when(name.rlike(r"^[\p{L}\p{Nd}_]+$"), name).otherwise(F.concat(F.lit('"'), name, F.lit('"')))


def escape_label(label: Column | str) -> Column:
    return F.replace(as_column(label), F.lit('"'), F.lit("#quot;"))


def generic_tilde(type_text: Column | str) -> Column:
    return F.translate(as_column(type_text), "<>", "~~")


def diagram_type(type_text: Column | str) -> Column:
    """Type text of an entity property: no nullable or array marks, `~` for generics."""
    shown = F.translate(as_column(type_text), "<>?[]", "~~")
    return F.coalesce(blank_to_null(shown), F.lit("unknown"))


def flatten_newlines(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), r"\R", " ")


def warning_line(text: Column | str) -> Column:
    return F.concat(F.lit("%% WARNING: "), flatten_newlines(text))


def context_name(attribute: Column | str, class_name: Column | str) -> Column:
    """The declared context type, else the snapshot class name without its suffix."""
    stripped = F.replace(as_column(class_name), F.lit("ModelSnapshot"), F.lit(""))
    return F.coalesce(as_column(attribute), stripped)


def classify_node(name: Column | str, output_type: Column | str, test_flag: Column | str) -> Column:
    """Test by name or flag, else Executable by output type, else Library."""
    is_test = F.lower(as_column(name)).contains("test") | (F.lower(as_column(test_flag)) == "true")
    is_exe = F.lower(as_column(output_type)).contains("exe")
    return F.when(is_test, "Test").when(is_exe, "Executable").otherwise("Library")


def looks_like_interface(name: Column | str) -> Column:
    return as_column(name).rlike(r"^I\p{Lu}")


def is_conventional_key(prop: Column | str, entity: Column | str, declaring: Column | str | None = None) -> Column:
    """`Id`, `<Entity>Id` or `<DeclaringType>Id`, ignoring case."""
    prop = F.lower(as_column(prop))
    entity = as_column(entity)
    declaring = entity if declaring is None else as_column(declaring)
    return (
        (prop == "id")
        | (prop == F.concat(F.lower(entity), F.lit("id")))
        | (prop == F.concat(F.lower(declaring), F.lit("id")))
    )
