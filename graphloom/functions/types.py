"""Expressions over described types: columns that hold type names as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_column, let
from .paths import last_segment

# Names of the described value types, compared without case.
VALUE_TYPES = [
    "int", "Int32", "Int64", "long", "bool", "Boolean", "Guid", "DateTime", "DateTimeOffset",
    "TimeSpan", "DateOnly", "TimeOnly", "Uri", "decimal", "double", "float", "Single", "short",
    "byte", "sbyte", "ushort", "uint", "UInt32", "ulong", "UInt64", "char",
]

# Storage column type to described type, compared without case.
STORAGE_TYPES = {
    "decimal": "decimal",
    "numeric": "decimal",
    "money": "decimal",
    "smallmoney": "decimal",
    "int": "int",
    "integer": "int",
    "bigint": "long",
    "smallint": "short",
    "tinyint": "byte",
    "bit": "bool",
    "uniqueidentifier": "Guid",
    "float": "double",
    "real": "float",
    "datetime": "DateTime",
    "datetime2": "DateTime",
    "smalldatetime": "DateTime",
    "datetimeoffset": "DateTimeOffset",
    "date": "DateOnly",
    "time": "TimeOnly",
}

# Generic collections that make a member a to-many navigation.
NAVIGATION_COLLECTIONS = ["ICollection", "IList", "List", "HashSet", "ISet", "IEnumerable"]

# Namespace roots of system types, and system type names that count when a
# type has no namespace.
SYSTEM_NAMESPACES = ["System", "Microsoft.Extensions"]
WELL_KNOWN_TYPES = [
    "List", "Dictionary", "IEnumerable", "ICollection", "IList", "IDictionary", "HashSet", "Queue",
    "Stack", "LinkedList", "SortedSet", "SortedList", "SortedDictionary", "Task", "ValueTask",
    "Nullable", "Lazy", "DateTime", "DateTimeOffset", "TimeSpan", "Guid", "Uri", "Decimal", "Byte",
    "SByte", "Int16", "UInt16", "Int32", "UInt32", "Int64", "UInt64", "Single", "Double", "Char",
    "Boolean", "Object", "String", "Array", "Delegate", "MulticastDelegate", "Enum", "ValueType",
    "Exception",
]

# Keywords of the built-in types.
BUILT_IN_TYPES = [
    "bool", "byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "nint", "nuint",
    "char", "float", "double", "decimal", "string", "object", "void",
]

# Name parts by which a generic type counts as a collection, and the system
# collections whose names hold none of them.
COLLECTION_NAME_PARTS = ["List", "Collection", "IEnumerable", "Array", "Set"]
OTHER_COLLECTIONS = ["Dictionary", "IDictionary", "Queue", "Stack", "SortedDictionary"]

_IDENTIFIER = r"[\p{L}_][\p{L}\p{Nd}_.]*"


def logical_type(storage_type: Column | str) -> Column:
    """Described type of a storage type such as `decimal(18,2)`; NULL when unknown."""
    keyword = F.lower(F.regexp_extract(as_column(storage_type), r'^\s*"*([\p{L}\p{Nd}]*)', 1))
    table = F.create_map(*[F.lit(x) for pair in STORAGE_TYPES.items() for x in pair])
    return F.try_element_at(table, keyword)


def _int_group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def decimal_spec(storage_type: Column | str) -> Column:
    """struct(precision, scale) of `decimal(p, s)`; both set or both NULL."""
    text = as_column(storage_type)
    pattern = r"decimal\((\d+),\s*(\d+)\)"
    precision, scale = _int_group(text, pattern, 1), _int_group(text, pattern, 2)
    both = precision.isNotNull() & scale.isNotNull()
    return F.struct(F.when(both, precision).alias("precision"), F.when(both, scale).alias("scale"))


def length_spec(storage_type: Column | str) -> Column:
    """The number in parentheses, as in `nvarchar(200)`."""
    return _int_group(as_column(storage_type), r"\((\d+)\)", 1)


def strip_nullable(type_text: Column | str) -> Column:
    return F.regexp_replace(as_column(type_text), r"\?+$", "")


def is_value_type(type_text: Column | str) -> Column:
    name = F.lower(last_segment(strip_nullable(type_text)))
    return name.isin([t.lower() for t in VALUE_TYPES])


def guess_type(name: Column | str) -> Column:
    """Type of a property known by name only."""
    return F.when(F.lower(as_column(name)).endswith("id"), "Guid").otherwise("string")


def parse_int(text: Column | str) -> Column:
    text = F.trim(as_column(text))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def parse_required(argument: Column | str) -> Column:
    argument = as_column(argument)
    return F.coalesce(argument, F.lit("")).isin("") | (F.lower(argument) == "true")


def parse_precision(argument: Column | str, old_scale: Column | str) -> Column:
    """struct(precision, scale) of "p[, s]"; NULL struct when p is not an integer."""
    parts = F.split(as_column(argument), ",")
    precision = parse_int(F.get(parts, 0))
    scale = F.coalesce(parse_int(F.get(parts, 1)), as_column(old_scale))
    return F.when(precision.isNotNull(), F.struct(precision.alias("precision"), scale.alias("scale")))


def _is_quoted(text: Column) -> Column:
    return (text.startswith('"') & text.endswith('"')) | (text.startswith("'") & text.endswith("'"))


def default_literal(argument: Column | str, constant: Column | str | None = None) -> Column:
    """Shown default value: quoted text verbatim, else the looked-up constant, else the last
    dotted part unless that part starts with a digit."""
    text = F.regexp_replace(as_column(argument), r"^\s+|\s+$", "")
    value = F.btrim(text, F.lit("\"'"))
    tail = last_segment(value)
    plain = F.when(value.contains(".") & tail.rlike(r"^[^\p{Nd}]"), tail).otherwise(value)
    if constant is not None:
        plain = F.coalesce(as_column(constant), plain)
    return F.when(_is_quoted(text), value).otherwise(plain)


def default_sql(argument: Column | str) -> Column:
    return F.btrim(as_column(argument), F.lit("\"' "))


def is_array(type_text: Column | str) -> Column:
    return strip_nullable(type_text).rlike(r"\[,*\]$")


def element_type(type_text: Column | str) -> Column:
    """Element of an array (innermost), of a navigation collection, or of a nullable; else the type."""
    names = "|".join(NAVIGATION_COLLECTIONS)

    def unwrap(text: Column) -> Column:
        collection = F.regexp_extract(text, rf"(?i)^(?:[\w.]*\.)?(?:{names})<(.+)>$", 1)
        nullable = F.regexp_extract(text, r"^(?:System\.)?Nullable<(.+)>$", 1)
        return (
            F.when(text.rlike(r"\[,*\]$"), F.regexp_replace(text, r"(\?|\[,*\])+$", ""))
            .when(collection != "", strip_nullable(F.trim(collection)))
            .when(nullable != "", strip_nullable(F.trim(nullable)))
            .otherwise(text)
        )

    return let(strip_nullable(F.trim(as_column(type_text))), unwrap)


def is_to_many(type_text: Column | str) -> Column:
    """True for arrays and navigation collections."""
    text = strip_nullable(F.trim(as_column(type_text)))
    names = "|".join(NAVIGATION_COLLECTIONS)
    return is_array(text) | text.rlike(rf"(?i)^([\w.]*\.)?({names})<.+>$")


def in_system_namespace(namespace: Column | str) -> Column:
    roots = "|".join(n.replace(".", r"\.") for n in SYSTEM_NAMESPACES)
    return as_column(namespace).rlike(rf"^({roots})(\.|$)")


def is_system_type(namespace: Column | str, name: Column | str) -> Column:
    """System namespace, built-in type, or a well-known name without a namespace."""
    namespace, name = F.coalesce(as_column(namespace), F.lit("")), as_column(name)
    return (
        in_system_namespace(namespace)
        | ((namespace == "") & name.isin(BUILT_IN_TYPES))
        | ((namespace == "") & name.isin(WELL_KNOWN_TYPES))
    )


def is_system_name(qualified: Column | str) -> Column:
    qualified = as_column(qualified)
    namespace = F.regexp_replace(qualified, r"\.?[^.]*$", "")
    return is_system_type(namespace, last_segment(qualified))


def generic_head(type_text: Column | str) -> Column:
    """Name before the first `<`; empty for types without arguments."""
    return F.regexp_extract(as_column(type_text), rf"^\s*({_IDENTIFIER})\s*<", 1)


def referenced_types(type_text: Column | str) -> Column:
    """Non-system types that a member type mentions: `Result<Order>` gives Result and Order,
    `List<Order>` only Order.  Arrays inside type arguments are not looked into."""
    text = F.regexp_replace(strip_nullable(F.trim(as_column(type_text))), r"(\?|\[,*\])+$", "")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({_IDENTIFIER}+)(?!\s*\[)"), 1))
    return F.filter(found, lambda t: ~is_system_name(t))


def is_collection_type(type_text: Column | str) -> Column:
    """True for arrays and for generic types whose name marks a collection."""
    head = last_segment(generic_head(type_text))
    marked = F.lit(False)
    for part in COLLECTION_NAME_PARTS:
        marked = marked | head.contains(part)
    return is_array(type_text) | marked | head.isin(OTHER_COLLECTIONS)


def member_cardinality(type_text: Column | str, target: Column | str) -> Column:
    """`*` for what a collection holds, `1` otherwise and for the container type itself."""
    type_text = as_column(type_text)
    is_container = ~is_array(type_text) & (generic_head(type_text) == as_column(target))
    return F.when(is_collection_type(type_text) & ~is_container, "*").otherwise("1")


def type_name(type_text: Column | str) -> Column:
    """Simple name of a type: no namespace, type arguments or nullable mark."""
    text = strip_nullable(F.trim(as_column(type_text)))
    return last_segment(F.trim(F.regexp_replace(text, r"<.*$", "")))


def is_entity_type(type_text: Column | str) -> Column:
    """True for types that may be entities: no `System` part in the namespace, no primitive,
    no array, and no well-known system name without a namespace."""
    primitives = [t.lower() for t in [*VALUE_TYPES, "string"]]

    def judge(qualified: Column) -> Column:
        namespace, name = F.regexp_replace(qualified, r"\.?[^.]*$", ""), last_segment(qualified)
        return let(
            F.struct(namespace.alias("namespace"), name.alias("name")),
            lambda t: ~(
                F.lower(t["name"]).isin(primitives)
                | F.array_contains(F.split(t["namespace"], r"\."), "System")
                | is_system_type(t["namespace"], t["name"])
            ),
        )

    # Type arguments fall away, array marks stay and are told apart here.
    qualified = F.trim(F.regexp_replace(strip_nullable(F.trim(as_column(type_text))), r"<.*>", ""))
    return let(qualified, lambda q: ~q.rlike(r"\[,*\]$") & judge(q))


def is_navigation(type_text: Column | str) -> Column:
    """True for references to and collections of entity types; arrays and collections of
    primitives stay scalar columns."""
    return ~is_array(type_text) & is_entity_type(element_type(type_text))


def is_nullable(type_text: Column | str) -> Column:
    return as_column(type_text).rlike(r"\?\s*$") | as_column(type_text).rlike(r"^(System\.)?Nullable<")
