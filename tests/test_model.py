"""Schema-model operators."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from graphloom.functions.types import STORAGE_TYPES, VALUE_TYPES
from graphloom.operators.model import keys as MK
from graphloom.operators.model import nested as MN
from graphloom.operators.model import overrides as MV
from graphloom.operators.model import owned as MO
from graphloom.operators.model import profile as MP
from graphloom.operators.model import relationships as MR
from graphloom.plans import lines as L
from graphloom.schemas import ENTITIES, PROPERTIES, RELATIONSHIPS


@pytest.fixture
def model(spark):
    """(entities, properties) from {entity: {property: options}}; options of an entity start with @."""

    def build(shape, model_id="m"):
        entities, properties = [], []
        for key, spec in shape.items():
            spec = dict(spec)
            e = {f.name: None for f in ENTITIES.fields} | {"is_join": False, "is_owned": False, "is_collection": False}
            e |= {"model_id": model_id, "entity_key": key, "name": key}
            e |= {k[1:]: spec.pop(k) for k in list(spec) if k.startswith("@")}
            entities.append(tuple(e[f.name] for f in ENTITIES.fields))
            for i, (name, options) in enumerate(spec.items()):
                p = {f.name: (False if isinstance(f.dataType, T.BooleanType) else None) for f in PROPERTIES.fields}
                p |= {"model_id": model_id, "entity_key": key, "ordinal": i, "name": name, "type": "int"} | options
                p["is_value_type"] = options.get("is_value_type", p["type"].rstrip("?").lower() in {v.lower() for v in VALUE_TYPES})
                properties.append(tuple(p[f.name] for f in PROPERTIES.fields))
        return spark.createDataFrame(entities, ENTITIES).coalesce(1), spark.createDataFrame(properties, PROPERTIES).coalesce(1)

    return build


@pytest.fixture
def navs(spark):
    def build(listed):
        data = [("m", i, e, n, t, many, null) for i, (e, n, t, many, null) in enumerate(listed)]
        schema = "model_id string, ordinal long, entity string, nav string, target string, is_collection boolean, is_nullable boolean"
        return spark.createDataFrame(data, schema).coalesce(1)

    return build


@pytest.fixture
def rels(spark):
    def build(listed):
        schema = T.StructType([*RELATIONSHIPS.fields, T.StructField("ordinal", T.LongType())])
        return spark.createDataFrame([("m", *r, i) for i, r in enumerate(listed)], schema).coalesce(1)

    return build


def keyed(properties, flag="is_pk"):
    return rows(properties.filter(flag), "entity_key", "name")


def test_primary_keys(model):
    entities, properties = model({"User": {"Id": {}, "UserId": {}, "Name": {}}, "Tag": {"Code": {"is_pk": True}}})
    # Both Id and <Entity>Id make a composite key by convention.
    assert keyed(MK.primary_keys(entities, properties)) == [("Tag", "Code"), ("User", "Id"), ("User", "UserId")]


def test_primary_key_fallback(model):
    entities, properties = model(
        {"User": {"userid": {}, "ID": {}}, "Post": {"PostId": {}, "Title": {}}, "Tag": {"Code": {"is_pk": True}, "Id": {}}, "Log": {"At": {}}}
    )
    assert keyed(MK.primary_key_fallback(entities, properties)) == [("Post", "PostId"), ("Tag", "Code"), ("User", "ID")]


def test_foreign_keys(model, navs):
    entities, properties = model(
        {"Post": {"Id": {}, "AUTHORID": {}, "UserId": {}, "EditorId": {}}, "User": {"Id": {}, "PostId": {}}, "Tag": {"PostId": {}, "UserId": {}}}
    )
    links = navs([("Post", "Author", "User", False, False), ("Post", "Tags", "Tag", True, False), ("Post", "X", "Gone", False, False)])
    assert keyed(MK.foreign_keys(entities, properties, links), "is_fk") == [("Post", "AUTHORID"), ("Post", "UserId"), ("Tag", "PostId")]


def test_declared_foreign_key_is_created(model, spark):
    _, properties = model({"Post": {"Id": {}}})
    declared = spark.createDataFrame([("m", "Post", "OwnerId"), ("m", "Post", "Id"), ("m", "Post", "Slug")], "model_id string, entity_key string, name string")
    found = MK.declared_foreign_keys(properties, declared)
    assert rows(found, "name", "type", "is_fk", "is_type_inferred") == [("Id", "int", True, False), ("OwnerId", "Guid", True, True), ("Slug", "string", True, True)]


def test_inferred_relationships(model, navs):
    entities, _ = model({n: {} for n in ("Author", "Book", "Profile", "Category", "Review")} | {"Money": {"@is_owned": True}})
    links = navs(
        [
            ("Author", "Books", "Book", True, False),
            ("Book", "Authors", "Author", True, False),
            ("Author", "Profile", "Profile", False, True),
            ("Profile", "Author", "Author", False, False),
            ("Book", "Reviews", "Review", True, False),
            ("Review", "Book", "Book", False, False),
            ("Category", "Parent", "Category", False, True),
            ("Book", "Price", "Money", False, False),
            ("Book", "Gone", "Nowhere", False, False),
        ]
    )
    assert rows(MR.infer_relationships(entities, links), "src", "dst", "rel_type", "is_required") == [
        ("Author", "Book", "ManyToMany", True),
        ("Author", "Profile", "OneToOne", False),
        ("Book", "Review", "OneToMany", True),
        ("Category", "Category", "OneToMany", False),
    ]


def test_self_reference_with_inverse_is_one_to_one(model, navs):
    entities, _ = model({"Node": {}})
    links = navs([("Node", "Next", "Node", False, True), ("Node", "Previous", "Node", False, True)])
    assert rows(MR.infer_relationships(entities, links), "rel_type") == [("OneToOne",)]


def test_existing_relationships_come_first(model, navs, rels):
    entities, _ = model({"A": {}, "B": {}})
    existing = rels([("B", "A", "OneToOne", False)])
    links = navs([("A", "B", "B", False, False), ("B", "A", "A", False, False)])
    assert rows(MR.infer_relationships(entities, links, existing), "src", "dst", "is_required") == [("B", "A", False)]


def test_declared_relationships(spark):
    declared = spark.createDataFrame(
        [
            ("m", 1, "Blog", "HasMany", "Post", "WithOne", None),
            ("m", 2, "Post", "HasOne", "Author", "WithMany", None),
            ("m", 3, "User", "HasOne", "Card", "WithOne", None),
            ("m", 4, "Tag", "HasMany", "Post", "WithMany", True),
            ("m", 5, "Post", "HasOne", "Blog", "WithMany", False),
            ("m", 6, "Post", "HasOne", "Blog", None, None),
        ],
        "model_id string, ordinal int, entity string, has string, target string, with string, explicit_required boolean",
    )
    assert rows(MR.declared_relationships(declared), "src", "dst", "rel_type", "is_required") == [
        ("Author", "Post", "OneToMany", True),
        ("Blog", "Post", "OneToMany", False),
        ("Blog", "Post", "OneToMany", True),
        ("Tag", "Post", "ManyToMany", True),
        ("User", "Card", "OneToOne", False),
    ]


def test_relationship_keys_and_dedupe(rels):
    listed = rels(
        [
            ("A", "B", "OneToOne", True),
            ("B", "A", "OneToOne", False),
            ("A", "B", "OneToMany", True),
            ("B", "A", "OneToMany", True),
            ("A", "B", "OneToMany", False),
            ("C", "D", "ManyToMany", False),
        ]
    )
    found = rows(MR.dedupe_relationships(listed), "src", "dst", "rel_type", "is_required")
    assert found == [("A", "B", "OneToMany", True), ("B", "A", "OneToMany", True), ("C", "D", "ManyToMany", False)]


def test_entities_are_deduped_by_effective_key(spark):
    data = [("m", "", "A", 2, "x"), ("m", "A", "A", 1, "y"), ("m", "B", "A", 3, "z")]
    df = spark.createDataFrame(data, "model_id string, entity_key string, name string, ordinal int, note string")
    assert rows(MR.dedupe_entities(df), "name", "note") == [("A", "y"), ("A", "z")]


def test_many_to_many_decomposition(model, rels):
    entities, properties = model({"Book": {"Id": {"is_pk": True, "type": "Guid"}}, "Author": {"Name": {}}, "Note": {}})
    listed = rels([("Book", "Author", "ManyToMany", False), ("Author", "Book", "OneToMany", False)])
    e, p, r = MR.decompose_many_to_many(entities, properties, listed)
    assert rows(e.filter("is_join"), "name", "entity_key") == [("AuthorBook", "AuthorBook")]
    assert rows(p.filter("entity_key = 'AuthorBook'"), "ordinal", "name", "type", "is_pk", "is_fk") == [(1, "BookId", "Guid", True, True), (2, "AuthorId", "int", True, True)]
    # The other relationship of the pair survives.
    assert rows(r, "src", "dst", "rel_type", "is_required") == [
        ("Author", "AuthorBook", "OneToMany", True), ("Author", "Book", "OneToMany", False), ("Book", "AuthorBook", "OneToMany", True),
    ]


def test_model_diff(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    right = spark.createDataFrame([("a",), ("c",)], "x string")
    assert rows(MR.model_diff(left, right)) == [("a", "left", 1), ("b", "left", 1), ("c", "right", 1)]
    assert rows(MR.model_diff(left, left)) == []


# ---- overrides ----------------------------------------------------------------------------


def calls_table(spark, listed):
    data = [("m", e, p, i, a, v) for i, (e, p, a, v) in enumerate(listed)]
    return spark.createDataFrame(data, "model_id string, entity_key string, property string, seq int, attribute string, value string").coalesce(1)


def test_override_guards(model, spark):
    _, properties = model({"E": {"BuyerId": {"type": "Guid", "is_type_inferred": True}, "Fixed": {"type": "Guid"}, "Text": {"type": "string"}}})
    calls = calls_table(
        spark,
        [
            ("E", "BuyerId", "max_length", "256"),
            ("E", "Fixed", "max_length", "9"),
            ("E", "Text", "column_type", "nvarchar(200)"),
            ("E", "Price", "column_type", "decimal(18,2)"),
            ("E", "Price", "max_length", "7"),
            ("E", "Count", "type", "long"),
            ("E", "Text", "required", ""),
            ("E", "Text", "required", "false"),
            ("E", "Price", "precision", "9"),
            ("E", "Text", "default", "Kind.Open"),
            ("E", "Fixed", "key", ""),
        ],
    )
    found = {r.name: r for r in MV.apply_overrides(properties, calls).collect()}
    assert (found["BuyerId"].type, found["BuyerId"].max_length, found["BuyerId"].is_value_type) == ("string", 256, False)
    assert (found["Fixed"].type, found["Fixed"].max_length, found["Fixed"].is_pk) == ("Guid", 9, True)
    assert (found["Text"].max_length, found["Text"].is_required, found["Text"].is_explicitly_required, found["Text"].default_value) == (200, False, True, "Open")
    assert (found["Price"].type, found["Price"].is_type_inferred, found["Price"].precision, found["Price"].scale, found["Price"].max_length) == ("decimal", False, 9, 2, 7)
    assert (found["Count"].type, found["Count"].is_type_inferred) == ("long", False)


def replay(prop, calls):
    """One property, one call after the other."""
    state = dict(prop)
    for attribute, value in calls:
        if attribute == "type":
            state["type"] = value
        elif attribute == "max_length":
            state["max_length"] = int(value)
            if state["guessed"] and state["type"] != "string":
                state["type"] = "string"
        elif attribute == "column_type":
            keyword = value.split("(")[0].lower()
            if keyword in STORAGE_TYPES and (state["guessed"] or state["type"] == "string"):
                state["type"], state["guessed"] = STORAGE_TYPES[keyword], False
            digits = value[value.index("(") + 1 : -1].split(",") if "(" in value else []
            if keyword == "decimal" and len(digits) == 2:
                state["precision"], state["scale"] = int(digits[0]), int(digits[1])
            elif state["max_length"] is None and state["type"] == "string" and len(digits) == 1:
                state["max_length"] = int(digits[0])
    return state


def test_overrides_match_a_replay(model, spark):
    random.seed(9)
    shape, listed, expected = {}, [], {}
    for i in range(150):
        guessed = random.random() < 0.5
        kind = random.choice(["Guid", "string"]) if guessed else random.choice(["string", "int", "Guid"])
        shape[f"E{i}"] = {"P": {"type": kind, "is_type_inferred": guessed}}
        calls = [
            random.choice([("type", "string"), ("type", "long"), ("max_length", "5"), ("column_type", "nvarchar(80)"), ("column_type", "decimal(9,3)"), ("column_type", "datetime2(7)"), ("column_type", "text")])
            for _ in range(random.randint(0, 6))
        ]
        listed += [(f"E{i}", "P", a, v) for a, v in calls]
        start = {"type": kind, "guessed": guessed, "max_length": None, "precision": None, "scale": None}
        expected[f"E{i}"] = (replay(start, calls), calls)
    _, properties = model(shape)
    for r in MV.apply_overrides(properties, calls_table(spark, listed)).collect():
        want, calls = expected[r.entity_key]
        got = {"type": r.type, "guessed": r.is_type_inferred, "max_length": r.max_length, "precision": r.precision, "scale": r.scale}
        assert got == want, (r.entity_key, shape[r.entity_key], calls)


def test_constant_lookup(spark):
    constants = spark.createDataFrame([("Shop.Kind", "Open", "1"), ("Kind", "Open", "2"), ("Limits", "Max", "9")], "type string, member string, value string")
    calls = calls_table(spark, [("E", "P", "default", v) for v in ("Shop.Kind.Open", "Kind.Open", "Max", '"Max"', "(int)Limits.Max", "Gone.Max2")])
    found = rows(MV.lookup_constants(calls, constants), "seq", "constant")
    assert found == [(0, "1"), (1, "2"), (2, "9"), (3, None), (4, "9"), (5, None)]


# ---- owned entities -----------------------------------------------------------------------


def invoice():
    return {
        "Invoice": {"Id": {"is_pk": True}, "Number": {"type": "string", "is_required": True}},
        "Invoice.ShipTo": {"@name": "Address", "@is_owned": True, "@owner_key": "Invoice", "@nav": "ShipTo", "Street": {"type": "string"}, "ZipCode": {"type": "string"}, "InvoiceId": {"is_pk": True, "is_fk": True}},
        "Invoice.ShipTo.Geo": {"@name": "GeoPoint", "@is_owned": True, "@owner_key": "Invoice.ShipTo", "@nav": "Geo", "Latitude": {"type": "decimal", "precision": 9, "scale": 6}, "Longitude": {"type": "decimal"}},
        "Invoice.BillTo": {"@name": "Address", "@is_owned": True, "@owner_key": "Invoice", "@nav": "BillTo", "@table_name": "BillTo", "Street": {"type": "string"}, "InvoiceId": {"is_pk": True, "is_fk": True}},
        "Invoice.Lines": {"@name": "Line", "@is_owned": True, "@owner_key": "Invoice", "@nav": "Lines", "@is_collection": True, "Amount": {"type": "decimal", "precision": 18, "scale": 2}},
        "Invoice.Empty": {"@name": "Empty", "@is_owned": True, "@owner_key": "Invoice", "@nav": "Empty"},
        "Lost.X": {"@name": "X", "@is_owned": True, "@owner_key": "Lost", "@nav": "X"},
    }


def test_owned_tables(model):
    entities, _ = model(invoice())
    found = dict(rows(MO.resolve_owned_tables(entities), "entity_key", "table_name"))
    assert found == {
        "Invoice": None, "Invoice.ShipTo": "Invoice", "Invoice.ShipTo.Geo": "Invoice", "Invoice.BillTo": "BillTo",
        "Invoice.Lines": "Invoice_Lines", "Invoice.Empty": "Invoice", "Lost.X": None,
    }


def drawn(model, spark, mode):
    entities, properties = model(invoice())
    entities = MO.resolve_owned_tables(entities)
    properties = MO.strip_shadow_keys(entities, properties)
    none = spark.createDataFrame([], RELATIONSHIPS)
    lines = L.numbered(L.erd_lines(entities, properties, none, mode, title=F.lit("Ctx")))
    return [r.line for r in lines.orderBy("seq").collect()]


def test_mirror_diagram(model, spark):
    assert drawn(model, spark, "mirror") == [
        "```mermaid", "---", "title: Ctx", "---", "erDiagram",
        "  Address {", "    int InvoiceId PK,FK", "    string Street", "  }",
        "  Empty {", "  }",
        "  Invoice {", "    int Id PK", '    string Number "required"',
        '    decimal ShipTo_Geo_Latitude "precision(9,6)"', "    decimal ShipTo_Geo_Longitude", "    string ShipTo_Street", "    string ShipTo_ZipCode", "  }",
        "  Line {", '    decimal Amount "precision(18,2)"', "  }",
        "  X {", "  }",
        '  Invoice ||--|| Address : "BillTo"', '  Invoice ||--|| Empty : "Empty"', '  Invoice ||--o{ Line : "Lines"',
        "```",
    ]


def test_classic_diagram(model, spark):
    lines = drawn(model, spark, "classic")
    assert [x for x in lines if x.endswith("{") and "--" not in x] == ["  Invoice_BillTo {", "  Invoice_ShipTo {", "  Empty {", "  GeoPoint {", "  Invoice {", "  Line {", "  X {"]
    assert [x for x in lines if "--" in x and x != "---"] == [
        '  Invoice ||--|| Invoice_BillTo : "BillTo"', '  Invoice ||--|| Invoice_ShipTo : "ShipTo"', '  Invoice ||--|| Empty : "Empty"',
        '  Invoice ||--o{ Line : "Lines"', '  Invoice_ShipTo ||--|| GeoPoint : "Geo"',
    ]


def test_owner_rings_end(model):
    entities, properties = model(
        {"A": {"@is_owned": True, "@owner_key": "B", "@nav": "b", "X": {}}, "B": {"@is_owned": True, "@owner_key": "A", "@nav": "a", "Y": {}}, "C": {"Z": {}}}
    )
    entities = entities.withColumn("table_name", F.lit("T"))
    shown, columns = MO.drawn_boxes(entities, properties)
    assert rows(shown.filter("not is_inlined"), "name") == [("C",)]
    assert rows(columns, "name") == [("Z",)]


def test_capture_owned(model, spark):
    entities, _ = model({"Order": {}})
    facts = spark.createDataFrame(
        [("m", "Order", "Ship", "Address", False, 1), ("m", "Order.Ship", "Geo", None, False, 2), ("m", "Order", "Ship", "Address", False, 1), ("m", "Gone", "X", "Y", False, 1), ("m", "Gone.X", "Z", "Y", False, 2)],
        "model_id string, owner_key string, nav string, name string, is_collection boolean, level int",
    )
    found = MO.capture_owned(entities, facts)
    assert rows(found, "entity_key", "name", "is_owned") == [("Order", "Order", False), ("Order.Ship", "Address", True), ("Order.Ship.Geo", "Geo", True)]


# ---- schemas and nested data --------------------------------------------------------------


NESTED = "Id int not null, Price decimal(18,2), Ship struct<Street string, Geo struct<Lat double>>, Lines array<struct<Sku string, Parts array<struct<N int>>>>, Tags array<string>"


@pytest.fixture
def nested(spark):
    data = [(1, None, ("s", (1.5,)), [("a", [(1,), (2,)]), ("b", [])], ["t"]), (2, None, ("q", (2.5,)), [], [])]
    return spark.createDataFrame(data, NESTED)


def test_catalog_entities(spark, nested):
    entities, properties = MN.catalog_entities(spark, {"Order": nested})
    assert rows(entities, "entity_key", "is_owned", "is_collection") == [
        ("Order", False, False), ("Order.Lines", True, True), ("Order.Lines.Parts", True, True), ("Order.Ship", True, False), ("Order.Ship.Geo", True, False),
    ]
    described = rows(properties.filter("entity_key = 'Order'"), "name", "type", "is_required", "precision", "scale")
    assert described == [("Id", "int", True, None, None), ("Price", "decimal", False, 18, 2), ("Tags", "List<string>", False, None, None)]


def test_model_choice(model):
    entities = model({"A": {}}, "one")[0].unionByName(model({"B": {}}, "two")[0])
    assert rows(MN.list_models(entities)) == [("one",), ("two",)]
    assert MN.only_model(entities, "two") == "two"
    for name in (None, "three"):
        with pytest.raises(ValueError):
            MN.only_model(entities, name)
    with pytest.raises(ValueError):
        MN.only_model(entities.filter("false"))


def test_flatten_and_split(nested):
    assert MN.flatten_nested(nested).columns == ["Id", "Price", "Ship_Street", "Ship_Geo_Lat", "Lines", "Tags"]
    tables = MN.split_nested(nested, "Order", ["Id"])
    assert set(tables) == {"Order", "Order_Lines", "Order_Lines_Parts"}
    assert rows(tables["Order_Lines"]) == [(1, 0, "a"), (1, 1, "b")]
    assert rows(tables["Order_Lines_Parts"]) == [(1, 0, 0, 1), (1, 0, 1, 2)]


def test_split_and_join_nested(spark, nested):
    empty = nested.filter("false")
    for data in (nested, nested.unionByName(nested.withColumn("Id", F.col("Id") + 7)), empty):
        tables = MN.split_nested(data, "Order", ["Id"])
        back = MN.join_nested(tables, "Order", ["Id"], data.schema, 10)
        assert back.columns == data.columns
        assert sorted(back.collect(), key=str) == sorted(data.collect(), key=str)
    with pytest.raises(ValueError, match="more than the 1 stated"):
        MN.join_nested(MN.split_nested(nested, "Order", ["Id"]), "Order", ["Id"], nested.schema, 1)


def test_nested_parts_and_odd_children(spark):
    schema = "k int, at int, x string, m map<string,int>"
    data = [(1, i, f"x{i:02d}", {"a": i}) for i in range(25)] + [(2, 0, None, None), (None, 3, "n", None), (None, 3, "n", None)]
    children = spark.createDataFrame(data[::-1], schema)
    parts = {(r.k, r.part): r.items for r in MN.nested_parts(children, ["k"], "at", "items", 10).collect()}
    assert {k: len(v) for k, v in parts.items()} == {(1, 0): 10, (1, 1): 10, (1, 2): 5, (2, 0): 1, (None, 0): 2}
    assert [r.x for p in range(3) for r in parts[1, p]] == [f"x{i:02d}" for i in range(25)]
    parents = spark.createDataFrame([(1, "one"), (3, "bare"), (None, "null")], "k int, name string")
    found = {r["name"]: [i.x for i in r["items"]] for r in MN.nest_children(parents, children, ["k"], "at", "items", 25).collect()}
    assert found == {"one": [f"x{i:02d}" for i in range(25)], "bare": [], "null": ["n", "n"]}
    assert MN.nested_parts(children.filter("false"), ["k"], "at", "items").count() == 0


def test_members_split_into_columns_and_navigations(spark):
    from graphloom.operators.model import members as MM

    def member(level, ordinal, name, kind, static=False, setter=True, required=False, length=None, stored=None):
        return ("m", "Post", level, ordinal, name, kind, static, False, setter, required, length, stored)

    members = spark.createDataFrame(
        [
            member(0, 1, "Id", "int"),
            member(0, 2, "Title", "string?", required=True, length=80),
            member(0, 3, "Author", "Shop.User?"),
            member(0, 4, "Tags", "List<Tag>"),
            member(0, 5, "Labels", "List<string>"),
            member(0, 6, "Count", "int", static=True),
            member(0, 7, "Total", "int", setter=False),
            member(1, 1, "Id", "Guid"),
            member(1, 2, "Price", "decimal", stored="decimal(18,2)"),
            member(1, 3, "Owner", "User"),
        ],
        "model_id string, entity_key string, level int, ordinal int, name string, type string, is_static boolean, is_indexer boolean, has_setter boolean, is_required boolean, max_length int, column_type string",
    )
    found = rows(MM.describe_members(members), "name", "type", "is_required", "is_explicitly_required", "max_length", "precision", "scale")
    assert found == [
        ("Id", "int", True, False, None, None, None), ("Labels", "List<string>", True, False, None, None, None),
        ("Price", "decimal", True, False, None, 18, 2), ("Title", "string?", True, True, 80, None, None),
    ]
    assert rows(MM.navigation_members(members), "nav", "target", "is_collection", "is_nullable") == [("Author", "User", False, True), ("Tags", "Tag", True, False)]


def test_entity_model_orders(model, spark):
    """Owned tables, table names, the key fallback and inference come in the stated order."""
    from graphloom.plans.entity_model import Configuration, entity_model

    entities, properties = model({"Post": {"PostId": {}, "Title": {"type": "string"}}, "Blog": {"Id": {}}})
    navigations = spark.createDataFrame(
        [("m", 1, "Blog", "Posts", "Post", True, False), ("m", 2, "Blog", "Tags", "Tag", True, False), ("m", 3, "Tag", "Blogs", "Blog", True, False)],
        "model_id string, ordinal long, entity string, nav string, target string, is_collection boolean, is_nullable boolean",
    )
    config = Configuration(
        mentioned=spark.createDataFrame([("m", "Tag")], "model_id string, name string"),
        tables=spark.createDataFrame(
            [("m", "Post", 1, "old"), ("m", "Post", 9, "posts"), ("m", "Post.Meta", 3, "meta"), ("m", "Nobody", 4, "x")],
            "model_id string, entity_key string, seq long, table_name string",
        ),
        owned=spark.createDataFrame(
            [("m", "Post", "Meta", "Meta", False, 1), ("m", "Post", "Note", None, False, 1)],
            "model_id string, owner_key string, nav string, name string, is_collection boolean, level int",
        ),
        declarations=spark.createDataFrame(
            [("m", 5, "Blog", "HasMany", "Post", "WithOne", None)],
            "model_id string, ordinal int, entity string, has string, target string, with string, explicit_required boolean",
        ),
    )
    title = properties.filter("name = 'Title'")
    for shift in (1, -9):
        again = title.withColumn("ordinal", F.col("ordinal") + shift).withColumn("type", F.lit("Guid"))
        found, columns, links = entity_model(entities, properties.unionByName(again), navigations, config)
        assert rows(columns.filter("name = 'Title'"), "type") == [("string" if shift > 0 else "Guid",)]
    assert rows(found, "name", "table_name") == sorted(
        [("Blog", None), ("BlogTag", None), ("Meta", "meta"), ("Note", "posts"), ("Post", "posts"), ("Tag", None)], key=repr
    )
    assert rows(columns.filter("is_pk and entity_key in ('Post', 'Blog')"), "name") == [("Id",), ("PostId",)]
    assert rows(links, "src", "dst", "rel_type") == [("Blog", "BlogTag", "OneToMany"), ("Blog", "Post", "OneToMany"), ("Tag", "BlogTag", "OneToMany")]
    found, columns, links = entity_model(entities, properties, navigations, config, order="snapshot")
    assert rows(links, "src", "dst", "rel_type") == [("Blog", "Post", "OneToMany")] and rows(columns.filter("is_pk")) == []
    with pytest.raises(ValueError):
        entity_model(entities, properties, order="other")


def test_minimal_keys(spark):
    data = [(i % 4, i // 4, i if i else None, i % 2, 7) for i in range(12)]
    df = spark.createDataFrame(data, "a int, b int, gap int, half int, one int")
    assert rows(MP.minimal_keys(df, "t")) == [("t", "a,b")]
    assert rows(MP.minimal_keys(df, "t", most=1)) == []
    assert rows(MP.minimal_keys(df.select("one", "half").where("false"), "t")) == [("t", "half"), ("t", "one")]
    triple = spark.createDataFrame([(x, y, z) for x in range(2) for y in range(2) for z in range(2)], "x int, y int, z int")
    assert rows(MP.minimal_keys(triple, "t")) == [("t", "x,y,z")]


def test_inclusion_dependencies(spark):
    one = spark.createDataFrame([(1, "1", None), (2, "2", None), (None, "2", None)], "a int, s string, none int")
    many = spark.createDataFrame([(i, i % 3, *[0] * 70) for i in range(9)], "b long, c long, " + ", ".join(f"z{i} int" for i in range(70)))
    found = set(rows(MP.inclusion_dependencies({"one": one, "many": many})))
    assert ("one", "a", "many", "b") in found and ("one", "a", "many", "c") in found
    assert ("many", "z0", "many", "z69") in found and ("many", "z69", "many", "c") in found
    assert not any("s" in (r[1], r[3]) or "none" in (r[1], r[3]) for r in found)
    assert ("many", "b", "one", "a") not in found
    assert len(found) == 70 * 71 + 2 + 1  # constants among each other and in b and c - 70; a in b, c; c in b


def test_owner_tables_come_with_resolved_tables(spark):
    """Tables of owners are found once: folding and key stripping then need no second look-up."""
    data = [
        ("m", "A", "A", "T_A", False, None, None, False),
        ("m", "A.L", "L", None, True, "A", "L", True),
        ("m", "A.L.S", "S", None, True, "A.L", "S", False),
        ("m", "A.G", "G", "own", True, "A", "G", False),
        ("m", "A.G.S", "S", None, True, "A.G", "S", False),
    ]
    columns = "model_id string, entity_key string, name string, table_name string, is_owned boolean, owner_key string, nav string, is_collection boolean"
    raw = spark.createDataFrame(data, columns)
    both = MO.resolve_owned_tables(raw, owner_tables=True)
    found = {r["entity_key"]: (r["table_name"], r["owner_table"]) for r in both.collect()}
    assert found == {"A": ("T_A", None), "A.L": ("T_A_L", "T_A"), "A.L.S": ("T_A_L", "T_A_L"), "A.G": ("own", "T_A"), "A.G.S": ("own", "own")}
    assert {r["entity_key"]: r["table_name"] for r in MO.resolve_owned_tables(raw).collect()} == {k: v[0] for k, v in found.items()}


def test_repeated_sets_are_ruled_out_by_a_slice(spark):
    """A slice of the values shows repeats for certain; unique sets are never ruled out."""
    df = spark.range(4_000).select("id", (F.col("id") % 500).alias("a"), (F.col("id") % 7).alias("b"))
    assert MP._repeated_sets(df, [["a"], ["id"], ["a", "b"], ["b", "id"]], 4) == {0, 2}
    assert {r["columns"] for r in MP.minimal_keys(df, "t").collect()} == {"id"}


def test_shared_hashes_are_no_repeats(spark, monkeypatch):
    """Smallest keys move hashes; sets whose rows only share hashes are compared by their values."""
    df = spark.range(4_000).select("id", (F.col("id") % 500).alias("a"), F.floor(F.col("id") / 500).alias("b"), (F.col("id") % 7 * 0.0).alias("zero"))
    hashed = MP._hash_of
    assert {r["columns"] for r in MP.minimal_keys(df, "t").collect()} == {"id", "a,b"}
    monkeypatch.setattr(MP, "_hash_of", lambda fields, columns: hashed(fields, columns).bitwiseAND(F.lit(255)))
    assert MP._repeated_sets(df, [["id"], ["a"], ["a", "b"]]) == {1}
    assert {r["columns"] for r in MP.minimal_keys(df, "t").collect()} == {"id", "a,b"}
    assert MP._repeated_sets(df, [["a", "b"], ["b", "zero"]], 2, ["a", "b"]) == {1}
