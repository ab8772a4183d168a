"""Column expressions, each over one small table."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from graphloom.functions import marks, names, paths, types
from graphloom.operators.model.owned import check_mode
from graphloom.plans.lines import check_format


@pytest.fixture
def apply(spark):
    def run(expression, values, schema="v string"):
        data = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, " + schema).coalesce(1)
        return [r.out for r in df.select("i", expression.alias("out")).orderBy("i").collect()]

    return run


def test_paths(apply):
    cases = [("/r/src/B", "../A/./A.csproj"), ("/r", "..\\..\\..\\x"), ("/r/a", "/abs/y"), ("rel", "z")]
    assert apply(paths.resolve_path("a", "b"), cases, "a string, b string") == ["/r/src/A/A.csproj", "/x", "/abs/y", "rel/z"]
    assert apply(paths.normalize_path("v"), ["a\\b/c"]) == ["a/b/c"]
    assert apply(paths.normalize_path("v", case_insensitive=True), ["a\\b"]) == ["A/B"]
    assert apply(paths.file_stem("v"), ["/a/My.Lib.csproj", "x"]) == ["My.Lib", "x"]
    assert apply(paths.extension("v"), ["/a.b/X.SLNX", "/a.b/x"]) == [".slnx", ""]
    assert apply(paths.last_segment("v"), ["a.b.C", "C"]) == ["C", "C"]
    assert apply(paths.parent_dir("v"), ["/a/b/c", "/a", "a"]) == ["/a/b", "/", ""]
    assert apply(paths.ancestors("v"), ["/a/b", "/"]) == [["/a/b", "/a", "/"], ["/"]]
    assert apply(paths.in_excluded_directory("v"), ["/a/BIN/x.cs", "/a/bin", "/binary/x", "/a/node_modules/b/c"]) == [True, False, False, True]


def test_ids_do_not_depend_on_separators(apply):
    first, second = apply(paths.path_id("v"), ["/a/b", "\\a\\b"])
    assert first == second and len(first) == 32
    assert apply(paths.path_id("v"), ["/A"]) != apply(paths.path_id("v"), ["/a"])


def test_node_kinds(apply):
    cases = [("App", "WinExe", ""), ("App", "Library", None), ("MyTESTS", "Exe", ""), ("App", "Exe", "TRUE")]
    assert apply(names.classify_node("n", "o", "f"), cases, "n string, o string, f string") == ["Executable", "Library", "Test", "Test"]


def test_identifiers(apply):
    assert apply(names.sanitize_graph_id("v"), ["My.Lib-x y"]) == ["My_Lib_x_y"]
    assert apply(names.sanitize_type_id("v"), ["N.Map<K, V[]>+In`1?:"]) == ["N_Map_K__V____In_1__"]
    assert apply(names.quote_entity("v"), ["Größe_1", "a b", ""]) == ["Größe_1", '"a b"', '""']
    assert apply(names.escape_label("v"), ['a"b"']) == ["a#quot;b#quot;"]
    assert apply(names.warning_line("v"), ["a\r\nb\nc"]) == ["%% WARNING: a b c"]
    assert apply(names.context_name("a", "c"), [("Ctx", "XModelSnapshot"), (None, "ShopModelSnapshot")], "a string, c string") == ["Ctx", "Shop"]
    assert apply(names.looks_like_interface("v"), ["IFoo", "Is", "Foo", "I"]) == [True, False, False, False]
    assert apply(names.diagram_type("v"), ["List<int>?", "byte[]", "?"]) == ["List~int~", "byte", "unknown"]


def test_conventional_keys(apply):
    cases = [("id", "User"), ("USERID", "User"), ("BaseId", "User"), ("OrderId", "User")]
    assert apply(names.is_conventional_key("p", "e"), cases, "p string, e string") == [True, True, False, False]
    assert apply(names.is_conventional_key("p", "e", F.lit("Base")), cases, "p string, e string") == [True, True, True, False]


def test_storage_types(apply):
    cases = ["decimal(18,2)", "uniqueidentifier", "bit", "bigint", "datetime2", "  NUMERIC (9)", '"real"', "nvarchar(200)", ""]
    assert apply(types.logical_type("v"), cases) == ["decimal", "Guid", "bool", "long", "DateTime", "decimal", "float", None, None]
    specs = [(r["precision"], r["scale"]) for r in apply(types.decimal_spec("v"), ["decimal(18, 2)", "Decimal(18,2)", "decimal(9)", "decimal(99999999999,2)"])]
    assert specs == [(18, 2), (None, None), (None, None), (None, None)]
    assert apply(types.length_spec("v"), ["nvarchar(200)", "nvarchar(max)"]) == [200, None]


def test_described_types(apply):
    assert apply(types.is_value_type("v"), ["int?", "System.GUID", "Order", "string"]) == [True, True, False, False]
    assert apply(types.guess_type("v"), ["BuyerID", "Identity"]) == ["Guid", "string"]
    cases = ["Order[]?", "Order[][]", "List<Order>", "System.ISet<Order?>", "ICollection<Dictionary<int, A>>", "Order?", "Map<A, B>", "Nullable<int>"]
    assert apply(types.element_type("v"), cases) == ["Order", "Order", "Order", "Order", "Dictionary<int, A>", "Order", "Map<A, B>", "int"]
    assert apply(types.is_to_many("v"), cases) == [True, True, True, True, True, False, False, False]
    assert apply(types.referenced_types("v"), ["Result<Order>", "List<Order>", "Dictionary<string, Shop.Pair<A, List<B>>>", "Order[]", "List<Order[]>", "int?"]) == [
        ["Result", "Order"], ["Order"], ["Shop.Pair", "A", "B"], ["Order"], [], [],
    ]
    assert apply(types.member_cardinality("t", "d"), [("Order[]", "Order"), ("PagedList<Order>", "Order"), ("PagedList<Order>", "PagedList"), ("Result<Order>", "Order")], "t string, d string") == ["*", "*", "1", "1"]


def test_navigation_types(apply):
    cases = ["Order", "Order?", "List<Order>", "ICollection<string>", "Order[]", "byte[]", "System.Text.Rune", "My.System.X", "Guid?", "Nullable<DateTime>", "Dictionary<int, Order>"]
    assert apply(types.is_navigation("v"), cases) == [True, True, True, False, False, False, False, False, False, False, False]
    assert apply(types.type_name("v"), ["Shop.Map<A, B.C>?", "X"]) == ["Map", "X"]


def test_system_types(apply):
    cases = [("System", "X"), ("System.Text", "X"), ("Systems.Combat", "X"), ("Microsoft.Extensions.Http", "X"), ("MyApp", "Task"), ("", "Task"), ("", "string"), (None, "Order")]
    assert apply(types.is_system_type("n", "t"), cases, "n string, t string") == [True, True, False, True, False, True, True, False]


def test_argument_values(apply):
    cases = ['"a.b"', " 'x' ", "Status.Active", "Ns.Status.Active", "0.7f", "5", "Kind"]
    assert apply(types.default_literal("v"), cases) == ["a.b", "x", "Active", "Active", "0.7f", "5", "Kind"]
    assert apply(types.default_literal("v", F.lit("7")), ["Status.Active", '"q"']) == ["7", "q"]
    assert apply(types.default_sql("v"), ['"getdate()"']) == ["getdate()"]
    assert apply(types.parse_required("v"), ["", "True", "false", None]) == [True, True, False, True]
    parsed = apply(types.parse_precision("v", F.lit(4)), ["18, 2", "9", "x,1"])
    assert [p and (p["precision"], p["scale"]) for p in parsed] == [(18, 2), (9, 4), None]


def test_symbols(apply):
    kinds = [("OneToOne", True), ("OneToOne", False), ("OneToMany", True), ("OneToMany", False), ("ManyToMany", True)]
    assert apply(marks.relationship_symbol("t", "r"), kinds, "t string, r boolean") == ["||--||", "|o--||", "||--o{", "|o--o{", "}|--|{"]
    edges = [("Inheritance", None, None), ("Realization", None, None), ("Association", "Items", "*"), ("Association", None, None), ("Dependency", None, None)]
    text = marks.type_edge_text("k", F.lit("A"), F.lit("B"), "l", "c")
    assert apply(text, edges, "k string, l string, c string") == ["B <|-- A", "B <|.. A", 'A --> "*" B : Items', "A --> B", "A ..> B"]
    assert apply(marks.key_markers("p", "f"), [(True, False), (False, True), (True, True), (False, False)], "p boolean, f boolean") == ["PK", "FK", "PK,FK", ""]
    assert apply(marks.visibility_char("v"), ["Public", "Protected", "Internal", "Private", "?"]) == ["+", "#", "~", "-", "+"]
    assert apply(marks.kind_label("v"), ["Executable", "Test", "Library"]) == [" (Exe)", " (Test)", ""]


def test_constraint_comment(apply):
    schema = "pk boolean, req boolean, exp boolean, val boolean, len int, p int, s int, d string"
    comment = marks.constraint_comment("pk", "req", "exp", "val", "len", "p", "s", "d")
    cases = [
        (False, True, False, False, 200, None, None, None),
        (True, True, True, True, None, None, None, None),
        (False, True, False, True, None, 18, 2, ""),
        (False, False, True, True, None, 9, None, "x"),
    ]
    assert apply(comment, cases, schema) == ['"required, max:200"', "", '"precision(18,2)"', '"required, precision:9, default:x"']


def test_half_even_rounding(apply):
    assert apply(F.bround("v", 2), [1.125, 1.135, 2.675], "v double") == [1.12, 1.14, 2.68]


def test_options_are_checked_before_any_job():
    assert check_mode("MIRROR") == "mirror" and check_format("Tree") == "tree"
    for check, value in ((check_mode, "both"), (check_format, "svg")):
        with pytest.raises(ValueError):
            check(value)
