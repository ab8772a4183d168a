"""Queries over names, paths and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import types as T
from ..functions.names import classify_node, context_name, escape_label, quote_entity, warning_line
from ..sources.files import files_mentioning, first_path
from ..sources.manifests import nearest_ancestor, nearest_declaration
from . import load, query

_WORD = r"[\p{L}\p{Nd}_]+"


def words(spark, sf):
    """Distinct words of all documents."""
    return load(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), 0)).alias("name")).distinct()


WORDS = rf"words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM documents)"


# ---- paths --------------------------------------------------------------------------------


@query("url_normalize", r"SELECT page_id, upper(translate(replace(url, '/', '\'), '\', '/')) AS path FROM pages")
def url_normalize(spark, sf):
    return load(spark, sf, "pages").select("page_id", P.normalize_path(F.translate("url", "/", "\\"), case_insensitive=True).alias("path"))


_PATHS = r"""
located AS (SELECT page_id, '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path, html FROM pages),
hrefs AS (SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS dir, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM located),
joined AS (SELECT *, dir || '/../.' || href AS full_path FROM hrefs)"""


@query(
    "url_resolve",
    rf"""WITH {_PATHS}
SELECT page_id, href, '/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(full_path, '/'), lambda p: [p])),
  lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END), '/') AS target FROM joined""",
)
def url_resolve(spark, sf):
    """Link targets resolved one folder above their page."""
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1))
    pages = load(spark, sf, "pages").select("page_id", path.alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    base = F.regexp_replace("path", "/[^/]*$", "")
    return pages.select("page_id", "href", P.resolve_path(base, F.concat(F.lit("../."), "href")).alias("target"))


@query(
    "url_parts",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '([^/]*)$', 1) AS file FROM pages)
SELECT page_id, regexp_replace(file, '\.[^.]*$', '') AS stem, lower(regexp_extract(file, '(\.[^.]+)$', 1)) AS extension, regexp_extract(url, '([^.]*)$', 1) AS tail FROM p""",
)
def url_parts(spark, sf):
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return load(spark, sf, "pages").select("page_id", P.file_stem(path).alias("stem"), P.extension(path).alias("extension"), P.last_segment("url").alias("tail"))


@query("stable_ids", "SELECT page_id, sha256(url)[1:32] AS node_id, sha256(regexp_extract(url, '//([^/]*)', 1) || ':' || page_id)[1:32] AS package_id FROM pages")
def stable_ids(spark, sf):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    return load(spark, sf, "pages").select("page_id", P.path_id("url").alias("node_id"), P.package_id(host, F.col("page_id").cast("string")).alias("package_id"))


@query(
    "excluded_directories",
    r"""WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '[^\p{L} ]', ' ', 'g'), ' ') AS parts FROM documents),
p AS (SELECT doc_id, '/' || array_to_string(list_filter(parts, lambda x: x <> ''), '/') || CASE WHEN doc_id % 3 = 0 THEN '/Bin/x' ELSE '/x' END AS path FROM w)
SELECT doc_id, len(list_filter(string_split(lower(regexp_replace(path, '/[^/]*$', '')), '/'), lambda x: x IN ('bin', 'obj', '.git', 'node_modules'))) > 0 AS skipped FROM p""",
)
def excluded_directories(spark, sf):
    """Whole texts read as paths, every third one below a build folder."""
    parts = F.filter(F.split(F.regexp_replace("text", r"[^\p{L} ]", " "), " "), lambda x: x != "")
    ending = F.when(F.col("doc_id") % 3 == 0, "/Bin/x").otherwise("/x")
    path = F.concat(F.lit("/"), F.array_join(parts, "/"), ending)
    return load(spark, sf, "documents").select("doc_id", P.in_excluded_directory(path).alias("skipped"))


_WANTED = r"""
located AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, '/' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, '/' || regexp_extract(url, '^[a-z]+://([^/?#]*/[^/?#]*)', 1) AS section, url FROM pages),
offered AS (
  SELECT host AS dir, scheme, min(url) AS value FROM located GROUP BY ALL
  UNION ALL SELECT section, scheme, max(url) FROM located WHERE contains(url, '?') GROUP BY ALL
)"""


@query(
    "nearest_prefix_join",
    rf"""WITH {_WANTED}, wanted AS (SELECT DISTINCT section || '/' || page_id AS dir, section, host, scheme FROM located)
SELECT w.dir, w.scheme, coalesce(s.value, h.value) AS value FROM wanted w LEFT JOIN offered s ON s.dir = w.section AND s.scheme = w.scheme LEFT JOIN offered h ON h.dir = w.host AND h.scheme = w.scheme""",
)
def nearest_prefix_join(spark, sf):
    """For every page folder the value offered by its section, else by its host."""
    pages = load(spark, sf, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme"),
        F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).alias("host"),
        F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*/[^/?#]*)", 1)).alias("section"),
    )
    hosts = pages.groupBy(F.col("host").alias("dir"), "scheme").agg(F.min("url").alias("value"))
    sections = pages.filter(F.col("url").contains("?")).groupBy(F.col("section").alias("dir"), "scheme").agg(F.max("url").alias("value"))
    wanted = pages.select(F.concat_ws("/", "section", F.col("page_id").cast("string")).alias("dir"), "scheme")
    return nearest_ancestor(wanted, hosts.unionByName(sections), ["scheme"], "value")


@query(
    "nearest_declaration",
    r"""WITH d AS (SELECT '/' || source || '/' || lang AS dir, '/' || source || '/' || lang || '/' || doc_id AS path, source, text FROM documents),
decl AS (SELECT dir, path, source, unnest(regexp_extract_all(text, '(?:^|\n)(\p{Lu}\p{Ll}+)', 1)) AS name FROM d),
near AS (SELECT dir, name, min(path) AS path FROM decl GROUP BY ALL),
far AS (SELECT source, name, min(path) AS path FROM decl GROUP BY ALL),
wanted AS (SELECT DISTINCT dir, source, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+')) AS name FROM d)
SELECT w.dir AS context_dir, w.name, coalesce(n.path, f.path) AS path FROM wanted w LEFT JOIN near n ON n.dir = w.dir AND n.name = w.name LEFT JOIN far f ON f.source = w.source AND f.name = w.name
WHERE coalesce(n.path, f.path) IS NOT NULL""",
)
def nearest_declaration_query(spark, sf):
    """A word that a line begins with is declared there.  Every capitalised word of a language
    folder, wanted in it: the first document of that folder that declares it, else of its source."""
    folder = F.concat_ws("/", F.lit(""), "source", "lang")
    documents = load(spark, sf, "documents").select(
        folder.alias("dir"), F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"), "source", "text"
    )
    found = documents.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|\n)(\p{Lu}\p{Ll}+)"), 1))).alias("name"))
    wanted = documents.select(F.col("dir").alias("context_dir"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+"), 0))).alias("name"))
    roots = documents.select(F.concat(F.lit("/"), F.col("source")).alias("dir")).distinct()
    return nearest_declaration(wanted.distinct(), found.select("name", "path"), roots)


# ---- names and described types ------------------------------------------------------------


@query(
    "classify_parts",
    rf"""WITH pairs AS (
  SELECT d.doc_id, unnest(list) AS name, unnest(list[2:] || ['']) AS next, l.toxic FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS list FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id
)
SELECT doc_id, CASE WHEN contains(lower(name), 'test') OR coalesce(toxic, 0) = 1 THEN 'Test' WHEN contains(lower(next), 'exe') THEN 'Executable' ELSE 'Library' END AS kind, count(*) AS n FROM pairs GROUP BY ALL""",
)
def classify_parts(spark, sf):
    """Every word of every document classified by itself, the next word and the label."""
    listed = F.regexp_extract_all("text", F.lit(_WORD), 0)
    documents = load(spark, sf, "documents").join(load(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").withColumn("list", listed)
    following = F.concat(F.slice("list", 2, F.greatest(F.size("list"), F.lit(1))), F.array(F.lit("")))
    pairs = documents.select("doc_id", "toxic", F.explode(F.arrays_zip(F.col("list").alias("name"), following.alias("next"))).alias("p"))
    flag = F.when(F.col("toxic") == 1, "True").otherwise("")
    kind = classify_node("p.name", "p.next", flag)
    return pairs.filter("p.name is not null").groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("guess_types", rf"WITH {WORDS} SELECT name, CASE WHEN lower(name) LIKE '%id' THEN 'Guid' ELSE 'string' END AS type FROM words")
def guess_types(spark, sf):
    return words(spark, sf).select("name", T.guess_type("name").alias("type"))


@query("quoted_names", r"""WITH links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<[^<>]*href="/[^"]*"[^<>]*>')) AS tag FROM pages)
SELECT page_id, CASE WHEN regexp_matches(name, '^[\p{L}\p{Nd}_]+$') THEN name ELSE '"' || name || '"' END AS entity, replace(tag, '"', '#quot;') AS label
FROM (SELECT page_id, tag, regexp_extract(tag, 'href="/([^"]*)"', 1) AS name FROM links)""")
def quoted_names(spark, sf):
    """Every distinct link of a page: its target as a name, its tag as a label."""
    tags = F.regexp_extract_all("html", F.lit(r'<[^<>]*href="/[^"]*"[^<>]*>'), 0)
    links = load(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(tags)).alias("tag"))
    name = F.regexp_extract("tag", 'href="/([^"]*)"', 1)
    return links.select("page_id", quote_entity(name).alias("entity"), escape_label("tag").alias("label"))


# Storage types made of the columns of parts: keyword by size, arguments by price and size.
_KEYWORDS = ["decimal", "Numeric", "money", "int", "BIGINT", "bit", "uniqueidentifier", "real", "datetime2", "date", "nvarchar", "geography"]
_STORED = (
    "stored AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN ' \"' ELSE '' END || (["
    + ", ".join(f"'{k}'" for k in _KEYWORDS)
    + "])[(p_size % 12 + 1)::INT] || CASE WHEN p_size % 3 = 0 THEN '(' || length(p_name) || ', ' || p_size || ')' WHEN p_size % 3 = 1 THEN '(' || floor(p_retailprice)::BIGINT || ')' ELSE '' END AS storage FROM part)"
)


def stored_types(spark, sf):
    size = F.col("p_size")
    keyword = F.element_at(F.array(*[F.lit(k) for k in _KEYWORDS]), (size % 12 + 1).cast("int"))
    arguments = (
        F.when(size % 3 == 0, F.concat(F.lit("("), F.length("p_name").cast("string"), F.lit(", "), size.cast("string"), F.lit(")")))
        .when(size % 3 == 1, F.concat(F.lit("("), F.floor("p_retailprice").cast("string"), F.lit(")")))
        .otherwise("")
    )
    lead = F.when(size % 5 == 0, ' "').otherwise("")
    return load(spark, sf, "part").select("p_partkey", F.concat(lead, keyword, arguments).alias("storage"))


@query(
    "logical_types",
    f"""WITH {_STORED} SELECT p_partkey, storage, CASE lower(regexp_extract(storage, '([A-Za-z0-9]+)', 1)) WHEN 'decimal' THEN 'decimal' WHEN 'numeric' THEN 'decimal' WHEN 'money' THEN 'decimal' WHEN 'int' THEN 'int' WHEN 'bigint' THEN 'long'
  WHEN 'bit' THEN 'bool' WHEN 'uniqueidentifier' THEN 'Guid' WHEN 'real' THEN 'float' WHEN 'datetime2' THEN 'DateTime' WHEN 'date' THEN 'DateOnly' END AS logical FROM stored""",
)
def logical_types(spark, sf):
    return stored_types(spark, sf).select("p_partkey", "storage", T.logical_type("storage").alias("logical"))


@query(
    "decimal_specs",
    rf"""WITH {_STORED} SELECT p_partkey, TRY_CAST(regexp_extract(storage, 'decimal\((\d+),\s*(\d+)\)', 1) AS INT) AS "precision", TRY_CAST(regexp_extract(storage, 'decimal\((\d+),\s*(\d+)\)', 2) AS INT) AS scale,
  TRY_CAST(regexp_extract(storage, '\((\d+)\)', 1) AS INT) AS max_length FROM stored""",
)
def decimal_specs(spark, sf):
    spec = T.decimal_spec("storage")
    return stored_types(spark, sf).select("p_partkey", spec["precision"].alias("precision"), spec["scale"].alias("scale"), T.length_spec("storage").alias("max_length"))


_DESCRIBED = ["System.Int32?", "guid", "Shop.Order", "DateTime??", "string", "System.Uri", "List<int>", "UINT64", "Shop.decimal", "char?"]


@query(
    "value_types",
    "WITH t AS (SELECT p_partkey, ([" + ", ".join(f"'{d}'" for d in _DESCRIBED) + "])[(p_size % 10 + 1)::INT] AS type FROM part) "
    "SELECT p_partkey, type, p_type, lower(regexp_extract(rtrim(type, '?'), '([^.]*)$', 1)) IN ('int32', 'guid', 'datetime', 'uri', 'uint64', 'decimal', 'char') AS is_value_type FROM t JOIN part USING (p_partkey)",
)
def value_types(spark, sf):
    described = F.element_at(F.array(*[F.lit(d) for d in _DESCRIBED]), (F.col("p_size") % 10 + 1).cast("int"))
    parts = load(spark, sf, "part").select("p_partkey", described.alias("type"), "p_type")
    return parts.withColumn("is_value_type", T.is_value_type("type"))


@query(
    "default_literals",
    """WITH a AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' "' || p_name || '.x" ' WHEN 1 THEN 'Kinds.' || p_type WHEN 2 THEN floor(p_retailprice)::BIGINT || '.5f' WHEN 3 THEN p_type ELSE '''' || p_brand || '''' END AS argument FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(trim(argument), '^(".*"|''.*'')$') THEN trim(trim(argument), '"''') WHEN contains(argument, '.') AND regexp_matches(argument, '\\.[^.0-9][^.]*$') THEN regexp_extract(argument, '([^.]*)$', 1) ELSE argument END AS shown FROM a""".replace("\\\\", "\\"),
)
def default_literals(spark, sf):
    size, text = F.col("p_size") % 5, F.col("p_type")
    argument = (
        F.when(size == 0, F.concat(F.lit(' "'), "p_name", F.lit('.x" ')))
        .when(size == 1, F.concat(F.lit("Kinds."), text))
        .when(size == 2, F.concat(F.floor("p_retailprice").cast("string"), F.lit(".5f")))
        .when(size == 3, text)
        .otherwise(F.concat(F.lit("'"), "p_brand", F.lit("'")))
    )
    return load(spark, sf, "part").select("p_partkey", T.default_literal(argument).alias("shown"))


# ---- whole texts --------------------------------------------------------------------------


@query(
    "docs_containing_terms",
    r"""WITH tokens AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nd}_]+')) AS name FROM documents), wanted AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{Nd}_]+')) AS name FROM benchmark)
SELECT t.doc_id::VARCHAR AS path, t.name FROM tokens t SEMI JOIN wanted w ON w.name = t.name""",
)
def docs_containing_terms(spark, sf):
    """Documents that hold any word of the benchmark items."""
    documents = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    wanted = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), 0)).alias("name")).distinct()
    return files_mentioning(documents, wanted, rf"({_WORD})")


@query(
    "term_first_document",
    rf"""WITH tokens AS (SELECT 'D' || doc_id::VARCHAR AS path, unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM documents)
SELECT name, min(path) AS path FROM tokens GROUP BY name""",
)
def term_first_document(spark, sf):
    documents = load(spark, sf, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("path"),
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), 0))).alias("name"),
    )
    return first_path(documents)


# ---- warnings and model names -------------------------------------------------------------


@query(
    "warning_texts",
    r"""SELECT conv_id, turn, '%% WARNING: ' || regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\x0A-\x0D\x{85}\x{2028}\x{2029}]', ' ', 'g') AS line FROM conversations""",
)
def warning_texts(spark, sf):
    """Every turn as a warning of one line, whatever line ends it has."""
    return load(spark, sf, "conversations").select("conv_id", "turn", warning_line("text").alias("line"))


@query(
    "context_names",
    r"""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'Clerk' || o_custkey ELSE replace('Clerk' || o_custkey || 'ModelSnapshot', 'ModelSnapshot', '') END AS context
FROM orders""",
)
def context_names(spark, sf):
    """Urgent orders name their context themselves; the others carry it in the name of a snapshot."""
    context = F.concat(F.lit("Clerk"), F.col("o_custkey").cast("string"))
    declared = F.when(F.col("o_orderpriority").startswith("1"), context)
    snapshot = F.concat(context, F.lit("ModelSnapshot"))
    return load(spark, sf, "orders").select("o_orderkey", context_name(declared, snapshot).alias("context"))
