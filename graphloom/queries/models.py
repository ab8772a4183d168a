"""Schema-model queries.

Models that Spark derives from the tables:
  trade   one model per part: nations are entities, each order line of the part gives the
          seller's nation a navigation to the buyer's nation and a property
  orders  one model per customer: orders are entities, their lines owned entities, the
          supplier part of open lines an owned entity of the line
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import is_value_type
from ..operators.model import keys as MK
from ..operators.model import owned as MO
from ..operators.model import overrides as MV
from ..operators.model import profile as MP
from ..operators.model import relationships as MR
from ..operators.model.nested import catalog_entities, flatten_nested, join_nested, list_models, nested_parts, split_nested
from ..operators.numbering import first_wins, number_rows
from ..plans import lines as L
from ..plans.entity_model import Configuration, entity_model
from ..schemas import ENTITIES, PROPERTIES, conform
from ..session import keep_buckets
from ..storage import StageTables, buckets
from . import load, query

# Suppliers, two numbers each, up to which lines find theirs in a broadcast table; they are counted first.
MOST_SENT = 500_000

# Entities of a customer's model up to which one task takes all of them.
MOST_ENTITIES = 200_000


def navigations(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as navigations, one per (part, seller, buyer, line number)."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    nation = load(spark, sf, "nation")
    buyers = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    sellers = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    if sellers.count() <= MOST_SENT:
        sellers = F.broadcast(sellers)
    placed = orders.join(buyers, orders.o_custkey == buyers.c_custkey).select("o_orderkey", "c_nationkey")
    joined = lines.join(sellers, lines.l_suppkey == sellers.s_suppkey).join(placed, lines.l_orderkey == placed.o_orderkey)
    # The lines of a part meet once; names of nations replace their numbers behind that.
    model = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("model_id")
    met = joined.select(model, "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "c_nationkey", "s_nationkey")
    met = met.repartition(buckets(spark), "model_id")
    met = met.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target")), "c_nationkey")
    met = met.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("entity")), "s_nationkey")
    return met.groupBy("model_id", "entity", "target", F.col("l_linenumber").alias("line")).agg(
        (F.max("l_quantity") > 25).alias("is_collection"),
        F.bool_and(F.col("l_returnflag") == "R").alias("is_nullable"),
        F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
        F.max("l_quantity").cast("int").alias("quantity"),
    ).withColumn("nav", F.concat("target", F.lit("L"), F.col("line").cast("string")))


NAVS = """
navs AS (
  SELECT 'p' || l_partkey AS model_id, s.n_name AS entity, b.n_name AS target, l_linenumber AS line, b.n_name || 'L' || l_linenumber AS nav,
         max(l_quantity) > 25 AS is_collection, bool_and(l_returnflag = 'R') AS is_nullable, min(l_orderkey * 8 + l_linenumber) AS ordinal,
         max(l_quantity)::INT AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation b ON b.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey
  GROUP BY ALL
)"""

ENTS = """
ents AS (
  SELECT model_id, name, min(ordinal) AS ordinal FROM (SELECT model_id, entity AS name, ordinal FROM navs UNION ALL SELECT model_id, target, ordinal FROM navs)
  GROUP BY ALL
)"""

PROPS = """
raw_props AS (
  SELECT model_id, entity, CASE line WHEN 1 THEN 'Id' WHEN 2 THEN entity || 'Id' WHEN 3 THEN target || 'Id' WHEN 4 THEN lower(nav) || 'ID' WHEN 5 THEN 'Code' WHEN 6 THEN 'Amount' ELSE 'note' END AS name,
         min(ordinal) AS first, bool_and(NOT is_nullable) AS is_required, bool_or(is_collection) AS is_explicitly_required, max(quantity) AS quantity, min(target) AS target
  FROM navs GROUP BY ALL
),
props AS (
  SELECT model_id, entity, name, row_number() OVER (PARTITION BY model_id, entity ORDER BY first, name) AS ordinal, is_required,
         is_explicitly_required AND quantity > 45 AS is_explicitly_required,
         CASE WHEN name = 'Amount' THEN 'decimal' WHEN name = 'Code' THEN 'string' WHEN name = 'note' THEN 'string?' WHEN first % 2 = 0 THEN 'Guid' ELSE 'int' END AS type,
         CASE WHEN name IN ('Code', 'note') THEN quantity END AS max_length, CASE WHEN name = 'Amount' THEN 18 END AS "precision",
         CASE WHEN name = 'Amount' AND quantity > 25 THEN 2 END AS scale, CASE WHEN name = 'Code' THEN target ELSE '' END AS default_value
  FROM raw_props
)"""


def trade_entities(navs: DataFrame) -> DataFrame:
    both = navs.select("model_id", "ordinal", F.explode(F.array("entity", "target")).alias("name"))
    return both.groupBy("model_id", "name").agg(F.min("ordinal").alias("ordinal"))


def trade_properties(navs: DataFrame) -> DataFrame:
    line = F.col("line")
    name = (
        F.when(line == 1, "Id")
        .when(line == 2, F.concat("entity", F.lit("Id")))
        .when(line == 3, F.concat("target", F.lit("Id")))
        .when(line == 4, F.concat(F.lower("nav"), F.lit("ID")))
        .when(line == 5, "Code")
        .when(line == 6, "Amount")
        .otherwise("note")
    )
    raw = navs.groupBy("model_id", F.col("entity").alias("entity_key"), name.alias("name")).agg(
        F.min("ordinal").alias("first"),
        F.bool_and(~F.col("is_nullable")).alias("is_required"),
        F.bool_or("is_collection").alias("_many"),
        F.max("quantity").alias("quantity"),
        F.min("target").alias("target"),
    )
    named = F.col("name")
    typed = (
        F.when(named == "Amount", "decimal")
        .when(named == "Code", "string")
        .when(named == "note", "string?")
        .otherwise(F.when(F.col("first") % 2 == 0, "Guid").otherwise("int"))
    )
    full = number_rows(raw, ["model_id", "entity_key"], ["first", "name"], "ordinal", by=TRADE).select(
        "*",
        typed.alias("type"),
        (F.col("_many") & (F.col("quantity") > 45)).alias("is_explicitly_required"),
        F.when(named.isin("Code", "note"), F.col("quantity")).alias("max_length"),
        F.when(named == "Amount", 18).alias("precision"),
        F.when((named == "Amount") & (F.col("quantity") > 25), 2).alias("scale"),
        F.when(named == "Code", F.col("target")).otherwise("").alias("default_value"),
    )
    return conform(full.withColumn("is_value_type", is_value_type("type")), PROPERTIES)


# A model has at most a navigation per two nations and line number, so it fits a bucket.
TRADE = "model_id"


def trade_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(entities, navigations) as stage tables."""
    keep_buckets(spark)
    stage = StageTables(spark, "trade")
    navs, _ = stage.put(navigations(spark, sf), "navigations", TRADE)
    ents = conform(trade_entities(navs).withColumn("entity_key", F.col("name")), ENTITIES)
    return stage.put(ents, "entities", TRADE)[0], navs


def trade_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, properties, navigations) as stage tables."""
    entities, navs = trade_facts(spark, sf)
    properties, _ = StageTables(spark, "trade").put(trade_properties(navs), "properties", TRADE)
    return entities, properties, navs


# ---- keys ---------------------------------------------------------------------------------

_CONVENTION = "lower(name) = 'id' OR lower(name) = lower(entity) || 'id'"


@query("pk_by_convention", f"WITH {NAVS}, {PROPS} SELECT model_id, entity, name FROM props WHERE {_CONVENTION}")
def pk_by_convention(spark, sf):
    entities, properties, _ = trade_model(spark, sf)
    keyed = MK.primary_keys(entities, properties).filter("is_pk")
    return keyed.select("model_id", F.col("entity_key").alias("entity"), "name")


@query(
    "pk_fallback",
    f"WITH {NAVS}, {PROPS} SELECT model_id, entity, name FROM (SELECT *, row_number() OVER (PARTITION BY model_id, entity "
    f"ORDER BY lower(name) <> 'id', ordinal) AS rank FROM props WHERE {_CONVENTION}) WHERE rank = 1",
)
def pk_fallback(spark, sf):
    entities, properties, _ = trade_model(spark, sf)
    keyed = MK.primary_key_fallback(entities, properties).filter("is_pk")
    return keyed.select("model_id", F.col("entity_key").alias("entity"), "name")


_FK = """
wanted AS (
  SELECT model_id, entity, lower(nav) || 'id' AS name FROM navs WHERE NOT is_collection
  UNION SELECT model_id, entity, lower(target) || 'id' FROM navs WHERE NOT is_collection
  UNION SELECT model_id, target, lower(entity) || 'id' FROM navs WHERE is_collection
),
fk_props AS (
  SELECT p.*, w.name IS NOT NULL AS is_fk FROM props p LEFT JOIN wanted w ON w.model_id = p.model_id AND w.entity = p.entity AND w.name = lower(p.name)
)"""


@query("fk_by_convention", f"WITH {NAVS}, {PROPS}, {_FK} SELECT model_id, entity, name FROM fk_props WHERE is_fk")
def fk_by_convention(spark, sf):
    entities, properties, navs = trade_model(spark, sf)
    keyed = MK.foreign_keys(entities, properties, navs).filter("is_fk")
    return keyed.select("model_id", F.col("entity_key").alias("entity"), "name")


@query(
    "declared_fk",
    f"""WITH {NAVS}, {PROPS}, declared AS (SELECT DISTINCT model_id, entity, target || CASE WHEN is_collection THEN 'Id' ELSE 'Ref' END AS name FROM navs)
SELECT p.model_id, p.entity, p.name, p.type, false AS is_type_inferred FROM props p SEMI JOIN declared d ON d.model_id = p.model_id AND d.entity = p.entity AND d.name = p.name
UNION ALL
SELECT model_id, entity, name, CASE WHEN lower(name) LIKE '%id' THEN 'Guid' ELSE 'string' END, true FROM declared d
ANTI JOIN props p ON d.model_id = p.model_id AND d.entity = p.entity AND d.name = p.name""",
)
def declared_fk(spark, sf):
    """Declared foreign keys; those that no property matches are added with a guessed type."""
    _, properties, navs = trade_model(spark, sf)
    declared = navs.select(
        "model_id", F.col("entity").alias("entity_key"), F.concat("target", F.when(F.col("is_collection"), "Id").otherwise("Ref")).alias("name")
    )
    marked = MK.declared_foreign_keys(properties, declared, TRADE).filter("is_fk")
    return marked.select("model_id", F.col("entity_key").alias("entity"), "name", "type", "is_type_inferred")


# ---- relationships ------------------------------------------------------------------------

_INVERSE = """
backs AS (SELECT model_id, entity, target, is_collection, count(*) AS n FROM navs GROUP BY ALL),
counted AS (
  SELECT v.*, coalesce(b.n, 0) - CASE WHEN v.entity = v.target THEN 1 ELSE 0 END AS inverse_refs
  FROM navs v LEFT JOIN backs b ON b.model_id = v.model_id AND b.entity = v.target AND b.target = v.entity AND b.is_collection = v.is_collection
)"""

_KEY = "CASE WHEN rel_type = 'OneToMany' THEN src ELSE least(src, dst) END || '-' || CASE WHEN rel_type = 'OneToMany' THEN dst ELSE greatest(src, dst) END || '-' || rel_type"

_INFERRED = f"""
found AS (
  SELECT model_id, CASE WHEN NOT is_collection AND inverse_refs = 0 THEN target ELSE entity END AS src,
         CASE WHEN NOT is_collection AND inverse_refs = 0 THEN entity ELSE target END AS dst,
         CASE WHEN is_collection AND inverse_refs > 0 THEN 'ManyToMany' WHEN is_collection THEN 'OneToMany' WHEN inverse_refs > 0 THEN 'OneToOne' ELSE 'OneToMany' END AS rel_type,
         NOT is_nullable AS is_required, ordinal
  FROM counted
),
inferred AS (
  SELECT model_id, src, dst, rel_type, is_required, ordinal FROM (
    SELECT *, row_number() OVER (PARTITION BY model_id, {_KEY} ORDER BY ordinal, src, dst, rel_type, is_required) AS rank FROM found
  ) WHERE rank = 1
)"""


@query("inverse_refs", f"WITH {NAVS}, {_INVERSE} SELECT model_id, entity, nav, inverse_refs FROM counted")
def inverse_refs(spark, sf):
    keep_buckets(spark)
    navs, _ = StageTables(spark, "trade").put(navigations(spark, sf), "navigations", TRADE)
    return MR.inverse_counts(navs).select("model_id", "entity", "nav", "inverse_refs")


@query("infer_relationships", f"WITH {NAVS}, {_INVERSE}, {_INFERRED} SELECT model_id, src, dst, rel_type, is_required FROM inferred")
def infer_relationships(spark, sf):
    entities, navs = trade_facts(spark, sf)
    return MR.infer_relationships(entities, navs).select("model_id", "src", "dst", "rel_type", "is_required")


_DECLARED = """
declared AS (
  SELECT model_id, CASE WHEN NOT is_collection AND quantity % 2 = 0 THEN target ELSE entity END AS src,
         CASE WHEN NOT is_collection AND quantity % 2 = 0 THEN entity ELSE target END AS dst,
         CASE WHEN is_collection AND quantity % 2 = 0 THEN 'ManyToMany' WHEN is_collection <> (quantity % 2 = 0) THEN 'OneToMany' ELSE 'OneToOne' END AS rel_type,
         ordinal, CASE WHEN is_nullable THEN false WHEN line > 3 THEN true ELSE is_collection <> (quantity % 2 = 0) END AS is_required
  FROM navs WHERE line <> 7
)"""


def _declarations(navs: DataFrame) -> DataFrame:
    many = F.col("quantity") % 2 == 0
    return navs.select(
        "model_id",
        "entity",
        "target",
        "ordinal",
        F.when(F.col("is_collection"), "HasMany").otherwise("HasOne").alias("has"),
        F.when(F.col("line") == 7, None).otherwise(F.when(many, "WithMany").otherwise("WithOne")).alias("with"),
        F.when(F.col("is_nullable"), False).when(F.col("line") > 3, True).alias("explicit_required"),
    )


@query("declared_relationships", f"WITH {NAVS}, {_DECLARED} SELECT model_id, src, dst, rel_type, is_required, ordinal FROM declared")
def declared_relationships(spark, sf):
    return MR.declared_relationships(_declarations(navigations(spark, sf)))


@query(
    "dedupe_relationships",
    f"""WITH {NAVS}, {_DECLARED},
uniq AS (SELECT *, row_number() OVER (PARTITION BY model_id, {_KEY} ORDER BY ordinal, src, dst, rel_type, is_required) AS rank FROM declared),
final AS (SELECT *, row_number() OVER (PARTITION BY model_id, src, dst ORDER BY rel_type <> 'OneToMany', ordinal, rel_type) AS pick FROM uniq WHERE rank = 1)
SELECT model_id, src, dst, rel_type, is_required FROM final WHERE pick = 1""",
)
def dedupe_relationships(spark, sf):
    raw = MR.declared_relationships(_declarations(navigations(spark, sf)))
    return MR.dedupe_relationships(raw).select("model_id", "src", "dst", "rel_type", "is_required")


@query("dedupe_first", f"WITH {NAVS}, all_ents AS (SELECT model_id, entity AS name, ordinal, nav FROM navs) SELECT model_id, name, min(ordinal) AS ordinal, arg_min(nav, (ordinal, nav)) AS nav FROM all_ents GROUP BY model_id, name")
def dedupe_first(spark, sf):
    """The first declaration per entity key."""
    navs = navigations(spark, sf)
    rows = navs.select("model_id", F.lit("").alias("entity_key"), F.col("entity").alias("name"), "ordinal", "nav")
    return MR.dedupe_entities(rows).select("model_id", "name", "ordinal", "nav")


@query("first_wins", f"WITH {NAVS} SELECT model_id, entity, arg_min(target, (ordinal, target)) AS target, min(ordinal) AS ordinal FROM navs GROUP BY model_id, entity")
def first_wins_query(spark, sf):
    rows = navigations(spark, sf).select("model_id", "entity", "target", "ordinal")
    return first_wins(rows, ["model_id", "entity"], ["ordinal", "target"])


_M2M = f"""
{_INVERSE}, {_INFERRED}, {_FK},
many AS (SELECT *, least(src, dst) || greatest(src, dst) AS joined FROM inferred WHERE rel_type = 'ManyToMany'),
pks AS (SELECT model_id, entity, arg_min(type, ordinal) AS type FROM props WHERE {_CONVENTION} GROUP BY ALL)"""


def _decomposed(spark, sf):
    entities, properties, navs = trade_model(spark, sf)
    properties = MK.primary_keys(entities, properties)
    relationships = MR.infer_relationships(entities, navs)
    return MR.decompose_many_to_many(entities, properties, relationships)


@query("decompose_m2m", f"WITH {NAVS}, {PROPS}, {_M2M} SELECT model_id, src, dst, rel_type, is_required FROM inferred WHERE rel_type <> 'ManyToMany' UNION ALL SELECT model_id, src, joined, 'OneToMany', true FROM many UNION ALL SELECT model_id, dst, joined, 'OneToMany', true FROM many")
def decompose_m2m(spark, sf):
    return _decomposed(spark, sf)[2].select("model_id", "src", "dst", "rel_type", "is_required")


@query("decompose_m2m_entities", f"WITH {NAVS}, {PROPS}, {ENTS}, {_M2M} SELECT model_id, name, false AS is_join FROM ents UNION ALL SELECT model_id, joined, true FROM many")
def decompose_m2m_entities(spark, sf):
    return _decomposed(spark, sf)[0].select("model_id", "name", "is_join")


@query(
    "decompose_m2m_properties",
    f"""WITH {NAVS}, {PROPS}, {_M2M}, sides AS (SELECT model_id, joined, src AS entity FROM many UNION ALL SELECT model_id, joined, dst FROM many)
SELECT s.model_id, s.joined AS entity, s.entity || 'Id' AS name, coalesce(p.type, 'int') AS type, true AS is_pk, true AS is_fk
FROM sides s LEFT JOIN pks p ON p.model_id = s.model_id AND p.entity = s.entity""",
)
def decompose_m2m_properties(spark, sf):
    """The key columns of the join entities."""
    properties = _decomposed(spark, sf)[1].filter("is_pk and is_fk")
    return properties.select("model_id", F.col("entity_key").alias("entity"), "name", "type", "is_pk", "is_fk")


@query(
    "model_diff",
    f"""WITH {NAVS}, {_INVERSE}, {_INFERRED}, {_DECLARED},
l AS (SELECT model_id, src, dst, rel_type FROM inferred), r AS (SELECT model_id, src, dst, rel_type FROM declared)
SELECT model_id, src, dst, rel_type, 'left' AS side, count(*) AS rows FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) GROUP BY ALL
UNION ALL SELECT model_id, src, dst, rel_type, 'right', count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) GROUP BY ALL""",
)
def model_diff(spark, sf):
    """Inferred against declared relationships of the same facts."""
    entities, navs = trade_facts(spark, sf)
    columns = ["model_id", "src", "dst", "rel_type"]
    inferred = MR.infer_relationships(entities, navs).select(columns)
    return MR.model_diff(inferred, MR.declared_relationships(_declarations(navs)).select(columns))


@query(
    "priority_union",
    f"""WITH {NAVS}, l AS (SELECT model_id, entity AS name, min(ordinal) AS ordinal FROM navs WHERE is_collection GROUP BY ALL), r AS (SELECT model_id, target AS name, max(ordinal) AS ordinal FROM navs GROUP BY ALL)
SELECT * FROM l UNION ALL SELECT r.* FROM r ANTI JOIN l ON l.model_id = r.model_id AND l.name = r.name""",
)
def priority_union(spark, sf):
    navs = navigations(spark, sf)
    left = navs.filter("is_collection").groupBy("model_id", F.col("entity").alias("name")).agg(F.min("ordinal").alias("ordinal"))
    right = navs.groupBy("model_id", F.col("target").alias("name")).agg(F.max("ordinal").alias("ordinal"))
    return MK.priority_union(left, right, ["model_id", "name"])


@query(
    "materialize_missing",
    f"WITH {NAVS}, l AS (SELECT DISTINCT model_id, entity AS name FROM navs) SELECT model_id, name FROM l UNION ALL SELECT DISTINCT model_id, target FROM navs v ANTI JOIN l ON l.model_id = v.model_id AND l.name = v.target",
)
def materialize_missing(spark, sf):
    navs = navigations(spark, sf)
    sellers = navs.select("model_id", F.col("entity").alias("name"), F.col("entity").alias("entity_key")).distinct()
    return MK.materialize_missing(conform(sellers, ENTITIES), navs.select("model_id", F.col("target").alias("name"))).select("model_id", "name")


# ---- whole models -------------------------------------------------------------------------

_WHOLE = f"""
{_INVERSE}, {_INFERRED}, {_DECLARED},
keyed AS (SELECT DISTINCT model_id, {_KEY} AS key FROM declared),
both_kinds AS (
  SELECT model_id, src, dst, rel_type, is_required, 0 AS phase, ordinal FROM declared
  UNION ALL SELECT i.model_id, src, dst, rel_type, is_required, 1, ordinal FROM inferred i ANTI JOIN keyed k ON k.model_id = i.model_id AND k.key = {_KEY}
),
placed AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY phase, ordinal, src, dst, rel_type, is_required) AS seq, count(*) OVER (PARTITION BY model_id) AS high FROM both_kinds),
split AS (
  SELECT model_id, src, dst, rel_type, is_required, seq AS ordinal FROM placed WHERE rel_type <> 'ManyToMany'
  UNION ALL SELECT model_id, src, least(src, dst) || greatest(src, dst), 'OneToMany', true, high + (seq - 1) * 2 + 1 FROM placed WHERE rel_type = 'ManyToMany'
  UNION ALL SELECT model_id, dst, least(src, dst) || greatest(src, dst), 'OneToMany', true, high + (seq - 1) * 2 + 2 FROM placed WHERE rel_type = 'ManyToMany'
),
whole_uniq AS (SELECT *, row_number() OVER (PARTITION BY model_id, {_KEY} ORDER BY ordinal, src, dst) AS rank FROM split),
whole AS (SELECT *, row_number() OVER (PARTITION BY model_id, src, dst ORDER BY rel_type <> 'OneToMany', ordinal, rel_type) AS pick FROM whole_uniq WHERE rank = 1),
named_tables AS (SELECT model_id, entity, arg_max('T_' || target, (ordinal, 'T_' || target)) AS table_name FROM navs WHERE line = 5 GROUP BY ALL)"""


def _whole_model(facts, order="context"):
    entities, properties, navs = facts
    tables = navs.filter("line = 5").select(
        "model_id", F.col("entity").alias("entity_key"), F.col("ordinal").alias("seq"), F.concat(F.lit("T_"), "target").alias("table_name")
    )
    return entity_model(entities, properties, navs, Configuration(tables=tables, declarations=_declarations(navs)), order, TRADE)


@query("entity_model", f"WITH {NAVS}, {_WHOLE} SELECT model_id, src, dst, rel_type, is_required FROM whole WHERE pick = 1")
def entity_model_query(spark, sf):
    """Relationships of whole models: declared, inferred, decomposed, without repeats."""
    return _whole_model(trade_model(spark, sf))[2].select("model_id", "src", "dst", "rel_type", "is_required")


@query(
    "entity_model_entities",
    f"""WITH {NAVS}, {ENTS}, {_WHOLE} SELECT e.model_id, e.name, t.table_name, false AS is_join FROM ents e LEFT JOIN named_tables t ON t.model_id = e.model_id AND t.entity = e.name
UNION ALL SELECT DISTINCT model_id, least(src, dst) || greatest(src, dst), NULL, true FROM placed WHERE rel_type = 'ManyToMany'""",
)
def entity_model_entities(spark, sf):
    return _whole_model(trade_model(spark, sf))[0].select("model_id", "name", "table_name", "is_join")


_PARITY = f"""{_WHOLE},
placed_declared AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ordinal, src, dst, rel_type, is_required) AS seq FROM declared),
uniq_declared AS (SELECT *, row_number() OVER (PARTITION BY model_id, {_KEY} ORDER BY seq) AS rank FROM placed_declared),
whole_declared AS (SELECT *, row_number() OVER (PARTITION BY model_id, src, dst ORDER BY rel_type <> 'OneToMany', seq, rel_type) AS pick FROM uniq_declared WHERE rank = 1),
context_facts AS (
  SELECT model_id, src, dst, rel_type FROM whole WHERE pick = 1
  UNION ALL SELECT e.model_id, e.name, t.table_name, 'entity' FROM ents e LEFT JOIN named_tables t ON t.model_id = e.model_id AND t.entity = e.name
  UNION ALL SELECT DISTINCT model_id, least(src, dst) || greatest(src, dst), NULL, 'entity' FROM placed WHERE rel_type = 'ManyToMany'
),
snapshot_facts AS (
  SELECT model_id, src, dst, rel_type FROM whole_declared WHERE pick = 1
  UNION ALL SELECT e.model_id, e.name, t.table_name, 'entity' FROM ents e LEFT JOIN named_tables t ON t.model_id = e.model_id AND t.entity = e.name
)"""


@query(
    "model_parity",
    f"""WITH {NAVS}, {ENTS}, {_PARITY}
SELECT model_id, src, dst, rel_type, 'left' AS side, count(*) AS rows FROM (SELECT * FROM context_facts EXCEPT ALL SELECT * FROM snapshot_facts) GROUP BY ALL
UNION ALL SELECT model_id, src, dst, rel_type, 'right', count(*) FROM (SELECT * FROM snapshot_facts EXCEPT ALL SELECT * FROM context_facts) GROUP BY ALL""",
)
def model_parity(spark, sf):
    """What the two derivations of one configured model do not share: entities (name, table) and
    relationships; `left` is the context, `right` the snapshot."""

    # Both derivations start from the same stored facts.
    model = trade_model(spark, sf)

    def facts(order):
        entities, _, relationships = _whole_model(model, order)
        named = entities.select("model_id", F.col("name").alias("src"), F.col("table_name").alias("dst"), F.lit("entity").alias("rel_type"))
        return relationships.select("model_id", "src", "dst", "rel_type").unionByName(named)

    return MR.model_diff(facts("context"), facts("snapshot"))


@query("listed_models", f"WITH {NAVS}, {ENTS} SELECT DISTINCT model_id FROM ents")
def listed_models(spark, sf):
    """The models that can be chosen."""
    return list_models(trade_entities(navigations(spark, sf)))


_CATALOG = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(
    "catalog_entities",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS entity, row_number() OVER () - 1 AS ordinal, column_name AS name,
CASE column_type WHEN 'BIGINT' THEN 'long' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'List<float>' WHEN 'TIMESTAMP' THEN 'DateTime' ELSE 'DateTimeOffset' END AS type
FROM (DESCRIBE {t})"""
        for t in _CATALOG
    ),
)
def catalog_entities_query(spark, sf):
    """The supplied tables as entities with their columns."""
    _, properties = catalog_entities(spark, {t: load(spark, sf, t) for t in _CATALOG})
    return properties.select(F.col("entity_key").alias("entity"), "ordinal", "name", "type")


# ---- overrides ----------------------------------------------------------------------------

_CALLS = """
calls AS (
  SELECT model_id, entity, CASE quantity % 4 WHEN 0 THEN 'Id' WHEN 1 THEN 'Code' WHEN 2 THEN 'Amount' ELSE 'ExtraId' END AS name,
         row_number() OVER (PARTITION BY model_id ORDER BY ordinal, entity, nav) AS seq,
         CASE line WHEN 1 THEN 'required' WHEN 2 THEN 'max_length' WHEN 3 THEN 'precision' WHEN 4 THEN 'column_type' WHEN 5 THEN 'default' WHEN 6 THEN 'type' ELSE 'column_type' END AS attribute,
         CASE line WHEN 1 THEN CASE WHEN is_nullable THEN 'false' ELSE '' END WHEN 2 THEN quantity::VARCHAR
           WHEN 3 THEN quantity || CASE WHEN is_collection THEN ', 4' ELSE '' END WHEN 4 THEN 'decimal(' || quantity || ',3)'
           WHEN 5 THEN CASE WHEN is_collection THEN 'Kinds.' || target ELSE '"' || target || '"' END
           WHEN 6 THEN CASE WHEN is_nullable THEN 'string' ELSE 'long' END ELSE 'nvarchar(' || quantity || ')' END AS value
  FROM navs
)"""


def override_calls(navs: DataFrame) -> DataFrame:
    line, quantity = F.col("line"), F.col("quantity").cast("string")
    which = F.col("quantity") % 4
    name = F.when(which == 0, "Id").when(which == 1, "Code").when(which == 2, "Amount").otherwise("ExtraId")
    attribute = (
        F.when(line == 1, "required").when(line == 2, "max_length").when(line == 3, "precision")
        .when(line == 5, "default").when(line == 6, "type").otherwise("column_type")
    )
    value = (
        F.when(line == 1, F.when(F.col("is_nullable"), "false").otherwise(""))
        .when(line == 2, quantity)
        .when(line == 3, F.concat(quantity, F.when(F.col("is_collection"), ", 4").otherwise("")))
        .when(line == 4, F.concat(F.lit("decimal("), quantity, F.lit(",3)")))
        .when(
            line == 5,
            F.when(F.col("is_collection"), F.concat(F.lit("Kinds."), "target")).otherwise(F.concat(F.lit('"'), "target", F.lit('"'))),
        )
        .when(line == 6, F.when(F.col("is_nullable"), "string").otherwise("long"))
        .otherwise(F.concat(F.lit("nvarchar("), quantity, F.lit(")")))
    )
    numbered = number_rows(navs, ["model_id"], ["ordinal", "entity", "nav"], "seq", by=TRADE)
    return numbered.select(
        "model_id", F.col("entity").alias("entity_key"), name.alias("property"), "seq", attribute.alias("attribute"), value.alias("value")
    )


# The calls of a property replayed one by one.
_REPLAY = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY model_id, entity, name ORDER BY seq) AS step FROM calls),
named AS (
  SELECT model_id, entity, name, type, false AS guessed, max_length, "precision", scale, is_required, is_explicitly_required, default_value FROM props
  UNION ALL
  SELECT model_id, entity, name, CASE WHEN lower(name) LIKE '%id' THEN 'Guid' ELSE 'string' END, attribute <> 'type', NULL, NULL, NULL, false, false, NULL
  FROM ordered o WHERE step = 1 AND NOT EXISTS (SELECT 1 FROM props p WHERE p.model_id = o.model_id AND p.entity = o.entity AND p.name = o.name)
),
replay AS (
  SELECT *, 0::BIGINT AS step FROM named
  UNION ALL
  SELECT r.model_id, r.entity, r.name,
    CASE WHEN attribute = 'type' THEN value WHEN attribute = 'max_length' AND r.guessed AND lower(r.type) <> 'string' THEN 'string'
         WHEN attribute = 'column_type' AND value LIKE 'decimal%' AND (r.guessed OR lower(r.type) = 'string') THEN 'decimal' ELSE r.type END,
    r.guessed AND NOT (attribute = 'column_type' AND value LIKE 'decimal%'),
    CASE WHEN attribute = 'max_length' THEN value::INT
         WHEN attribute = 'column_type' AND value LIKE 'nvarchar%' AND r.max_length IS NULL AND lower(r.type) = 'string' THEN regexp_extract(value, '([0-9]+)', 1)::INT ELSE r.max_length END,
    CASE WHEN attribute = 'precision' THEN split_part(value, ',', 1)::INT WHEN value LIKE 'decimal%' THEN regexp_extract(value, '([0-9]+)', 1)::INT ELSE r."precision" END,
    CASE WHEN attribute = 'precision' AND value LIKE '%,%' THEN 4 WHEN attribute = 'column_type' AND value LIKE 'decimal%' THEN 3 ELSE r.scale END,
    CASE WHEN attribute = 'required' THEN value = '' ELSE r.is_required END,
    r.is_explicitly_required OR (attribute = 'required' AND value = ''),
    CASE WHEN attribute = 'default' THEN CASE WHEN value LIKE '"%' THEN trim(value, '"') ELSE split_part(value, '.', 2) END ELSE r.default_value END,
    r.step + 1
  FROM replay r JOIN ordered o ON o.model_id = r.model_id AND o.entity = r.entity AND o.name = r.name AND o.step = r.step + 1
)"""

_OVERRIDDEN = 'model_id, entity, name, type, guessed AS is_type_inferred, max_length, "precision", scale, is_required, is_explicitly_required, default_value'


@query(
    "apply_overrides",
    f"WITH RECURSIVE {NAVS}, {PROPS}, {_CALLS}, {_REPLAY} SELECT {_OVERRIDDEN} FROM (SELECT *, row_number() OVER (PARTITION BY model_id, entity, name ORDER BY step DESC) AS last FROM replay) WHERE last = 1",
)
def apply_overrides(spark, sf):
    _, properties, navs = trade_model(spark, sf)
    done = MV.apply_overrides(properties, override_calls(navs), by=TRADE)
    return done.select(
        "model_id", F.col("entity_key").alias("entity"), "name", "type", "is_type_inferred", "max_length", "precision", "scale",
        "is_required", "is_explicitly_required", "default_value",
    )


@query(
    "coalesce_overrides",
    f"""WITH {NAVS}, {PROPS}, o AS (SELECT model_id, entity, 'Code' AS name, max(quantity) FILTER (is_collection) AS max_length, min(target) FILTER (is_nullable) AS default_value FROM navs GROUP BY ALL)
SELECT p.model_id, p.entity, p.name, coalesce(o.max_length, p.max_length) AS max_length, coalesce(o.default_value, p.default_value) AS default_value
FROM props p LEFT JOIN o ON o.model_id = p.model_id AND o.entity = p.entity AND o.name = p.name""",
)
def coalesce_overrides(spark, sf):
    _, properties, navs = trade_model(spark, sf)
    given = navs.groupBy("model_id", F.col("entity").alias("entity_key")).agg(
        F.max(F.when(F.col("is_collection"), F.col("quantity"))).alias("max_length"),
        F.min(F.when(F.col("is_nullable"), F.col("target"))).alias("default_value"),
    )
    done = MV.coalesce_overrides(properties, given.withColumn("name", F.lit("Code")), MV.PROPERTY, ["max_length", "default_value"])
    return done.select("model_id", F.col("entity_key").alias("entity"), "name", "max_length", "default_value")


@query(
    "constant_lookup",
    f"""WITH {NAVS}, {_CALLS}, consts AS (SELECT 'Kinds' AS type, n_name AS member, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
SELECT c.model_id, c.entity, c.seq, k.value AS constant FROM calls c LEFT JOIN consts k ON c.value = 'Kinds.' || k.member WHERE c.attribute = 'default'""",
)
def constant_lookup(spark, sf):
    """Default expressions looked up in a table of constants."""
    calls = override_calls(navigations(spark, sf)).filter("attribute = 'default'")
    regions = load(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    constants = load(spark, sf, "nation").filter("n_nationkey % 2 = 0").join(regions, "n_regionkey")
    constants = constants.select(F.lit("Kinds").alias("type"), F.col("n_name").alias("member"), F.col("r_name").alias("value"))
    return MV.lookup_constants(calls, constants).select("model_id", F.col("entity_key").alias("entity"), "seq", "constant")


# ---- owned entities -----------------------------------------------------------------------


def orders_by(spark: SparkSession, sf: str) -> str | None:
    """The column that tables of the orders model are bucketed by; None if a customer may have more than
    MOST_ENTITIES entities: the order, its lines and their supplier parts for each of their orders."""
    placed = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    orders = placed.agg(F.max("n").alias("n")).first()["n"] or 0
    lines = load(spark, sf, "lineitem").select("l_linenumber").distinct().count()
    if orders * (1 + 2 * lines) > MOST_ENTITIES:
        return None
    keep_buckets(spark)
    return "model_id"


def order_model(spark: SparkSession, sf: str, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, properties) of the orders model as stage tables, without resolved tables; by: see orders_by."""
    stage = StageTables(spark, "orders")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    model = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("model_id")
    root = F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"))
    # Numbers move; keys and names are made where the rows of a model meet.
    meet = lambda rows: rows if by is None else rows.repartition(buckets(spark), by)
    roots = meet(orders.select(model, "o_orderkey", "o_orderstatus")).select(
        "model_id", root.alias("entity_key"), root.alias("name"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("T_"), root)).alias("table_name")
    )
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    # The lines of an order meet once, for the grouping and the join.
    lines = (lines if by is None else lines.repartition("l_orderkey")).groupBy("l_orderkey", "l_linenumber").agg(
        (F.max("l_quantity") > 40).alias("is_collection"),
        F.max("l_returnflag").alias("flag"),
        F.max("l_linestatus").alias("status"),
    )
    nav = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))
    placed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    placed = meet(placed.select(model, "o_orderkey", "is_collection", "flag", "status", "l_linenumber")).select(
        "model_id", root.alias("owner_key"), nav.alias("nav"), F.concat_ws(".", root, nav).alias("entity_key"), "is_collection", "flag", "status", "l_linenumber"
    )
    placed, _ = stage.put(placed, "lines", by)
    name = F.when(F.col("flag") == "A", "Line").otherwise(F.col("nav"))
    owned = placed.withColumn("name", name).withColumn("is_owned", F.lit(True))
    owned = owned.withColumn("table_name", F.when(F.col("flag") == "R", F.concat(F.lit("own_"), F.translate("entity_key", ".", "_"))))
    inner = placed.filter("status = 'O'").select(
        "model_id", F.col("entity_key").alias("owner_key"), F.concat("entity_key", F.lit(".S")).alias("entity_key"), F.lit("Supplier").alias("name"), F.lit("S").alias("nav"), F.lit(True).alias("is_owned")
    )
    entities = stage.put_all([conform(rows, ENTITIES) for rows in (roots, owned, inner)], "raw_entities", by)

    def columns(rows: DataFrame, *facts: tuple) -> DataFrame:
        listed = F.array(
            *[
                F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(pk).alias("is_pk"), F.lit(fk).alias("is_fk"))
                for i, (n, t, pk, fk) in enumerate(facts)
            ]
        )
        full = rows.select("model_id", "entity_key", F.inline(listed)).withColumn("is_value_type", is_value_type("type"))
        return conform(full.withColumn("is_required", F.lit(True)), PROPERTIES)

    few = owned.filter("l_linenumber < 6")
    properties = [
        columns(entities.filter("not is_owned"), ("Id", "long", True, False)),
        columns(few, ("OrderId", "long", True, True), ("Price", "decimal", False, False), ("Comment", "string", False, False)),
        columns(inner, ("SupplierId", "long", True, False)),
    ]
    return entities, stage.put_all(properties, "raw_properties", by)


def stored_order_model(spark: SparkSession, sf: str, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The orders model with resolved tables and without shadow keys, as stage tables; by: see orders_by."""
    stage = StageTables(spark, "orders")
    entities, properties = order_model(spark, sf, by)
    entities, _ = stage.put(MO.resolve_owned_tables(entities, owner_tables=True, by=by), "entities", by)
    properties, _ = stage.put(MO.strip_shadow_keys(entities, properties, by), "properties", by)
    return entities, properties


ORDERS = """
roots AS (
  SELECT 'c' || o_custkey AS model_id, 'Order' || o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'T_Order' || o_orderkey ELSE 'Order' || o_orderkey END AS tab FROM orders
),
lines AS (
  SELECT 'c' || o_custkey AS model_id, 'Order' || o_orderkey AS owner_key, 'L' || l_linenumber AS nav, 'Order' || o_orderkey || '.L' || l_linenumber AS key,
         max(l_quantity) > 40 AS is_collection, max(l_returnflag) AS flag, max(l_linestatus) AS status, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
),
owned AS (
  SELECT l.*, CASE WHEN flag = 'A' THEN 'Line' ELSE nav END AS name, r.tab AS owner_tab,
         CASE WHEN flag = 'R' THEN 'own_' || replace(l.key, '.', '_') WHEN is_collection THEN r.tab || '_' || nav ELSE r.tab END AS tab
  FROM lines l JOIN roots r ON r.model_id = l.model_id AND r.key = l.owner_key
),
inners AS (SELECT model_id, key AS owner_key, key || '.S' AS key, tab FROM owned WHERE status = 'O')"""


@query(
    "owned_entities",
    f"WITH {ORDERS} SELECT model_id, key AS entity_key, nav AS name, owner_key, nav, is_collection FROM lines UNION ALL SELECT model_id, key, 'S', owner_key, 'S', false FROM inners",
)
def owned_entities(spark, sf):
    """Lines as owned entities of their orders, and suppliers of open lines as owned ones of these,
    captured from facts."""
    orders = load(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("model_id"), F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("owner_key"), "o_orderkey")
    nav = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))
    lines = load(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.groupBy("model_id", "owner_key", nav.alias("nav")).agg((F.max("l_quantity") > 40).alias("is_collection"), F.max("l_linestatus").alias("status"))
    lines, _ = StageTables(spark, "captured").put(lines, "lines")
    name = F.lit(None).cast("string").alias("name")
    facts = lines.select("model_id", "owner_key", "nav", name, "is_collection", F.lit(1).alias("level"))
    inner = lines.filter("status = 'O'").select(
        "model_id", F.concat_ws(".", "owner_key", "nav").alias("owner_key"), F.lit("S").alias("nav"), name, F.lit(False).alias("is_collection"), F.lit(2).alias("level")
    )
    roots = conform(orders.select("model_id", F.col("owner_key").alias("entity_key"), F.col("owner_key").alias("name")), ENTITIES)
    found = MO.capture_owned(roots, facts.unionByName(inner)).filter("is_owned")
    return found.select("model_id", "entity_key", "name", "owner_key", "nav", "is_collection")


@query("owned_table_resolution", f"WITH {ORDERS} SELECT model_id, key AS entity_key, tab AS table_name FROM owned UNION ALL SELECT model_id, key, tab FROM inners")
def owned_table_resolution(spark, sf):
    entities, _ = order_model(spark, sf)
    return MO.resolve_owned_tables(entities).filter("is_owned").select("model_id", "entity_key", "table_name")


_COLUMNS = """
cols AS (
  SELECT model_id, key, 'Id' AS name, 'long' AS type, true AS is_pk, false AS is_fk FROM roots
  UNION ALL SELECT model_id, key, 'OrderId', 'long', true, true FROM owned WHERE l_linenumber < 6 AND tab <> owner_tab
  UNION ALL SELECT model_id, key, 'Price', 'decimal', false, false FROM owned WHERE l_linenumber < 6
  UNION ALL SELECT model_id, key, 'Comment', 'string', false, false FROM owned WHERE l_linenumber < 6
  UNION ALL SELECT model_id, key, 'SupplierId', 'long', false, false FROM inners
)"""


@query("strip_shadow_keys", f"WITH {ORDERS}, {_COLUMNS} SELECT model_id, key AS entity_key, name, is_pk, is_fk FROM cols")
def strip_shadow_keys(spark, sf):
    return stored_order_model(spark, sf, orders_by(spark, sf))[1].select("model_id", "entity_key", "name", "is_pk", "is_fk")


# A supplier part is always folded into its line; a line into its order when it is single, in
# the order's table, and has columns or a supplier part.
_MIRROR = """
folded AS (
  SELECT o.*, NOT o.is_collection AND o.tab = o.owner_tab AND (o.l_linenumber < 6 OR i.key IS NOT NULL) AS is_inlined
  FROM owned o LEFT JOIN inners i ON i.owner_key = o.key AND i.model_id = o.model_id
),
placed AS (
  SELECT model_id, key AS box, key, '' AS prefix FROM roots
  UNION ALL SELECT model_id, CASE WHEN is_inlined THEN owner_key ELSE key END, key, CASE WHEN is_inlined THEN nav || '_' ELSE '' END FROM folded
  UNION ALL SELECT f.model_id, CASE WHEN f.is_inlined THEN f.owner_key ELSE f.key END, i.key, CASE WHEN f.is_inlined THEN f.nav || '_' ELSE '' END || 'S_'
  FROM folded f JOIN inners i ON i.owner_key = f.key AND i.model_id = f.model_id
),
box_cols AS (SELECT c.model_id, p.box, p.prefix || c.name AS name, c.type, c.is_pk, c.is_fk, c.key FROM cols c JOIN placed p ON p.model_id = c.model_id AND p.key = c.key)"""


@query("inline_owned", f"WITH {ORDERS}, {_COLUMNS}, {_MIRROR} SELECT model_id, box, name, type, is_pk, is_fk FROM box_cols")
def inline_owned(spark, sf):
    by = orders_by(spark, sf)
    entities, properties = stored_order_model(spark, sf, by)
    return MO.drawn_boxes(entities, properties, "mirror", by)[1].select("model_id", "box", "name", "type", "is_pk", "is_fk")


def _erd_sql(boxes: str, columns: str, links: str) -> str:
    """Lines of the orders model.  boxes: model_id, key, name, is_owned; columns: model_id, box,
    name, type, is_pk, is_fk, key; links: model_id, owner, key, nav, is_collection."""
    return f"""
boxes AS ({boxes}),
shown AS (SELECT *, CASE WHEN is_owned AND count(*) OVER (PARTITION BY model_id, name) > 1 THEN replace(key, '.', '_') ELSE name END AS display FROM boxes),
out AS (
  SELECT model_id, 0 AS section, i AS pos, '' AS a, '' AS b, '' AS c, '' AS d, '' AS e, line
  FROM (SELECT DISTINCT model_id FROM roots) CROSS JOIN (VALUES (1, '```mermaid'), (2, '---'), (3, NULL), (4, '---'), (5, 'erDiagram')) v(i, l), LATERAL (SELECT coalesce(l, 'title: ' || model_id) AS line)
  UNION ALL SELECT model_id, 1, 0, name, key, '0', '', '', '  ' || display || ' {{' FROM shown
  UNION ALL
  SELECT s.model_id, 1, 0, s.name, s.key, '1', CASE WHEN c.is_pk THEN '0' WHEN c.is_fk THEN '1' ELSE '2' END || c.name, c.key,
         '    ' || c.type || ' ' || c.name || CASE WHEN c.is_pk AND c.is_fk THEN ' PK,FK' WHEN c.is_pk THEN ' PK' WHEN c.is_fk THEN ' FK' ELSE '' END || CASE WHEN c.type = 'string' AND NOT c.is_pk THEN ' "required"' ELSE '' END
  FROM shown s JOIN ({columns}) c ON c.model_id = s.model_id AND c.box = s.key
  UNION ALL SELECT model_id, 1, 0, name, key, '2', '', '', '  }}' FROM shown
  UNION ALL
  SELECT l.model_id, 3, 0, l.owner, s.name, s.key, '', '', '  ' || o.display || CASE WHEN l.is_collection THEN ' ||--o{{ ' ELSE ' ||--|| ' END || s.display || ' : "' || l.nav || '"'
  FROM ({links}) l JOIN shown s ON s.model_id = l.model_id AND s.key = l.key JOIN shown o ON o.model_id = l.model_id AND o.key = l.owner
  UNION ALL SELECT DISTINCT model_id, 9, 0, '', '', '', '', '', '```' FROM roots
)
SELECT model_id AS graph_id, row_number() OVER (PARTITION BY model_id ORDER BY section, pos, a, b, c, d, e) AS seq, line FROM out"""


_MIRROR_ERD = _erd_sql(
    "SELECT model_id, key, key AS name, false AS is_owned FROM roots UNION ALL SELECT model_id, key, name, true FROM folded WHERE NOT is_inlined",
    "SELECT * FROM box_cols",
    "SELECT model_id, owner_key AS owner, key, nav, is_collection FROM folded WHERE NOT is_inlined",
)
_CLASSIC_ERD = _erd_sql(
    "SELECT model_id, key, key AS name, false AS is_owned FROM roots UNION ALL SELECT model_id, key, name, true FROM owned UNION ALL SELECT model_id, key, 'Supplier', true FROM inners",
    "SELECT *, key AS box FROM cols",
    "SELECT model_id, owner_key AS owner, key, nav, is_collection FROM owned UNION ALL SELECT model_id, owner_key, key, 'S', false FROM inners",
)


def _erd(spark, sf, mode: str) -> DataFrame:
    by = orders_by(spark, sf)
    entities, properties = stored_order_model(spark, sf, by)
    none = entities.select("model_id", F.lit("").alias("src"), F.lit("").alias("dst"), F.lit("").alias("rel_type"), F.lit(True).alias("is_required"))
    drawn = L.erd_lines(entities, properties, none.filter("false"), mode, title=F.col("graph_id"), by=by)
    return L.numbered(drawn, by and "graph_id")


@query("erd_lines", f"WITH {ORDERS}, {_COLUMNS}, {_MIRROR}, {_MIRROR_ERD}")
def erd_lines(spark, sf):
    """Diagrams with owned entities folded into their owners, one per customer."""
    return _erd(spark, sf, "mirror")


@query("erd_lines_classic", f"WITH {ORDERS}, {_COLUMNS}, {_CLASSIC_ERD}")
def erd_lines_classic(spark, sf):
    """Diagrams with a box per owned entity."""
    return _erd(spark, sf, "classic")


_TEXT = """
replace(type, '?', '') || ' ' || name || CASE WHEN is_pk AND is_fk THEN ' PK,FK' WHEN is_pk THEN ' PK' WHEN is_fk THEN ' FK' ELSE '' END
|| coalesce(' "' || nullif(concat_ws(', ', CASE WHEN NOT is_pk AND (is_explicitly_required OR (is_required AND replace(type, '?', '') = 'string')) THEN 'required' END,
   'max:' || max_length, CASE WHEN "precision" IS NOT NULL THEN CASE WHEN scale IS NOT NULL THEN 'precision(' || "precision" || ',' || scale || ')' ELSE 'precision:' || "precision" END END,
   'default:' || nullif(default_value, '')), '') || '"', '')"""


@query(
    "erd_property_lines",
    f"""WITH {NAVS}, {PROPS}, {_FK}, marked AS (SELECT *, {_CONVENTION} AS is_pk FROM fk_props)
SELECT model_id, entity, row_number() OVER (PARTITION BY model_id, entity ORDER BY CASE WHEN is_pk THEN 0 WHEN is_fk THEN 1 ELSE 2 END, name) AS seq, {_TEXT} AS line FROM marked""",
)
def erd_property_lines(spark, sf):
    """Property lines with key marks and constraints, in drawing order per entity."""
    entities, properties, navs = trade_model(spark, sf)
    marked = MK.foreign_keys(entities, MK.primary_keys(entities, properties), navs)
    marked = marked.withColumn("key_rank", L.property_order()[0]).withColumn("line", L.property_text())
    rows = number_rows(marked, ["model_id", "entity_key"], ["key_rank", "name"], by=TRADE)
    return rows.select("model_id", F.col("entity_key").alias("entity"), "seq", "line")


@query(
    "erd_relationship_lines",
    f"""WITH {NAVS}, {_INVERSE}, {_INFERRED}
SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY src, dst, CASE rel_type WHEN 'OneToOne' THEN 0 WHEN 'OneToMany' THEN 1 ELSE 2 END) AS seq,
  '  ' || src || ' ' || CASE rel_type WHEN 'OneToOne' THEN CASE WHEN is_required THEN '||--||' ELSE '|o--||' END WHEN 'OneToMany' THEN CASE WHEN is_required THEN '||--o{{' ELSE '|o--o{{' END ELSE '}}|--|{{' END || ' ' || dst || ' : ""' AS line
FROM inferred""".replace("{{", "{").replace("}}", "}"),
)
def erd_relationship_lines(spark, sf):
    entities, properties, navs = trade_model(spark, sf)
    relationships = MR.infer_relationships(entities, navs)
    drawn = L.erd_lines(entities, properties, relationships).filter("section = 2")
    ranked = number_rows(drawn, ["graph_id"], ["sort_key"], by="graph_id")
    return ranked.select(F.col("graph_id").alias("model_id"), "seq", "line")


# ---- nested data --------------------------------------------------------------------------


@query(
    "flatten_nested",
    'SELECT o_orderkey, c_name AS "Buyer_Name", c_mktsegment AS "Buyer_Segment", n_name AS "Buyer_Home_Nation", r_name AS "Buyer_Home_Region_Name", o_totalprice AS "Total" '
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def flatten_nested_query(spark, sf):
    """Orders with their customer nested as structs, folded back to flat columns."""
    regions = load(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.struct(F.col("r_name").alias("Name")).alias("Region"))
    nations = load(spark, sf, "nation").join(regions, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.struct(F.col("n_name").alias("Nation"), "Region").alias("Home"))
    buyer = F.struct(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"), "Home").alias("Buyer")
    buyers = load(spark, sf, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), buyer)
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("Total"))
    return flatten_nested(orders.join(buyers, "o_custkey").select("o_orderkey", "Buyer", "Total"))


_SPLIT = r"""
WITH listed AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
SELECT doc_id, unnest(range(len(parts)))::INT AS "Lines_Ordinal", md5(unnest(parts)) AS "Text", length(unnest(parts))::INT AS "Size" FROM listed"""


@query("split_nested", _SPLIT)
def split_nested_query(spark, sf):
    """Documents with their lines as an array of structs, split into a child table."""
    documents = load(spark, sf, "documents").select("doc_id", "lang", F.split("text", "\n").alias("parts"))
    item = F.transform("parts", lambda p: F.struct(F.md5(p).alias("Text"), F.length(p).alias("Size")))
    return split_nested(documents.select("doc_id", "lang", item.alias("Lines")), "Document", ["doc_id"])["Document_Lines"]


@query("split_nested_arrays", 'SELECT vec_id, unnest(range(len(embedding)))::INT AS "Cells_Ordinal", unnest(embedding) AS "Value" FROM embeddings')
def split_nested_arrays(spark, sf):
    cells = F.transform("embedding", lambda x: F.struct(x.alias("Value")))
    vectors = load(spark, sf, "embeddings").select("vec_id", "label", cells.alias("Cells"))
    return split_nested(vectors, "Vector", ["vec_id"])["Vector_Cells"]


@query(
    "nested_parts",
    r"""WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, pos // 8 AS part, count(*) AS n_lines, sum(length(line))::BIGINT AS size, md5(string_agg(md5(line), ',' ORDER BY pos)) AS digest FROM lines GROUP BY ALL""",
)
def nested_parts_query(spark, sf):
    """The lines of documents, split into a child table and gathered again in arrays of eight."""
    documents = load(spark, sf, "documents").select("doc_id", "lang", F.split("text", "\n").alias("parts"))
    item = F.transform("parts", lambda p: F.struct(F.md5(p).alias("Text"), F.length(p).alias("Size")))
    lines = split_nested(documents.select("doc_id", "lang", item.alias("Lines")), "Document", ["doc_id"])["Document_Lines"]
    parts = nested_parts(lines, ["doc_id"], "Lines_Ordinal", "lines", 8)
    size = F.aggregate("lines", F.lit(0).cast("long"), lambda total, r: total + r["Size"])
    digest = F.md5(F.array_join(F.transform("lines", lambda r: r["Text"]), ","))
    return parts.select("doc_id", "part", F.size("lines").cast("long").alias("n_lines"), size.alias("size"), digest.alias("digest"))


_SCALED = "md5(coalesce(array_to_string([CASE WHEN isfinite(x) THEN floor(x * 256)::BIGINT END FOR x IN embedding], ','), ''))"


@query("nest_children", f"SELECT vec_id, label, coalesce(len(embedding), 0)::BIGINT AS n_cells, {_SCALED} AS digest FROM embeddings")
def nest_children_query(spark, sf):
    """Vectors split into a table of cells and restored; a vector has at most 65,536 entries."""
    cells = F.transform("embedding", lambda x: F.struct(x.alias("Value")))
    vectors = load(spark, sf, "embeddings").select("vec_id", "label", cells.alias("Cells"))
    whole = join_nested(split_nested(vectors, "Vector", ["vec_id"]), "Vector", ["vec_id"], vectors.schema, 65_536)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    scaled = F.transform("Cells", lambda r: F.when(finite(r["Value"]), F.floor(r["Value"] * 256)).cast("string"))
    return whole.select("vec_id", "label", F.size("Cells").cast("long").alias("n_cells"), F.md5(F.array_join(scaled, ",")).alias("digest"))


# ---- profiles of the data -----------------------------------------------------------------

_TEXTS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "embeddings": [], "pages": ["url", "html"], "benchmark": ["text"], "labels": [], "conversations": ["role", "text"]}
_PLAIN = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"], "events": ["event_id", "ts", "user_id", "value"], "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"]}
PROFILED = list(_TEXTS)


def _profile_sql(table: str, column: str, text: bool) -> str:
    longest = f"max(length({column}))::INT" if text else "NULL::INT"
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", count(*) AS row_count, count(*) - count({column}) AS null_count, "
        f"count(DISTINCT {column}) AS distinct_count, {longest} AS max_length FROM {table}"
    )


@query(
    "profile_columns",
    " UNION ALL ".join(
        [_profile_sql(t, c, True) for t, cs in _TEXTS.items() for c in cs] + [_profile_sql(t, c, False) for t, cs in _PLAIN.items() for c in cs]
    ),
)
def profile_columns(spark, sf):
    parts = [MP.profile_columns(load(spark, sf, t), t) for t in PROFILED]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


CANDIDATES = {
    "orders": [["o_orderkey"], ["o_custkey", "o_orderdate"]],
    "lineitem": [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]],
    "customer": [["c_custkey"], ["c_name"], ["c_nationkey"]],
    "events": [["event_id"], ["user_id", "ts"]],
    "conversations": [["conv_id", "turn"], ["conv_id"]],
    "documents": [["doc_id"], ["text"]],
}


@query(
    "candidate_keys",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{','.join(cs)}' AS columns, count(*) = count(DISTINCT ({', '.join(cs)})) AND bool_and({' AND '.join(f'{c} IS NOT NULL' for c in cs)}) AS is_key FROM {t}"
        for t, sets in CANDIDATES.items()
        for cs in sets
    ),
)
def candidate_keys(spark, sf):
    whole = None
    for table, sets in CANDIDATES.items():
        part = MP.candidate_keys(load(spark, sf, table), table, sets)
        whole = part if whole is None else whole.unionByName(part)
    return whole


# Columns of the tables but for those that hold arrays; integers and texts first.
_COLUMNS = {
    "region": (["r_regionkey", "r_name"], []),
    "nation": (["n_nationkey", "n_name", "n_regionkey"], []),
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], ["c_acctbal"]),
    "supplier": (["s_suppkey", "s_name", "s_nationkey"], ["s_acctbal"]),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size"], ["p_retailprice"]),
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_orderdate"]),
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"],
    ),
    "events": (["event_id", "user_id", "event_type", "props"], ["ts", "value"]),
    "documents": (["doc_id", "text", "lang", "source", "n_chars"], []),
    "embeddings": (["vec_id", "label"], []),
    "pages": (["page_id", "url", "html"], []),
    "benchmark": (["item_id", "text"], []),
    "labels": (["doc_id", "quality", "toxic"], []),
    "conversations": (["conv_id", "turn", "role", "text"], []),
}

_KEY_SETS = " UNION ALL ".join(
    f"SELECT '{t}' AS t, [{', '.join(repr(c) for c in sorted(cs))}] AS cs, count(*) = count(DISTINCT ({', '.join(cs)})) AND coalesce(bool_and({' AND '.join(f'{c} IS NOT NULL' for c in cs)}), true) AS is_key FROM {t}"
    for t, (plain, rest) in _COLUMNS.items()
    for size in (1, 2, 3)
    for cs in combinations(plain + rest, size)
)


@query(
    "minimal_keys",
    f"""WITH k AS ({_KEY_SETS}) SELECT t AS "table", array_to_string(cs, ',') AS columns FROM k
WHERE is_key AND NOT EXISTS (SELECT 1 FROM k b WHERE b.t = k.t AND b.is_key AND len(b.cs) < len(k.cs) AND list_has_all(k.cs, b.cs))""",
)
def minimal_keys(spark, sf):
    """The smallest keys of up to three columns of every table, by name order of their columns."""
    whole = None
    for table in _COLUMNS:
        part = MP.minimal_keys(load(spark, sf, table), table)
        whole = part if whole is None else whole.unionByName(part)
    return whole.withColumn("columns", F.array_join(F.array_sort(F.split("columns", ",")), ","))


_COLUMN_VALUES = " UNION ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, left(typeof({c}), 1) = 'V' AS is_text, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, (plain, _) in _COLUMNS.items() for c in plain
)


@query(
    "inclusion_dependencies",
    f"""WITH held AS MATERIALIZED ({_COLUMN_VALUES}), sizes AS (SELECT t, c, count(*) AS n FROM held GROUP BY ALL),
met AS (SELECT a.t, a.c, b.t AS rt, b.c AS rc, count(*) AS n FROM held a JOIN held b USING (is_text, v) WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT t AS "table", c AS "column", rt AS ref_table, rc AS ref_column FROM met JOIN sizes USING (t, c, n)""",
)
def inclusion_dependencies(spark, sf):
    """References that hold between any two integer or text columns of the tables."""
    return MP.inclusion_dependencies({t: load(spark, sf, t) for t in _COLUMNS})


REFERENCES = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
]


@query(
    "fk_orphans",
    " UNION ALL ".join(
        f"SELECT '{c}.{k}->{p}.{q}' AS reference, count(*) FILTER (x.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{q} = x.{k})) AS orphans, count(*) FILTER (x.{k} IS NULL) AS nulls FROM {c} x"
        for c, k, p, q in REFERENCES
    ),
)
def fk_orphans(spark, sf):
    whole = None
    for child in dict.fromkeys(c for c, *_ in REFERENCES):
        mine = [(k, load(spark, sf, p), q, f"{c}.{k}->{p}.{q}") for c, k, p, q in REFERENCES if c == child]
        part = MP.inclusion_checks(load(spark, sf, child), mine)
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(
    "relationship_cardinality",
    " UNION ALL ".join(
        f"SELECT '{p}' AS src, '{c}' AS dst, CASE WHEN max(n) FILTER ({k} IS NOT NULL) > 1 THEN 'OneToMany' ELSE 'OneToOne' END AS rel_type, bool_and({k} IS NOT NULL) AS is_required FROM (SELECT {k}, count(*) AS n FROM {c} GROUP BY {k})"
        for c, k, p, _ in REFERENCES
    ),
)
def relationship_cardinality(spark, sf):
    whole = None
    for child in dict.fromkeys(c for c, *_ in REFERENCES):
        part = MP.cardinalities_from_data(load(spark, sf, child), [(k, p, c) for c, k, p, _ in REFERENCES if c == child])
        whole = part if whole is None else whole.unionByName(part)
    return whole
