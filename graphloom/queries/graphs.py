"""Dependency-graph queries.

Graphs that Spark derives from the tables:
  fk      one large graph: rows of the star tables, edges along their references
  moves   one graph per user and day: event types, edges to the next event's type
  turns   one chain per conversation
  links   one graph per page language: pages and link targets, repeats kept
  trade   one graph per order month: nations, edges along the net flow of revenue
  steps   parts, edges to the next part of the same order
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import sanitize_graph_id
from ..operators.graph import edges as GE
from ..operators.graph import iterate as GI
from ..operators.graph import metrics as GM
from ..operators.graph.tree import tree_expansion
from ..operators.numbering import label_duplicates, number_rows
from ..plans import lines as L
from ..plans.build_graph import assemble_graph, package_edges, package_nodes
from ..schemas import EDGES, NODES, PROJECT_REFERENCE, conform
from ..sinks.text import stats_json
from ..storage import StageTables
from . import load, query


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def stored(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph as stage tables, so that its derivation runs once."""
    stage = StageTables(spark, "graph")
    nodes, _ = stage.put(conform(nodes, NODES), "nodes")
    edges, _ = stage.put(conform(edges, EDGES), "edges")
    return nodes, edges


def fk_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    def rows(table: str, prefix: str, key: str, name, kind) -> DataFrame:
        return load(spark, sf, table).select(_key(prefix, key).alias("node_id"), name.alias("name"), kind.alias("kind"))

    order_kind = F.when(F.col("o_orderpriority") == "5-LOW", "Test").otherwise("Library")
    nodes = rows("region", "R", "r_regionkey", F.col("r_name"), F.lit("Other"))
    nodes = nodes.unionByName(rows("nation", "N", "n_nationkey", F.col("n_name"), F.lit("Library")))
    nodes = nodes.unionByName(rows("customer", "C", "c_custkey", F.col("c_name"), F.lit("Executable")))
    nodes = nodes.unionByName(rows("supplier", "S", "s_suppkey", F.col("s_name"), F.lit("Executable")))
    nodes = nodes.unionByName(rows("part", "P", "p_partkey", F.col("p_name"), F.lit("Library")))
    nodes = nodes.unionByName(rows("orders", "O", "o_orderkey", _key("Order#", "o_orderkey"), order_kind))

    def refs(table: str, src: tuple[str, str], dst: tuple[str, str], once: bool = False) -> DataFrame:
        # Repeats go while the keys are numbers, which are shorter to move than node ids.
        rows = load(spark, sf, table).select(src[1], dst[1])
        return (rows.distinct() if once else rows).select(_key(*src).alias("src"), _key(*dst).alias("dst"))

    edges = refs("orders", ("O", "o_orderkey"), ("C", "o_custkey"))
    edges = edges.unionByName(refs("customer", ("C", "c_custkey"), ("N", "c_nationkey")))
    edges = edges.unionByName(refs("supplier", ("S", "s_suppkey"), ("N", "s_nationkey")))
    edges = edges.unionByName(refs("nation", ("N", "n_nationkey"), ("R", "n_regionkey")))
    edges = edges.unionByName(refs("lineitem", ("O", "l_orderkey"), ("P", "l_partkey"), once=True))
    edges = edges.unionByName(refs("lineitem", ("O", "l_orderkey"), ("S", "l_suppkey"), once=True))
    return nodes.withColumn("graph_id", F.lit("fk")), edges.withColumn("graph_id", F.lit("fk")).withColumn("edge_type", F.lit(PROJECT_REFERENCE))


FK = """
fk_nodes AS (
  SELECT 'fk' AS graph_id, 'R' || r_regionkey AS node_id, r_name AS name, 'Other' AS kind FROM region
  UNION ALL SELECT 'fk', 'N' || n_nationkey, n_name, 'Library' FROM nation
  UNION ALL SELECT 'fk', 'C' || c_custkey, c_name, 'Executable' FROM customer
  UNION ALL SELECT 'fk', 'S' || s_suppkey, s_name, 'Executable' FROM supplier
  UNION ALL SELECT 'fk', 'P' || p_partkey, p_name, 'Library' FROM part
  UNION ALL SELECT 'fk', 'O' || o_orderkey, 'Order#' || o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'Test' ELSE 'Library' END FROM orders
),
fk_edges AS (
  SELECT 'fk' AS graph_id, 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'fk', 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'fk', 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'fk', 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'fk', 'O' || l_orderkey, 'P' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'fk', 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem
)"""

FK_DEPTH = """
levels(node, d) AS (
  SELECT node_id, 0 FROM fk_nodes
  UNION SELECT e.src, l.d + 1 FROM levels l JOIN fk_edges e ON e.dst = l.node
),
depths AS (SELECT node AS node_id, max(d) AS depth FROM levels GROUP BY node)"""


def fk_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return stored(spark, *fk_tables(spark, sf))


def moves_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    graph_id = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    # The events of one user and day.
    day = Window.partitionBy("graph_id").orderBy("ts", "event_id")
    ordered = events.withColumn("graph_id", graph_id).withColumn("dst", F.lead("event_type").over(day))
    ordered, _ = StageTables(spark, "moves").put(ordered.select("graph_id", "event_type", "dst").distinct(), "events")
    kind = F.when(F.col("event_type") == "error", "Test").when(F.col("event_type") == "click", "Executable").otherwise("Library")
    nodes = ordered.select("graph_id", F.col("event_type").alias("node_id"), F.col("event_type").alias("name"), kind.alias("kind")).distinct()
    edges = ordered.select("graph_id", F.col("event_type").alias("src"), "dst").filter("dst is not null")
    edges = edges.withColumn("edge_type", F.lit(PROJECT_REFERENCE))
    return stored(spark, nodes, edges)


MOVES = """
placed AS (
  SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS graph_id, event_type, ts, event_id FROM events
),
mv_nodes AS (
  SELECT DISTINCT graph_id, event_type AS node_id, event_type AS name,
         CASE event_type WHEN 'error' THEN 'Test' WHEN 'click' THEN 'Executable' ELSE 'Library' END AS kind
  FROM placed
),
mv_edges AS (
  SELECT DISTINCT graph_id, src, dst FROM (
    SELECT graph_id, event_type AS src, lead(event_type) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS dst FROM placed
  ) WHERE dst IS NOT NULL
),
mv_reach(graph_id, a, b) AS (
  SELECT graph_id, src, dst FROM mv_edges
  UNION SELECT r.graph_id, r.a, e.dst FROM mv_reach r JOIN mv_edges e ON e.graph_id = r.graph_id AND e.src = r.b
)"""


def turns_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    node = F.col("turn").cast("string")
    kind = F.when(F.col("role") == "user", "Executable").when(F.col("role") == "assistant", "Library").otherwise("Other")
    keyed = turns.select(_key("c", "conv_id").alias("graph_id"), "turn", node.alias("node_id"), F.concat_ws(" ", "role", node).alias("name"), kind.alias("kind"))
    following = keyed.select("graph_id", (F.col("turn") - 1).alias("turn"), F.col("node_id").alias("dst"))
    edges = keyed.select("graph_id", "turn", F.col("node_id").alias("src")).join(following, ["graph_id", "turn"])
    return stored(spark, keyed.drop("turn"), edges.drop("turn").withColumn("edge_type", F.lit(PROJECT_REFERENCE)))


TURNS = """
tn_nodes AS (
  SELECT 'c' || conv_id AS graph_id, turn::VARCHAR AS node_id, role || ' ' || turn::VARCHAR AS name,
         CASE role WHEN 'user' THEN 'Executable' WHEN 'assistant' THEN 'Library' ELSE 'Other' END AS kind
  FROM conversations
),
tn_edges AS (
  SELECT 'c' || a.conv_id AS graph_id, a.turn::VARCHAR AS src, b.turn::VARCHAR AS dst
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
),
tn_levels(graph_id, node, d) AS (
  SELECT graph_id, node_id, 0 FROM tn_nodes
  UNION SELECT e.graph_id, e.src, l.d + 1 FROM tn_levels l JOIN tn_edges e ON e.graph_id = l.graph_id AND e.dst = l.node
),
tn_depths AS (SELECT graph_id, node AS node_id, max(d) AS depth FROM tn_levels GROUP BY ALL)"""


def links_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = load(spark, sf, "pages")
    language = F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1)
    nodes = pages.select(language.alias("graph_id"), _key("page:", "page_id").alias("node_id"), F.col("url").alias("name"), F.lit("Library").alias("kind"))
    targets = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    edges = pages.select(language.alias("graph_id"), _key("page:", "page_id").alias("src"), F.explode(targets).alias("dst"))
    return nodes, edges.withColumn("edge_type", F.lit(PROJECT_REFERENCE))


LINKS = r"""
lk_nodes AS (
  SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS graph_id, 'page:' || page_id AS node_id, url AS name, 'Library' AS kind FROM pages
),
lk_edges AS (
  SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS graph_id, 'page:' || page_id AS src,
         unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst
  FROM pages
),
lk_all AS (
  SELECT graph_id, node_id, name, kind FROM lk_nodes
  UNION ALL
  SELECT DISTINCT graph_id, dst, dst, 'Library' FROM lk_edges e
  WHERE NOT EXISTS (SELECT 1 FROM lk_nodes n WHERE n.graph_id = e.graph_id AND n.node_id = e.dst)
)"""


def links_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = links_tables(spark, sf)
    return stored(spark, GE.with_external_nodes(nodes, edges, "Library"), edges)


def trade_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("graph_id"))
    customers = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("buyer"))
    suppliers = load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("seller"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    joined = joined.join(customers, joined.o_custkey == customers.c_custkey).join(suppliers, joined.l_suppkey == suppliers.s_suppkey)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    flows = joined.groupBy("graph_id", "buyer", "seller").agg(F.sum(cents).alias("cents"))
    # Both directions of a pair meet in one group, so the net flow needs no self-join.
    pair = flows.groupBy("graph_id", F.least("buyer", "seller").alias("a"), F.greatest("buyer", "seller").alias("b"))
    net = pair.agg(
        F.sum(F.when(F.col("buyer") <= F.col("seller"), F.col("cents")).otherwise(-F.col("cents"))).alias("net"),
        F.count(F.lit(1)).alias("directions"),
    ).filter((F.col("net") != 0) | (F.col("a") == F.col("b")))
    forward = F.col("net") > 0
    src, dst = F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a"))
    names = load(spark, sf, "nation").select("n_nationkey", "n_name")
    edges = net.select("graph_id", src.alias("s"), dst.alias("d"))
    edges = edges.join(names.select(F.col("n_nationkey").alias("s"), F.col("n_name").alias("src")), "s")
    edges = edges.join(names.select(F.col("n_nationkey").alias("d"), F.col("n_name").alias("dst")), "d")
    edges = edges.select("graph_id", "src", "dst").withColumn("edge_type", F.lit(PROJECT_REFERENCE))
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return stored(spark, ends.withColumn("name", F.col("node_id")).withColumn("kind", F.lit("Library")), edges)


TRADE = """
flows AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS graph_id, b.n_name AS buyer, s.n_name AS seller, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation b ON b.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey
  GROUP BY ALL
),
tr_edges AS (
  SELECT f.graph_id, f.buyer AS src, f.seller AS dst
  FROM flows f LEFT JOIN flows g ON g.graph_id = f.graph_id AND g.buyer = f.seller AND g.seller = f.buyer
  WHERE f.buyer = f.seller OR f.cents > coalesce(g.cents, 0)
),
tr_nodes AS (SELECT graph_id, src AS node_id FROM tr_edges UNION SELECT graph_id, dst FROM tr_edges),
tr_reach(graph_id, a, b) AS (
  SELECT graph_id, src, dst FROM tr_edges
  UNION SELECT r.graph_id, r.a, e.dst FROM tr_reach r JOIN tr_edges e ON e.graph_id = r.graph_id AND e.src = r.b
)"""


def steps_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # The lines of one order.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    edges = lines.select(_key("P", "l_partkey").alias("src"), F.lead(_key("P", "l_partkey")).over(order).alias("dst")).filter("dst is not null")
    edges = edges.select(F.lit("steps").alias("graph_id"), "src", "dst", F.lit(PROJECT_REFERENCE).alias("edge_type"))
    nodes = load(spark, sf, "part").select(F.lit("steps").alias("graph_id"), _key("P", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.lit("Library").alias("kind"))
    return stored(spark, nodes, edges)


# ---- construction -------------------------------------------------------------------------


@query(
    "build_fk_graph",
    f"WITH {FK} SELECT e.graph_id, e.src, e.dst, s.name AS src_name, d.name AS dst_name FROM fk_edges e "
    "JOIN fk_nodes s ON s.node_id = e.src JOIN fk_nodes d ON d.node_id = e.dst",
)
def build_fk_graph(spark, sf):
    """Path references resolved to node ids, joined from the raw tables."""
    nodes, raw = fk_tables(spark, sf)
    members = nodes.withColumn("path", F.col("node_id")).withColumn("ordinal", F.lit(0))
    paths = raw.select("graph_id", F.col("src").alias("src_path"), F.col("dst").alias("dst_path"))
    nodes, edges = assemble_graph(members, paths)
    return GE.attach_names(nodes, edges).select("graph_id", "src", "dst", "src_name", "dst_name")


@query("edges_named", f"WITH {LINKS} SELECT e.graph_id, s.name AS src_name, e.dst AS dst_name FROM lk_edges e JOIN lk_nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src")
def edges_named(spark, sf):
    nodes, edges = links_tables(spark, sf)
    nodes = GE.with_external_nodes(nodes, edges, "Library").withColumn("version", F.lit(None).cast("string"))
    return GE.attach_names(nodes, edges).select("graph_id", "src_name", "dst_name")


@query("edges_known", f"WITH {FK} SELECT e.graph_id, e.src, e.dst FROM fk_edges e JOIN fk_nodes s ON s.node_id = e.src AND s.kind <> 'Test' JOIN fk_nodes d ON d.node_id = e.dst AND d.kind <> 'Other'")
def edges_known(spark, sf):
    """The subgraph of non-Test sources and non-Other targets."""
    nodes, edges = fk_tables(spark, sf)
    src = nodes.filter("kind <> 'Test'").select("graph_id", F.col("node_id").alias("src"))
    kept = nodes.filter("kind <> 'Other'")
    # Edges move by source, then by target: both joins on an end share one exchange.
    sourced = edges.join(src, ["graph_id", "src"], "left_semi")
    _, induced = GE.induced_subgraph(nodes, sourced, kept.unionByName(nodes.filter("kind <> 'Test'")).distinct())
    targets = kept.select("graph_id", F.col("node_id").alias("dst"))
    return induced.join(targets, ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")


@query("external_nodes", f"WITH {LINKS} SELECT DISTINCT graph_id, dst AS node_id FROM lk_edges e WHERE NOT EXISTS (SELECT 1 FROM lk_nodes n WHERE n.graph_id = e.graph_id AND n.node_id = e.dst)")
def external_nodes(spark, sf):
    return GE.external_nodes(*links_tables(spark, sf))


@query("self_loops", f"WITH {MOVES} SELECT graph_id, src, dst FROM mv_edges WHERE src = dst")
def self_loops(spark, sf):
    return GE.self_edges(moves_graph(spark, sf)[1]).select("graph_id", "src", "dst")


PACKAGES = """
uses AS (
  SELECT p_brand AS graph_id, 'O' || l_orderkey AS src, p_name AS name, p_size::VARCHAR AS version, o_orderpriority AS framework, l_orderkey * 16 + l_linenumber AS ordinal
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


def package_uses(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = load(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("p_brand").alias("graph_id"),
        _key("O", "l_orderkey").alias("src"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("string").alias("version"),
        F.col("o_orderpriority").alias("framework"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ordinal"),
    )


@query(
    "package_nodes",
    f"WITH {PACKAGES} SELECT graph_id, sha256(name || ':' || version)[1:32] AS node_id, name, version, "
    "arg_min(framework, (ordinal, framework)) AS framework FROM uses GROUP BY graph_id, name, version",
)
def package_nodes_query(spark, sf):
    return package_nodes(package_uses(spark, sf)).select("graph_id", "node_id", "name", "version", "framework")


@query(
    "package_edges",
    f"WITH {PACKAGES} SELECT graph_id, src, sha256(name || ':' || version)[1:32] AS dst, count(*) AS uses FROM uses GROUP BY ALL",
)
def package_edges_query(spark, sf):
    return package_edges(package_uses(spark, sf)).groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("uses"))


# ---- counts and degrees -------------------------------------------------------------------


@query(
    "graph_type_breakdown",
    f"WITH {MOVES} SELECT g.graph_id, k.kind, count(n.node_id) AS n FROM (SELECT DISTINCT graph_id FROM mv_nodes) g "
    "CROSS JOIN (VALUES ('Library'), ('Executable'), ('Test'), ('Other')) k(kind) "
    "LEFT JOIN mv_nodes n ON n.graph_id = g.graph_id AND n.kind = k.kind GROUP BY ALL",
)
def graph_type_breakdown(spark, sf):
    return GM.type_breakdown(moves_graph(spark, sf)[0])


@query("graph_in_degree", f"WITH {LINKS} SELECT a.graph_id, a.node_id, count(e.src) AS in_degree FROM lk_all a LEFT JOIN lk_edges e ON e.graph_id = a.graph_id AND e.dst = a.node_id GROUP BY ALL")
def graph_in_degree(spark, sf):
    """Repeated links count once each."""
    nodes, edges = links_graph(spark, sf)
    return GM.in_degree(nodes, edges).select("graph_id", "node_id", "in_degree")


@query(
    "graph_hotspots",
    f"WITH {FK}, hits AS (SELECT e.dst, count(*) AS in_degree FROM fk_edges e GROUP BY 1) "
    "SELECT 'fk' AS graph_id, rank::INT AS rank, node_id, name, in_degree FROM (SELECT n.node_id, n.name, h.in_degree, "
    "row_number() OVER (ORDER BY h.in_degree DESC, n.name, n.node_id) AS rank FROM hits h JOIN fk_nodes n ON n.node_id = h.dst) WHERE rank <= 5",
)
def graph_hotspots(spark, sf):
    return GM.hotspots(*fk_tables(spark, sf), n=5)


@query(
    "link_hotspots",
    f"WITH {LINKS}, hits AS (SELECT graph_id, dst, count(*) AS in_degree FROM lk_edges GROUP BY ALL) "
    "SELECT graph_id, rank::INT AS rank, node_id, in_degree FROM (SELECT graph_id, dst AS node_id, in_degree, "
    "row_number() OVER (PARTITION BY graph_id ORDER BY in_degree DESC, dst) AS rank FROM hits) WHERE rank <= 3",
)
def link_hotspots(spark, sf):
    """The three most linked targets per page language."""
    return GM.hotspots(*links_graph(spark, sf), n=3).select("graph_id", "rank", "node_id", "in_degree")


@query(
    "graph_direct_refs",
    f"WITH {FK} SELECT e.graph_id, e.src, count(*) AS out_degree, min(d.name) AS first_ref, max(d.name) AS last_ref FROM fk_edges e JOIN fk_nodes d ON d.node_id = e.dst GROUP BY ALL",
)
def graph_direct_refs(spark, sf):
    """Number of direct references per node with the first and last of them by name."""
    nodes, edges = fk_tables(spark, sf)
    named = GE.attach_names(nodes.withColumn("version", F.lit(None).cast("string")), edges)
    return named.groupBy("graph_id", "src").agg(
        F.count(F.lit(1)).alias("out_degree"), F.min("dst_name").alias("first_ref"), F.max("dst_name").alias("last_ref")
    )


@query(
    "graph_out_degree",
    f"WITH {MOVES} SELECT n.graph_id, n.node_id, count(e.dst) AS out_degree FROM mv_nodes n LEFT JOIN mv_edges e ON e.graph_id = n.graph_id AND e.src = n.node_id GROUP BY ALL",
)
def graph_out_degree(spark, sf):
    nodes, edges = moves_graph(spark, sf)
    return GM.out_degree(nodes, edges).select("graph_id", "node_id", "out_degree")


# ---- statistics ---------------------------------------------------------------------------

_STATS_COLUMNS = "graph_id, total_nodes, library_count, executable_count, test_count, other_count, avg_depth, min_depth, max_depth, has_cycles, hotspots"


def _flat_stats(stats: DataFrame) -> DataFrame:
    spots = F.array_join(F.transform("hotspots", lambda h: F.concat_ws(":", h["name"], h["in_degree"].cast("string"))), ", ")
    counts = [F.col("type_breakdown")[k].alias(f"{k.lower()}_count") for k in ("Library", "Executable", "Test", "Other")]
    return stats.select(
        "graph_id", "total_nodes", *counts, "avg_depth", "min_depth", "max_depth", "has_cycles", spots.alias("hotspots")
    )


def _stats_sql(nodes: str, edges: str, depths: str, cyclic: str) -> str:
    """SQL of the statistics record; `cyclic` selects the graph ids that have a cycle."""
    return f"""
kinds AS (
  SELECT graph_id, count(*) AS total_nodes, count(*) FILTER (kind = 'Library') AS library_count, count(*) FILTER (kind = 'Executable') AS executable_count,
         count(*) FILTER (kind = 'Test') AS test_count, count(*) FILTER (kind = 'Other') AS other_count
  FROM {nodes} GROUP BY graph_id
),
cyclic AS ({cyclic}),
spread AS (SELECT graph_id, round_even(avg(depth), 2) AS avg_depth, min(depth) AS min_depth, max(depth) AS max_depth FROM {depths} GROUP BY graph_id),
ranked AS (
  SELECT n.graph_id, n.name, h.in_degree, row_number() OVER (PARTITION BY n.graph_id ORDER BY h.in_degree DESC, n.name, n.node_id) AS rank
  FROM (SELECT graph_id, dst, count(*) AS in_degree FROM {edges} GROUP BY ALL) h JOIN {nodes} n ON n.graph_id = h.graph_id AND n.node_id = h.dst
),
spots AS (SELECT graph_id, string_agg(name || ':' || in_degree, ', ' ORDER BY rank) AS hotspots FROM ranked WHERE rank <= 5 GROUP BY graph_id),
stats AS (
  SELECT k.*, CASE WHEN c.graph_id IS NULL THEN s.avg_depth END AS avg_depth, CASE WHEN c.graph_id IS NULL THEN s.min_depth END AS min_depth,
         CASE WHEN c.graph_id IS NULL THEN s.max_depth END AS max_depth, c.graph_id IS NOT NULL AS has_cycles, coalesce(p.hotspots, '') AS hotspots
  FROM kinds k LEFT JOIN cyclic c ON c.graph_id = k.graph_id LEFT JOIN spread s ON s.graph_id = k.graph_id LEFT JOIN spots p ON p.graph_id = k.graph_id
)"""


# Paths inside graphs without cycles; graphs with a cycle would never end.
MOVES_DEPTH = """
mv_cyclic AS (SELECT DISTINCT graph_id FROM mv_reach WHERE a = b),
mv_levels(graph_id, node, d) AS (
  SELECT graph_id, node_id, 0 FROM mv_nodes WHERE graph_id NOT IN (SELECT graph_id FROM mv_cyclic)
  UNION SELECT e.graph_id, e.src, l.d + 1 FROM mv_levels l JOIN mv_edges e ON e.graph_id = l.graph_id AND e.dst = l.node
),
mv_depths AS (SELECT graph_id, node AS node_id, max(d) AS depth FROM mv_levels GROUP BY ALL)"""

_FK_STATS = _stats_sql("fk_nodes", "fk_edges", "(SELECT 'fk' AS graph_id, depth FROM depths)", "SELECT '' AS graph_id WHERE false")
_MOVES_STATS = _stats_sql("mv_nodes", "mv_edges", "mv_depths", "SELECT graph_id FROM mv_cyclic")


@query("graph_stats", f"WITH RECURSIVE {FK}, {FK_DEPTH}, {_FK_STATS} SELECT {_STATS_COLUMNS} FROM stats")
def graph_stats(spark, sf):
    return _flat_stats(GM.graph_stats(*fk_graph(spark, sf)))


_MOVES_DAYS = """
days AS (
  SELECT user_id || '|' || strftime(d, '%Y-%m-%d') AS graph_id
  FROM (SELECT user_id, unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS d FROM events GROUP BY user_id)
),
every AS (
  SELECT graph_id, coalesce(total_nodes, 0) AS total_nodes, coalesce(library_count, 0) AS library_count, coalesce(executable_count, 0) AS executable_count,
         coalesce(test_count, 0) AS test_count, coalesce(other_count, 0) AS other_count, CASE WHEN total_nodes IS NULL THEN 0.0 ELSE avg_depth END AS avg_depth,
         CASE WHEN total_nodes IS NULL THEN 0 ELSE min_depth END AS min_depth, CASE WHEN total_nodes IS NULL THEN 0 ELSE max_depth END AS max_depth, coalesce(has_cycles, false) AS has_cycles, coalesce(hotspots, '') AS hotspots
  FROM days LEFT JOIN stats USING (graph_id)
)"""


@query("graph_stats_moves", f"WITH RECURSIVE {MOVES}, {MOVES_DEPTH}, {_MOVES_STATS}, {_MOVES_DAYS} SELECT {_STATS_COLUMNS} FROM every")
def graph_stats_moves(spark, sf):
    """The statistics of thousands of small graphs in one job: every day from the first to the last
    event of a user, also those without an event."""
    span = load(spark, sf, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    days = span.select("user_id", F.explode(F.sequence("a", "b")).alias("d"))
    graphs = days.select(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("d", "yyyy-MM-dd")).alias("graph_id"))
    return _flat_stats(GM.graph_stats(*moves_graph(spark, sf), graphs=graphs))


@query(
    "graph_stats_json",
    f"""WITH RECURSIVE {MOVES}, {MOVES_DEPTH}, {_MOVES_STATS},
named AS (SELECT graph_id, string_agg('{{"name":"' || name || '","inDegree":' || in_degree || '}}', ',' ORDER BY rank) AS listed FROM ranked WHERE rank <= 5 GROUP BY graph_id)
SELECT s.graph_id, '{{"solutionName":"' || s.graph_id || '","solutionPath":null,"totalProjectCount":' || total_nodes || ',"typeBreakdown":{{"Library":' || library_count
  || ',"Executable":' || executable_count || ',"Test":' || test_count || ',"Other":' || other_count || '}},"depthStats":{{"average":' || coalesce(avg_depth::VARCHAR, 'null')
  || ',"min":' || coalesce(min_depth::VARCHAR, 'null') || ',"max":' || coalesce(max_depth::VARCHAR, 'null') || '}},"hotspotProjects":[' || coalesce(listed, '')
  || '],"hasCycles":' || has_cycles::VARCHAR || '}}' AS json
FROM stats s LEFT JOIN named n ON n.graph_id = s.graph_id""",
)
def graph_stats_json(spark, sf):
    return stats_json(GM.graph_stats(*moves_graph(spark, sf)))


@query(
    "graph_depth_stats",
    f"WITH RECURSIVE {TURNS} SELECT graph_id, round_even(avg(depth), 2) AS avg_depth, min(depth) AS min_depth, max(depth) AS max_depth FROM tn_depths GROUP BY graph_id",
)
def graph_depth_stats(spark, sf):
    return GM.depth_and_cycles(*turns_graph(spark, sf)).select("graph_id", "avg_depth", "min_depth", "max_depth")


@query("graph_has_cycles", f"WITH RECURSIVE {MOVES} SELECT n.graph_id, bool_or(r.a IS NOT NULL) AS has_cycles FROM mv_nodes n LEFT JOIN mv_reach r ON r.graph_id = n.graph_id AND r.a = n.node_id AND r.b = n.node_id GROUP BY ALL")
def graph_has_cycles(spark, sf):
    return GM.has_cycles(*moves_graph(spark, sf))


# ---- iterative operators ------------------------------------------------------------------


@query("graph_depth", f"WITH RECURSIVE {FK}, {FK_DEPTH} SELECT 'fk' AS graph_id, node_id, depth FROM depths")
def graph_depth(spark, sf):
    return GI.longest_path_depth(*fk_graph(spark, sf))


@query("graph_depth_turns", f"WITH RECURSIVE {TURNS} SELECT graph_id, node_id, depth FROM tn_depths")
def graph_depth_turns(spark, sf):
    return GI.longest_path_depth(*turns_graph(spark, sf))


@query(
    "graph_levels",
    f"WITH RECURSIVE {FK}, up(node, d) AS (SELECT node_id, 0 FROM fk_nodes UNION SELECT e.dst, u.d + 1 FROM up u JOIN fk_edges e ON e.src = u.node) "
    "SELECT 'fk' AS graph_id, node AS node_id, max(d) AS level FROM up GROUP BY node",
)
def graph_levels(spark, sf):
    return GI.topological_level(*fk_graph(spark, sf))


@query("graph_roots", f"WITH {FK} SELECT graph_id, node_id, name FROM fk_nodes n WHERE NOT EXISTS (SELECT 1 FROM fk_edges e WHERE e.dst = n.node_id)")
def graph_roots(spark, sf):
    return GE.roots(*fk_graph(spark, sf)).select("graph_id", "node_id", "name")


@query("graph_leaves", f"WITH {FK} SELECT graph_id, node_id, name FROM fk_nodes n WHERE NOT EXISTS (SELECT 1 FROM fk_edges e WHERE e.src = n.node_id)")
def graph_leaves(spark, sf):
    return GE.leaves(*fk_graph(spark, sf)).select("graph_id", "node_id", "name")


@query(
    "reachable_from",
    f"WITH RECURSIVE {FK}, seen(node) AS (SELECT node_id FROM fk_nodes WHERE kind = 'Test' UNION SELECT e.dst FROM seen s JOIN fk_edges e ON e.src = s.node) "
    "SELECT 'fk' AS graph_id, node AS node_id FROM seen",
)
def reachable_from(spark, sf):
    nodes, edges = fk_graph(spark, sf)
    return GI.reachable_from(edges, nodes.filter("kind = 'Test'")).select("graph_id", "node_id")


_BFS = """
hops(node, d) AS (
  SELECT node_id, 0 FROM fk_nodes WHERE kind = 'Test'
  UNION SELECT e.dst, h.d + 1 FROM hops h JOIN fk_edges e ON e.src = h.node WHERE h.d < 2
),
found AS (SELECT node, min(d) AS depth FROM hops GROUP BY node)"""


@query("bounded_bfs", f"WITH RECURSIVE {FK}, {_BFS} SELECT 'fk' AS graph_id, node AS node_id, depth FROM found")
def bounded_bfs(spark, sf):
    nodes, edges = fk_graph(spark, sf)
    return GI.bounded_bfs(nodes, edges, nodes.filter("kind = 'Test'"), 2)[0]


@query("bounded_bfs_edges", f"WITH RECURSIVE {FK}, {_BFS} SELECT e.graph_id, e.src, e.dst FROM fk_edges e JOIN found f ON f.node = e.src AND f.depth < 2")
def bounded_bfs_edges(spark, sf):
    nodes, edges = fk_graph(spark, sf)
    return GI.bounded_bfs(nodes, edges, nodes.filter("kind = 'Test'"), 2)[1].select("graph_id", "src", "dst")


def _scc_sql(nodes: str, reach: str) -> str:
    return (
        f"SELECT n.graph_id, n.node_id, coalesce(min(f.b) FILTER (f.b < n.node_id), n.node_id) AS component FROM {nodes} n "
        f"LEFT JOIN (SELECT f.graph_id, f.a, f.b FROM {reach} f JOIN {reach} g ON g.graph_id = f.graph_id AND g.a = f.b AND g.b = f.a) f "
        "ON f.graph_id = n.graph_id AND f.a = n.node_id GROUP BY n.graph_id, n.node_id"
    )


@query("graph_scc", f"WITH RECURSIVE {MOVES} {_scc_sql('mv_nodes', 'mv_reach')}")
def graph_scc(spark, sf):
    return GI.strong_components(*moves_graph(spark, sf))


@query("graph_scc_trade", f"WITH RECURSIVE {TRADE} {_scc_sql('tr_nodes', 'tr_reach')}")
def graph_scc_trade(spark, sf):
    return GI.strong_components(*trade_graph(spark, sf))


@query("graph_cyclic_nodes", f"WITH RECURSIVE {MOVES} SELECT DISTINCT graph_id, a AS node_id FROM mv_reach WHERE a = b")
def graph_cyclic_nodes(spark, sf):
    return GI.cyclic_nodes(*moves_graph(spark, sf))


@query("graph_cyclic_trade", f"WITH RECURSIVE {TRADE} SELECT DISTINCT graph_id, a AS node_id FROM tr_reach WHERE a = b")
def graph_cyclic_trade(spark, sf):
    return GI.cyclic_nodes(*trade_graph(spark, sf))


@query(
    "graph_scc_steps",
    """WITH RECURSIVE steps AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst FROM lineitem
),
hops AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL AND dst <> src),
far(a, b) AS (SELECT src, dst FROM hops UNION SELECT f.a, h.dst FROM far f JOIN hops h ON h.src = f.b)
SELECT 'steps' AS graph_id, 'P' || p_partkey AS node_id, least('P' || p_partkey, coalesce(min('P' || f.b), 'P' || p_partkey)) AS component
FROM part LEFT JOIN (SELECT x.a, x.b FROM far x JOIN far y ON y.a = x.b AND y.b = x.a) f ON f.a = p_partkey GROUP BY p_partkey""",
)
def graph_scc_steps(spark, sf):
    """Components of the large part graph."""
    return GI.strong_components(*steps_graph(spark, sf))


@query(
    "min_reaching",
    f"WITH RECURSIVE {TRADE} SELECT n.graph_id, n.node_id, least(n.node_id, coalesce(min(r.a), n.node_id)) AS min_src FROM tr_nodes n "
    "LEFT JOIN tr_reach r ON r.graph_id = n.graph_id AND r.b = n.node_id GROUP BY n.graph_id, n.node_id",
)
def min_reaching(spark, sf):
    return GI.min_reaching(*trade_graph(spark, sf))


_BASES = """
ups(graph_id, seed, base, level) AS (
  SELECT graph_id, src, dst, 1 FROM tn_edges
  UNION SELECT u.graph_id, u.seed, e.dst, u.level + 1 FROM ups u JOIN tn_edges e ON e.graph_id = u.graph_id AND e.src = u.base
)"""


def _as_inheritance(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_type", F.lit("Inheritance"))


@query("base_closure", f"WITH RECURSIVE {TURNS}, {_BASES} SELECT graph_id, seed, base, min(level) AS level FROM ups GROUP BY ALL")
def base_closure(spark, sf):
    """Each turn derives from the next one of its conversation."""
    nodes, edges = turns_graph(spark, sf)
    return GI.base_closure(_as_inheritance(edges), nodes)


_TURN_WORDS = r"""
words AS (
  SELECT graph_id, node_id, name, min(ordinal) AS ordinal FROM (
    SELECT 'c' || conv_id AS graph_id, turn::VARCHAR AS node_id, unnest(list) AS name, unnest(range(1, len(list) + 1)) AS ordinal
    FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}]+') AS list FROM conversations)
  ) GROUP BY ALL
)"""


@query(
    "inherited_members",
    f"WITH RECURSIVE {TURNS}, {_BASES}, {_TURN_WORDS}, spread AS (SELECT graph_id, seed, base, level FROM ups UNION ALL SELECT graph_id, node_id, node_id, 0 FROM tn_nodes) "
    "SELECT s.graph_id, s.seed AS node_id, w.name, arg_min(w.ordinal, (s.level, w.ordinal))::BIGINT AS ordinal, min(s.level)::INT AS level, arg_min(s.base, (s.level, w.ordinal)) AS declared_in "
    "FROM spread s JOIN words w ON w.graph_id = s.graph_id AND w.node_id = s.base GROUP BY ALL",
)
def inherited_members(spark, sf):
    """The words of a turn are its members; the nearest turn that has a word wins."""
    nodes, edges = turns_graph(spark, sf)
    texts = load(spark, sf, "conversations").select(
        _key("c", "conv_id").alias("graph_id"),
        F.col("turn").cast("string").alias("node_id"),
        F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), 0)).alias("pos", "name"),
    )
    members = texts.groupBy("graph_id", "node_id", "name").agg((F.min("pos") + 1).cast("long").alias("ordinal"))
    found = GI.inherited_members(members, _as_inheritance(edges))
    return found.select("graph_id", "node_id", "name", "ordinal", F.col("level").cast("int").alias("level"), "declared_in")


# ---- trees and lines ----------------------------------------------------------------------

# Every simple path from every root, by graph; a node's place is its smallest path.
_TREE = """
mv_kinds AS (SELECT *, CASE kind WHEN 'Library' THEN 0 WHEN 'Executable' THEN 1 WHEN 'Test' THEN 2 ELSE 3 END AS kind_rank FROM mv_nodes),
top AS (SELECT * FROM mv_kinds n WHERE NOT EXISTS (SELECT 1 FROM mv_edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_id)),
walks(graph_id, node, path, key) AS (
  SELECT graph_id, node_id, [node_id], ['0' || kind_rank || node_id] FROM top
  UNION ALL
  SELECT n.graph_id, n.node_id, [n.node_id], ['1' || n.node_id] FROM mv_kinds n
  UNION ALL
  SELECT w.graph_id, e.dst, list_append(w.path, e.dst), list_append(w.key, e.dst) FROM walks w JOIN mv_edges e ON e.graph_id = w.graph_id AND e.src = w.node
  WHERE NOT list_contains(w.path, e.dst)
),
labels AS (SELECT graph_id, node, min(key) AS key, arg_min(path, key) AS path FROM walks GROUP BY ALL),
tree AS (
  SELECT graph_id, node AS node_id, key, path, 0 AS depth, 'root' AS marker FROM labels WHERE len(path) = 1
  UNION ALL
  SELECT e.graph_id, e.dst, list_append(u.key, e.dst), list_append(u.path, e.dst), len(u.path),
         CASE WHEN list_contains(u.path, e.dst) THEN 'cycle' WHEN v.key = list_append(u.key, e.dst) THEN 'expand' ELSE 'see above' END
  FROM mv_edges e JOIN labels u ON u.graph_id = e.graph_id AND u.node = e.src JOIN labels v ON v.graph_id = e.graph_id AND v.node = e.dst
)"""


@query(
    "tree_rows",
    f"""WITH RECURSIVE {MOVES}, {_TREE}
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY key) AS seq, depth::INT AS depth,
  CASE WHEN depth > 0 THEN path[-2] END AS parent, node_id, marker FROM tree""",
)
def tree_rows(spark, sf):
    rows = tree_expansion(*moves_graph(spark, sf))
    return number_rows(rows, ["graph_id"], ["place"]).select("graph_id", "seq", "depth", "parent", "node_id", "marker")


@query(
    "tree_lines",
    f"""WITH RECURSIVE {MOVES}, {_TREE},
out AS (
  SELECT graph_id, 0 AS section, [] AS key, 0 AS pos, 'Projects' AS line FROM (SELECT DISTINCT graph_id FROM mv_nodes)
  UNION ALL SELECT graph_id, 1, key, 0, '' FROM tree WHERE marker = 'root'
  UNION ALL
  SELECT t.graph_id, 1, key, 1, repeat('    ', depth::INT) || CASE WHEN marker = 'root' THEN CASE node_id WHEN 'click' THEN '🚀 ' WHEN 'error' THEN '🧪 ' ELSE '🔷 ' END ELSE '' END
    || node_id || CASE marker WHEN 'cycle' THEN ' (cycle detected)' WHEN 'see above' THEN ' (see above)' ELSE '' END
  FROM tree t
  UNION ALL SELECT DISTINCT graph_id, 2, [], 0, '' FROM mv_reach WHERE a = b
  UNION ALL SELECT DISTINCT graph_id, 2, [], 1, '⚠ Cycles detected! The projects in red are part of a circular dependency.' FROM mv_reach WHERE a = b
)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY section, key, pos) AS seq, line FROM out""",
)
def tree_lines(spark, sf):
    return L.numbered(L.tree_lines(*moves_graph(spark, sf)))


@query(
    "flat_lines",
    f"""WITH RECURSIVE {MOVES},
ordered AS (
  SELECT *, CASE kind WHEN 'Library' THEN 0 WHEN 'Executable' THEN 1 WHEN 'Test' THEN 2 ELSE 3 END AS kind_rank FROM mv_nodes
),
listed AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY kind_rank DESC, node_id DESC) = 1 AS is_last FROM ordered),
refs AS (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id, src ORDER BY dst DESC) = 1 AS is_last FROM mv_edges),
out AS (
  SELECT graph_id, 0 AS section, 0 AS kind_rank, '' AS node, '' AS ref, 'Projects' AS line FROM (SELECT DISTINCT graph_id FROM mv_nodes)
  UNION ALL
  SELECT graph_id, 1, kind_rank, node_id, '', CASE WHEN is_last THEN '└── ' ELSE '├── ' END || CASE node_id WHEN 'click' THEN '🚀 ' WHEN 'error' THEN '🧪 ' ELSE '🔷 ' END || node_id FROM listed
  UNION ALL
  SELECT r.graph_id, 1, l.kind_rank, l.node_id, r.dst, CASE WHEN l.is_last THEN '    ' ELSE '│   ' END || CASE WHEN r.is_last THEN '└── ' ELSE '├── ' END || '→ ' || r.dst
  FROM refs r JOIN listed l ON l.graph_id = r.graph_id AND l.node_id = r.src
  UNION ALL SELECT DISTINCT graph_id, 2, 0, '', '', '' FROM mv_reach WHERE a = b
  UNION ALL SELECT DISTINCT graph_id, 2, 0, '', '1', '⚠ Cycles detected! The projects in red are part of a circular dependency.' FROM mv_reach WHERE a = b
)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY section, kind_rank, node, ref) AS seq, line FROM out""",
)
def flat_lines(spark, sf):
    return L.numbered(L.flat_lines(*moves_graph(spark, sf)))


@query(
    "mermaid_graph_lines",
    f"""WITH {FK},
ids AS (SELECT *, translate(name, '.- ', '___') AS base, count(*) OVER (PARTITION BY translate(name, '.- ', '___')) AS same FROM fk_nodes),
named AS (SELECT *, CASE WHEN same > 1 THEN base || '_' || node_id ELSE base END AS id FROM ids),
out AS (
  SELECT 0 AS section, i AS pos, '' AS a, '' AS b, '' AS c, '' AS d, line FROM (VALUES (1, '```mermaid'), (2, '---'), (3, 'title: fk'), (4, '---'), (5, 'graph TD')) v(i, line)
  UNION ALL
  SELECT 2, 0, name, node_id, '', '', '    ' || id || '["' || replace(name || CASE kind WHEN 'Executable' THEN ' (Exe)' WHEN 'Test' THEN ' (Test)' ELSE '' END, '"', '#quot;') || '"]' FROM named
  UNION ALL
  SELECT 4, 0, s.name, t.name, e.src, e.dst, '    ' || s.id || ' --> ' || t.id FROM fk_edges e JOIN named s ON s.node_id = e.src JOIN named t ON t.node_id = e.dst
  UNION ALL SELECT 9, 0, '', '', '', '', '```'
)
SELECT 'fk' AS graph_id, row_number() OVER (ORDER BY section, pos, a, b, c, d) AS seq, line FROM out""",
)
def mermaid_graph_lines(spark, sf):
    """One diagram of the whole graph: a single group that holds every line."""
    nodes, edges = fk_graph(spark, sf)
    return L.numbered(L.mermaid_graph_lines(nodes, edges, title=F.col("graph_id")))


@query(
    "graph_node_ids",
    f"""WITH {FK} SELECT graph_id, node_id, count(*) OVER (PARTITION BY graph_id, translate(name, '.- ', '___')) AS collisions,
CASE WHEN count(*) OVER (PARTITION BY graph_id, translate(name, '.- ', '___')) > 1 THEN translate(name, '.- ', '___') || '_' || node_id ELSE translate(name, '.- ', '___') END AS diagram_id FROM fk_nodes""",
)
def graph_node_ids(spark, sf):
    nodes, _ = fk_tables(spark, sf)
    return L.graph_node_ids(nodes).select("graph_id", "node_id", "collisions", "diagram_id")


@query(
    "label_duplicates",
    """SELECT p_brand AS group_id, p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS label
FROM (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)""",
)
def label_duplicates_query(spark, sf):
    parts = load(spark, sf, "part").select(F.col("p_brand").alias("group_id"), "p_partkey", "p_name")
    return label_duplicates(parts, "p_name", ["group_id"], ["p_partkey"], "label").select("group_id", "p_partkey", "label")


@query("sanitized_names", "SELECT DISTINCT translate(p_type || ' ' || p_brand || '-' || p_name || '.' || p_size, '.- ', '___') AS diagram_id FROM part")
def sanitized_names(spark, sf):
    name = F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"), F.lit("-"), F.col("p_name"), F.lit("."), F.col("p_size").cast("string"))
    return load(spark, sf, "part").select(sanitize_graph_id(name).alias("diagram_id")).distinct()
