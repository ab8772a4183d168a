"""Counts, degrees, depth statistics and the combined statistics record per graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schemas import BREAKDOWN_KINDS, PROJECT_REFERENCE
from ...storage import StageTables
from ..numbering import top_n
from .edges import project_edges, project_nodes
from .iterate import NODE, longest_path_depth


def _roster(nodes: DataFrame, graphs: DataFrame | None) -> DataFrame:
    """All graph ids: those of the roster, if there is one, and those of the nodes."""
    found = nodes.select("graph_id")
    return (found if graphs is None else found.unionByName(graphs.select("graph_id"))).distinct()


def type_breakdown(nodes: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Rows per listed kind and graph, zero where a graph has none; packages do not count.
    `graphs` (graph_id) lists graphs that may have no node."""
    per_graph = nodes.groupBy("graph_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in BREAKDOWN_KINDS]
    )
    per_graph = _roster(nodes, graphs).join(per_graph, "graph_id", "left").fillna(0)
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in BREAKDOWN_KINDS])
    return per_graph.select("graph_id", F.inline(pairs))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge rows per target, parallel edges counted; zero for unreferenced nodes."""
    hits = edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(hits, NODE, "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long")))


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    hits = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.join(hits, NODE, "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0).cast("long")))


def hotspots(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The n most referenced project nodes of each graph; unreferenced ones never appear."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return _hotspots(project_nodes(nodes), project_edges(nodes, edges), n)


def _hotspots(projects: DataFrame, links: DataFrame, n: int) -> DataFrame:
    hits = links.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    named = hits.join(projects.select(*NODE, "name"), NODE)
    order = [F.desc("in_degree"), F.asc("name"), F.asc("node_id")]
    return top_n(named, ["graph_id"], order, n, "rank").select("graph_id", "rank", "node_id", "name", "in_degree")


def depth_and_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: average (two digits, half to even), lowest and highest longest-path depth of
    its project nodes, and whether it has a cycle.  A cycle makes all depth values NULL."""
    links, _ = StageTables(nodes.sparkSession, "depths").put(project_edges(nodes, edges).select("graph_id", "src", "dst"), "links")
    return _depth_and_cycles(nodes, edges, links)


def _depth_and_cycles(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    projects = project_nodes(nodes)
    depths = longest_path_depth(projects, links)
    totals = nodes.groupBy("graph_id").agg(F.count_if(F.col("kind") != "Package").alias("total"))
    levels = depths.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("levelled"),
        F.avg("depth").alias("mean"),
        F.min("depth").alias("low"),
        F.max("depth").alias("high"),
    )
    merged = totals.join(levels, "graph_id", "left")
    # Nodes that could not be levelled lead into a cycle.
    stuck = F.coalesce("levelled", F.lit(0)) < F.col("total")
    other = _other_cyclic_graphs(nodes, edges)
    if other is not None:
        merged = merged.join(other.withColumn("_other", F.lit(True)), "graph_id", "left")
        stuck = stuck | F.coalesce("_other", F.lit(False))
    merged = merged.withColumn("has_cycles", stuck)
    kept = ~F.col("has_cycles")
    return merged.select(
        "graph_id",
        "has_cycles",
        F.when(kept, F.coalesce(F.bround("mean", 2), F.lit(0.0))).alias("avg_depth"),
        F.when(kept, F.coalesce("low", F.lit(0))).alias("min_depth"),
        F.when(kept, F.coalesce("high", F.lit(0))).alias("max_depth"),
    )


def _other_cyclic_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Graphs with a cycle that runs through packages or edges other than project references.
    Packages are sinks in built graphs, so one cheap check usually rules this out."""
    project = project_nodes(nodes).select("graph_id", F.col("node_id").alias("dst"))
    other = edges.filter(F.col("edge_type") != PROJECT_REFERENCE).join(project, ["graph_id", "dst"], "left_semi")
    packages = nodes.filter(F.col("kind") == "Package").select("graph_id", F.col("node_id").alias("src"))
    if other.isEmpty() and (packages.isEmpty() or edges.join(packages, ["graph_id", "src"], "left_semi").isEmpty()):
        return None
    proper = edges.filter(F.col("src") != F.col("dst"))
    known = nodes.select("graph_id", F.col("node_id").alias("src"))
    proper = proper.join(known, ["graph_id", "src"], "left_semi")
    ends = nodes.select(*NODE).unionByName(proper.select("graph_id", F.col("dst").alias("node_id"))).distinct()
    levelled = longest_path_depth(ends, proper)
    return ends.join(levelled, NODE, "left_anti").select("graph_id").distinct()


def has_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return depth_and_cycles(nodes, edges).select("graph_id", "has_cycles")


def graph_stats(nodes: DataFrame, edges: DataFrame, n: int = 5, graphs: DataFrame | None = None) -> DataFrame:
    """One row per graph: total, kind breakdown, depth statistics, hotspots, cycle flag.
    `graphs` (graph_id) lists graphs that may have no node: their values are zero."""
    if n < 1:
        raise ValueError("n must be at least 1")
    stage = StageTables(nodes.sparkSession, "stats")
    links, _ = stage.put(project_edges(nodes, edges).select("graph_id", "src", "dst"), "links")
    counts = nodes.groupBy("graph_id").agg(
        F.count_if(F.col("kind") != "Package").alias("total_nodes"),
        F.create_map(
            *[x for k in BREAKDOWN_KINDS for x in (F.lit(k), F.count_if(F.col("kind") == k))]
        ).alias("type_breakdown"),
    )
    # At most n rows per graph are gathered here.
    spots = _hotspots(project_nodes(nodes), links, n).groupBy("graph_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "name", "in_degree"))),
            lambda s: F.struct(s["name"].alias("name"), s["in_degree"].alias("in_degree")),
        ).alias("hotspots")
    )
    empty = F.array().cast("array<struct<name:string,in_degree:bigint>>")
    nothing = F.create_map(*[x for k in BREAKDOWN_KINDS for x in (F.lit(k), F.lit(0).cast("long"))])
    zero = {"total_nodes": F.lit(0), "type_breakdown": nothing, "avg_depth": F.lit(0.0), "min_depth": F.lit(0), "max_depth": F.lit(0), "has_cycles": F.lit(False)}
    known = counts.join(_depth_and_cycles(nodes, edges, links), "graph_id")
    known = _roster(nodes, graphs).join(known.withColumn("_known", F.lit(True)), "graph_id", "left")
    for column, value in zero.items():
        known = known.withColumn(column, F.when(F.col("_known").isNull(), value).otherwise(F.col(column)))
    return (
        known.join(spots, "graph_id", "left")
        .select(
            "graph_id",
            "total_nodes",
            "type_breakdown",
            "avg_depth",
            "min_depth",
            "max_depth",
            F.coalesce("hotspots", empty).alias("hotspots"),
            "has_cycles",
        )
    )
