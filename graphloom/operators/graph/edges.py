"""Joins and filters between node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import first_by
from ...functions.names import looks_like_interface
from ...functions.types import is_system_type
from ...schemas import PROJECT_REFERENCE


def project_nodes(nodes: DataFrame) -> DataFrame:
    """All nodes but packages."""
    return nodes.filter(F.col("kind") != "Package")


def edges_known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are both in the node table (the induced subgraph)."""
    src = nodes.select("graph_id", F.col("node_id").alias("src"))
    dst = nodes.select("graph_id", F.col("node_id").alias("dst"))
    return edges.join(src, ["graph_id", "src"], "left_semi").join(dst, ["graph_id", "dst"], "left_semi")


def project_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Project references between known project nodes."""
    return edges_known(project_nodes(nodes), edges.filter(F.col("edge_type") == PROJECT_REFERENCE))


def induced_subgraph(nodes: DataFrame, edges: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = nodes.join(selection.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    return kept, edges_known(kept, edges)


def drop_self_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def self_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") == F.col("dst"))


def resolve_edges(nodes: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """Edges between paths become edges between node ids; unknown ends are dropped."""
    src = nodes.select("graph_id", F.col("path").alias("src_path"), F.col("node_id").alias("src"))
    dst = nodes.select("graph_id", F.col("path").alias("dst_path"), F.col("node_id").alias("dst"))
    joined = raw_edges.join(src, ["graph_id", "src_path"]).join(dst, ["graph_id", "dst_path"])
    return joined.drop("src_path", "dst_path")


def attach_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with name, kind and version of both ends; edges with an unknown end are dropped."""
    shown = ["name", "kind", "version"]
    src = nodes.select("graph_id", F.col("node_id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in shown])
    dst = nodes.select("graph_id", F.col("node_id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in shown])
    return edges.join(src, ["graph_id", "src"]).join(dst, ["graph_id", "dst"])


def external_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets that no node row declares, once each."""
    ends = edges.select("graph_id", F.col("dst").alias("node_id")).distinct()
    return ends.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")


def with_external_nodes(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """The node table plus a member-less node per undeclared target."""
    extra = external_nodes(nodes, edges).select(
        "graph_id", "node_id", F.col("node_id").alias("name"), F.lit(kind).alias("kind")
    )
    return nodes.unionByName(extra, allowMissingColumns=True)


def drop_system_nodes(nodes: DataFrame, namespace: Column | str = "namespace", name: Column | str = "name") -> DataFrame:
    return nodes.filter(~is_system_type(namespace, name))


def reclassify_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inheritance from an interface is a realization; an undeclared target counts as an
    interface by its name."""
    kinds = nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("kind").alias("_dst_kind"))
    simple = F.regexp_extract("dst", r"([^.]*)$", 1)
    is_interface = F.when(F.col("_dst_kind").isNull(), looks_like_interface(simple)).otherwise(
        F.lower("_dst_kind") == "interface"
    )
    changed = F.when((F.col("edge_type") == "Inheritance") & is_interface, "Realization").otherwise(F.col("edge_type"))
    return edges.join(kinds, ["graph_id", "dst"], "left").withColumn("edge_type", changed).select(*edges.columns)


def dedupe_type_edges(edges: DataFrame) -> DataFrame:
    """Per source: associations are distinct on (target, label), dependencies on target; the
    first in `ordinal` order stays."""
    by_label = F.when(F.col("edge_type") == "Association", F.coalesce("label", F.lit("")))
    keyed = edges.withColumn("_label", by_label)
    rest = [c for c in edges.columns if c not in ("graph_id", "src", "dst", "edge_type", "ordinal")]
    best = keyed.groupBy("graph_id", "src", "dst", "edge_type", "_label").agg(
        first_by("ordinal", ordinal="ordinal", **{c: c for c in rest}).alias("_best")
    )
    return best.select("graph_id", "src", "dst", "edge_type", "_best.ordinal", *[f"_best.{c}" for c in rest]).select(
        *edges.columns
    )


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge of any type points to."""
    targets = edges.select("graph_id", F.col("dst").alias("node_id")).distinct()
    return nodes.join(targets, ["graph_id", "node_id"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sources = edges.select("graph_id", F.col("src").alias("node_id")).distinct()
    return nodes.join(sources, ["graph_id", "node_id"], "left_anti")
