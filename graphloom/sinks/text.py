"""Writing diagram lines and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def needs_fence(path: str) -> bool:
    """Files ending in .mmd hold the bare diagram; anything else gets a code fence."""
    return not path.lower().endswith(".mmd")


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes line tables as text, one folder per graph.

    Rows are range-partitioned by graph and position, in the order of `numbered`: a graph's lines
    lie in order in one or more part files, whose names sort in line order, so even one huge diagram
    is written by many tasks.  For very many graphs see `write_line_table`.
    """
    _placed(lines).select("graph_id", F.col("line").alias("value")).write.partitionBy("graph_id").text(path)


def write_line_table(lines: DataFrame, path: str) -> None:
    """Writes the lines of many graphs as one Parquet table (graph_id, line), in order within each
    graph over the part files; files are as many as tasks, not as graphs."""
    _placed(lines).select("graph_id", "line").write.parquet(path)


def _placed(lines: DataFrame) -> DataFrame:
    order = ["graph_id", "section", "sort_key", "line"]
    return lines.repartitionByRange(*order).sortWithinPartitions(*order)


def stats_json(stats: DataFrame, names: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """(graph_id, json): one JSON object per graph with camel-case names; depth values of
    cyclic graphs are null, `warnings` appears only where there are any.

    names: graph_id, name, path; warnings: graph_id, warnings (array of text).
    """
    rows = stats
    if names is not None:
        rows = rows.join(names.select("graph_id", F.col("name").alias("_name"), F.col("path").alias("_path")), "graph_id", "left")
    else:
        rows = rows.withColumn("_name", F.col("graph_id")).withColumn("_path", F.lit(None).cast("string"))
    fields = [
        F.col("_name").alias("solutionName"),
        F.col("_path").alias("solutionPath"),
        F.col("total_nodes").alias("totalProjectCount"),
        F.col("type_breakdown").alias("typeBreakdown"),
        F.struct(F.col("avg_depth").alias("average"), F.col("min_depth").alias("min"), F.col("max_depth").alias("max")).alias("depthStats"),
        F.transform("hotspots", lambda h: F.struct(h["name"].alias("name"), h["in_degree"].alias("inDegree"))).alias("hotspotProjects"),
        F.col("has_cycles").alias("hasCycles"),
    ]
    options = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(*fields), options)
    if warnings is None:
        return rows.select("graph_id", plain.alias("json"))
    rows = rows.join(warnings.select("graph_id", "warnings"), "graph_id", "left")
    full = F.to_json(F.struct(*fields, "warnings"), options)
    return rows.select("graph_id", F.when(F.size("warnings") > 0, full).otherwise(plain).alias("json"))
