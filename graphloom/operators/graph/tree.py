"""Depth-first tree expansion without a depth-first walk.

Preorder with name-ordered siblings first meets a node along the smallest simple path that
leads to it, and every prefix of that path is itself smallest.  A node with a single edge in
can only be met through it, so such nodes hang in run trees below the others, the anchors.  The
rows of a run tree are numbered in preorder by pointer doubling, whatever its depth; a path is
then the row number at which it leaves each run tree, which sorts as the path itself does.  Only
anchors take part in the search for smallest paths, and a label is as long as the number of anchors on
the path, not as its depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.marks import kind_rank
from ...storage import StageTables
from ..numbering import number_rows, repeat_rows, running_marks
from .edges import edges_known, roots
from .iterate import NODE, follow, min_reaching, relax

# A row number above all others; rows behind a subtree stand there.
BEHIND = 1 << 62


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _preorder(stage: StageTables, links: DataFrame, inner: DataFrame) -> DataFrame:
    """Links with their row number `pos` (from 1) in preorder of their run tree, and `stop`, the last
    row number below them.

    links: graph_id, src, dst, dst_name; inner: graph_id, node_id of the nodes with one edge in that
    hang below an anchor.  Children stand in the order of (dst_name, dst).  The rows of a node are cut
    behind each child that has children of its own: a piece (node, m) holds the node's own row if m is 0, and
    the childless rows behind its m-th such child.  Pieces are linked to the one before them, and
    their first row numbers are sums along these pointers.
    """
    parents = links.select("graph_id", F.col("src").alias("dst")).distinct()
    heads = inner.select("graph_id", F.col("node_id").alias("dst")).join(parents, ["graph_id", "dst"], "left_semi")
    heads, seen = stage.put(heads.withColumn("big", F.lit(True)), "heads", n=F.count(F.lit(1)))
    if not seen["n"]:
        rows = number_rows(links, ["graph_id", "src"], ["dst_name", "dst"], "pos")
        return rows.select("graph_id", "src", "dst", "pos", F.col("pos").alias("stop"))
    items = links.join(heads, ["graph_id", "dst"], "left").select("graph_id", "src", "dst", "dst_name", "big")
    mark = F.col("big").isNotNull() & (F.col("src") != F.col("dst"))
    items = running_marks(items, ["graph_id", "src"], ["dst_name", "dst"], mark)
    own = heads.select("graph_id", F.col("dst").alias("src"), F.lit(1).alias("own"))
    items = items.join(own, ["graph_id", "src"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # The node's own row comes first in its piece 0.
    place = F.col("row") - F.col("at") + F.when(F.col("marks") == 0, F.col("own")).otherwise(0)
    numbered = items.select(
        "graph_id", "src", "dst", mark.alias("big"), F.when(mark, F.col("marks")).alias("m"),
        F.when(mark, F.struct(F.col("dst").alias("node"), _long(0).alias("m")))
        .otherwise(F.struct(F.col("src").alias("node"), F.col("marks").alias("m"))).alias("piece"),
        F.when(mark, _long(1)).otherwise(place).alias("place"),
    )
    numbered, _ = stage.put(numbered, "pieces")
    big = numbered.filter("big").select("graph_id", "src", "dst", "m")
    sizes = numbered.groupBy("graph_id", F.col("piece").alias("to_id")).agg(F.count(F.lit(1)).alias("weight"))
    last = big.groupBy("graph_id", F.col("src").alias("dst")).agg(F.max("m").alias("last"))
    ends = big.join(last, ["graph_id", "dst"], "left").withColumn("last", F.coalesce("last", _long(0)))
    down = F.struct(
        F.struct(F.col("dst").alias("node"), _long(0).alias("m")).alias("node_id"),
        F.struct(F.col("src").alias("node"), (F.col("m") - 1).alias("m")).alias("to_id"),
    )
    back = F.struct(
        F.struct(F.col("src").alias("node"), F.col("m").alias("m")).alias("node_id"),
        F.struct(F.col("dst").alias("node"), F.col("last").alias("m")).alias("to_id"),
    )
    pointers = ends.select("graph_id", F.explode(F.array(down, back)).alias("p")).select("graph_id", "p.node_id", "p.to_id")
    pointers = pointers.join(sizes, ["graph_id", "to_id"], "left").select(*NODE, "to_id", F.coalesce("weight", _long(0)).alias("weight"))
    pointers, _ = stage.put(pointers, "pointers")
    starts, _ = follow(stage, pointers, "starts")
    starts = starts.select("graph_id", F.col("node_id").alias("piece"), F.col("steps").alias("before"))
    numbered = numbered.join(starts, ["graph_id", "piece"], "left")
    numbered = numbered.withColumn("pos", F.col("place") + F.coalesce("before", _long(0)))
    # The last row below a child with children of its own ends the last piece of that child.
    final = ends.select("graph_id", "src", "dst", F.struct(F.col("dst").alias("node"), F.col("last").alias("m")).alias("piece"))
    final = final.join(starts, ["graph_id", "piece"], "left")
    final = final.join(sizes.withColumnRenamed("to_id", "piece"), ["graph_id", "piece"], "left")
    final = final.select("graph_id", "src", "dst", (F.coalesce("before", _long(0)) + F.coalesce("weight", _long(0))).alias("stop"))
    numbered = numbered.join(final, ["graph_id", "src", "dst"], "left")
    return numbered.select("graph_id", "src", "dst", "pos", F.coalesce("stop", "pos").alias("stop"))


def _place(stage: StageTables, links: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the nodes and links stand below the roots: (labels, items).  Every node is reached.

    links: graph_id, src, dst, dst_name; top: graph_id, node_id, seq (order of the roots).  labels:
    graph_id, node_id, label for each anchor; a label is an array of (pos, depth, id): the root,
    then the row by which the path enters each further anchor.  items: links with anchor, pos, stop, depth
    below the anchor and `inner`, true where the link is the only one into its target.
    """
    proper = links.filter("src <> dst")
    into = proper.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to_id"))
    single = into.filter("n = 1").join(top.select(*NODE), NODE, "left_anti").select(*NODE, "to_id")
    single, _ = stage.put(single, "single")
    inner, _ = follow(stage, single, "runs")
    inner = inner.select(*NODE, F.col("to_id").alias("anchor"), F.col("steps").cast("int").alias("depth"))
    placed = _preorder(stage, links, inner)
    above = inner.select("graph_id", F.col("node_id").alias("src"), "anchor", F.col("depth").alias("above"))
    below = inner.select("graph_id", F.col("node_id").alias("dst"), F.lit(True).alias("inner"))
    items = placed.join(above, ["graph_id", "src"], "left").join(below, ["graph_id", "dst"], "left")
    items = items.select(
        "graph_id", "src", "dst", F.coalesce("anchor", "src").alias("anchor"), "pos", "stop",
        (F.coalesce("above", F.lit(0)) + 1).alias("depth"),
        (F.coalesce("inner", F.lit(False)) & (F.col("src") != F.col("dst"))).alias("inner"),
    )
    items, _ = stage.put(items, "items")

    entries = items.filter(~F.col("inner") & (F.col("src") != F.col("dst")) & (F.col("anchor") != F.col("dst")))
    entries = entries.join(top.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_anti")
    # Of several ways into an anchor within one run tree the first is always better.
    adjacency = entries.groupBy("graph_id", F.col("anchor").alias("node_id"), F.col("dst").alias("to_id"))
    adjacency = adjacency.agg(F.min(F.struct("pos", "depth")).alias("entry")).select(*NODE, "to_id", "entry.*")
    adjacency, _ = stage.put(adjacency, "adjacency")

    def extend(label: Column) -> Column:
        return F.concat(label, F.array(F.struct("pos", "depth", F.col("to_id").alias("id"))))

    def allow(label: Column) -> Column:
        return ~F.exists(label, lambda step: step["id"] == F.col("to_id"))

    root = F.struct(F.col("seq").alias("pos"), F.lit(0).alias("depth"), F.col("node_id").alias("id"))
    start = top.select(*NODE, F.array(root).alias("label"))
    labels = relax(StageTables(links.sparkSession, "paths"), adjacency, start, NODE, extend, allow)
    labels, _ = stage.put(labels, "labels")
    return labels, items


def _roots(stage: StageTables, nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, node_id, seq): the roots in order.  Of the nodes that reach a node the first one is
    its root, where nodes that no edge points to come first, by kind, and then all others, by name."""
    top = roots(nodes.select(*NODE), edges).withColumn("top", F.lit(True))
    named = nodes.join(top, NODE, "left").select(
        *NODE, F.col("top").isNull().alias("late"), F.when(F.col("top"), kind_rank("kind")).alias("rank"), "name"
    )
    named = number_rows(named, ["graph_id"], ["late", "rank", "name", "node_id"]).select(*NODE, "seq")
    named, _ = stage.put(named, "named")
    left = named.select("graph_id", F.col("node_id").alias("src"), F.col("seq").alias("from"))
    right = named.select("graph_id", F.col("node_id").alias("dst"), F.col("seq").alias("to"))
    ways = links.join(left, ["graph_id", "src"]).join(right, ["graph_id", "dst"])
    firsts = min_reaching(
        named.select("graph_id", F.col("seq").alias("node_id")),
        ways.select("graph_id", F.col("from").alias("src"), F.col("to").alias("dst")),
    )
    firsts = firsts.filter("node_id = min_src").select("graph_id", F.col("node_id").alias("seq"))
    return stage.put(named.join(firsts, ["graph_id", "seq"], "left_semi").select(*NODE, "seq"), "top")[0]


def tree_expansion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tree rows (graph_id, place, depth, parent, node_id, name, kind, version, copy, marker).

    Roots are the nodes no edge points to, by kind and name; then nodes no root reaches, by
    name.  Each node is expanded once.  `marker` is `root`, `expand`, `see above` for a node
    already shown, or `cycle` for a node on its own path.  `parent` is null for roots; parallel edges
    give one row each, numbered by `copy`.  `place` is an array of numbers: sorting a graph's rows by it gives
    the printed order; there is one row per edge and root.
    """
    stage = StageTables(nodes.sparkSession, "tree")
    shown = nodes.select(*NODE, "name", "kind", "version")
    links = edges_known(nodes, edges).groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("copies"))
    names = shown.select("graph_id", F.col("node_id").alias("dst"), F.col("name").alias("dst_name"))
    links, _ = stage.put(links.join(names, ["graph_id", "dst"]), "links")
    ways = links.select("graph_id", "src", "dst", "dst_name")

    top = _roots(stage, shown, edges, ways)
    labels, items = _place(stage, ways, top)

    root_rows = top.join(shown, NODE).select(
        "graph_id", F.array("seq").alias("place"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"),
        *["node_id", "name", "kind", "version"], _long(0).alias("copy"), F.lit("root").alias("marker"),
    )
    from_label = labels.select("graph_id", F.col("node_id").alias("anchor"), F.col("label").alias("way"))
    to_label = labels.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("dst_way"))
    rows = items.join(from_label, ["graph_id", "anchor"]).join(to_label, ["graph_id", "dst"], "left")
    entry = F.concat("way", F.array(F.struct("pos", "depth", F.col("dst").alias("id"))))
    on_path = (F.col("src") == F.col("dst")) | F.exists("way", lambda step: step["id"] == F.col("dst"))
    first = F.when(on_path, "cycle").when(F.col("inner") | F.coalesce(entry == F.col("dst_way"), F.lit(False)), "expand")
    rows = rows.select(
        "graph_id", "src", "dst", "pos", "stop",
        F.transform("way", lambda s: s["pos"]).alias("steps"),
        (F.aggregate("way", F.lit(0), lambda sum_, s: sum_ + s["depth"]) + F.col("depth")).alias("depth"),
        first.otherwise("see above").alias("first"),
    )
    target = shown.select("graph_id", F.col("node_id").alias("dst"), "name", "kind", "version")
    rows = rows.join(links.select("graph_id", "src", "dst", "copies"), ["graph_id", "src", "dst"]).join(target, ["graph_id", "dst"])
    rows = repeat_rows(rows, "copies")
    # Further copies stand behind the subtree of the first, those of deeper rows first.
    behind = F.array(F.col("stop"), _long(BEHIND) - F.col("depth"), F.col("copy").cast("long"))
    again = F.col("copy") > 1
    edge_rows = rows.select(
        "graph_id",
        F.concat("steps", F.when(again, behind).otherwise(F.array("pos"))).alias("place"),
        "depth",
        F.col("src").alias("parent"),
        F.col("dst").alias("node_id"),
        *["name", "kind", "version", "copy"],
        F.when(again & (F.col("first") == "expand"), "see above").otherwise(F.col("first")).alias("marker"),
    )
    return root_rows.unionByName(edge_rows)
