"""Iterative graph operators as frontier loops over stage tables.

Every key includes graph_id, so all graphs of a corpus advance in the same rounds.  A round
is one job: join the frontier to the adjacency, aggregate, write.  Only row counts reach the
driver.  The frontier is read back from files of known size, so Spark broadcasts it while it
is small (a hub's edges then never move) and shuffles with skew splitting when it is large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...storage import StageTables
from .edges import drop_self_edges, self_edges

NODE = ["graph_id", "node_id"]

def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "src", "dst").distinct()


def reachable_from(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from the seeds with their distance (graph_id, node_id, depth).

    Nodes without outgoing edges, declared or not, stay in the result.  With `max_depth`
    nodes at that distance are kept but not expanded.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must not be negative")
    stage = StageTables(edges.sparkSession, "reach")
    adjacency, _ = stage.put(_pairs(edges), "adjacency")
    frontier, seen = stage.append(seeds.select(*NODE).distinct(), "visited", 0, n=F.count(F.lit(1)))
    depth = 0
    while seen["n"] and (max_depth is None or depth < max_depth):
        depth += 1
        ahead = frontier.withColumnRenamed("node_id", "src").join(adjacency, ["graph_id", "src"])
        ahead = ahead.select("graph_id", F.col("dst").alias("node_id")).distinct()
        fresh = ahead.join(stage.log("visited").select(*NODE), NODE, "left_anti")
        frontier, seen = stage.append(fresh, "visited", depth, n=F.count(F.lit(1)))
    return stage.log("visited").withColumnRenamed("round", "depth")


def bounded_bfs(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int,
    kinds: list[str] | None = None,
    is_system: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes within `max_depth` of the seeds and the edges leaving nodes nearer than that.

    Only edges of the given kinds count.  System nodes and edges to them are left out.
    Undeclared targets are kept as nodes and never expanded.
    """
    if kinds is not None:
        edges = edges.filter(F.col("edge_type").isin(kinds))
    edges = drop_self_edges(edges)
    if is_system is not None:
        system = nodes.filter(is_system).select("graph_id", F.col("node_id").alias("dst"))
        edges = edges.join(system, ["graph_id", "dst"], "left_anti")
        seeds = seeds.join(system.withColumnRenamed("dst", "node_id"), NODE, "left_anti")
    found = reachable_from(edges, seeds, max_depth)
    expanded = found.filter(F.col("depth") < max_depth).select("graph_id", F.col("node_id").alias("src"))
    return found, edges.join(expanded, ["graph_id", "src"], "left_semi")


def follow(stage: StageTables, pointers: DataFrame, name: str, circles: bool = False) -> tuple[DataFrame, DataFrame]:
    """Follows pointers to their ends by doubling: (settled, endless).

    pointers: graph_id, node_id, to_id, one per node, and optionally weight (1 without).  settled:
    graph_id, node_id, to_id (the first node on the way that has no pointer), last (the node before
    it), steps (sum of the weights), low (smallest node id on the way, to_id not counted).
    endless: nodes whose way runs in a circle; with `circles`, low is the smallest id of the circle and
    what leads into it from the node.

    A row settles as soon as its way reaches a settled row or an end, and then leaves the loop; only
    the others travel on.  Ways that still move have the same length in a round, so if any of them
    had an end, one would settle in the next round: a round in which none settles shows that all
    that are left run in circles.  Their lows are complete once a round changes none.
    """
    weight = F.col("weight") if "weight" in pointers.columns else F.lit(1).cast("long")
    way = pointers.select(
        *NODE, "to_id", F.col("node_id").alias("last"), weight.alias("steps"), F.col("node_id").alias("low")
    )
    known = pointers.select("graph_id", F.col("node_id").alias("to_id"), F.lit(True).alias("moving"))
    start = way.join(known, ["graph_id", "to_id"], "left").withColumn("moving", F.coalesce("moving", F.lit(False)))
    start = start.select(*way.columns, "moving")
    current, seen = stage.append(start, name, 0, n=F.count_if("moving"))
    rows, round_no = stage.log(name), 0
    while seen["n"]:
        round_no += 1
        moving = current.filter("moving")
        # What a way may reach: rows that have settled, and those that moved as far as it has.
        ahead = rows.filter(~F.col("moving") | (F.col("round") == round_no - 1))
        ahead = ahead.select("graph_id", F.col("node_id").alias("to_id"), *[F.col(c).alias(f"_{c}") for c in ("to_id", "last", "steps", "low", "moving")])
        joined = moving.join(ahead, ["graph_id", "to_id"]).select(
            *NODE,
            F.col("_to_id").alias("to_id"),
            F.col("_last").alias("last"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            F.least("low", "_low").alias("low"),
            F.col("_moving").alias("moving"),
            (F.col("_moving") & (F.col("_low") < F.col("low"))).alias("lower"),
        )
        before = seen["n"]
        current, seen = stage.append(joined, name, round_no, n=F.count_if("moving"), lower=F.count_if("lower"))
        rows = stage.log(name)
        if seen["n"] == before and not (circles and seen["lower"]):
            break
    settled = rows.filter(~F.col("moving")).select(*way.columns)
    return settled, current.filter("moving").select(*way.columns)


def _peel(nodes: DataFrame, edges: DataFrame, waits_for: str, waiting: str, level: str) -> DataFrame:
    """Level of every node that can be peeled: one more than the highest level among the
    nodes it waits for.  Nodes that wait for a cycle get no row.

    Nodes that wait for a single other node are followed to the end of their run at once, so a run
    of any length costs the logarithm of it in rounds.  Between the other nodes each edge is joined
    once, in the round its end settles, and brings the level that its run adds.
    """
    stage = StageTables(nodes.sparkSession, "peel")
    links = edges.select("graph_id", F.col(waiting).alias("node_id"), F.col(waits_for).alias("on")).distinct()
    links, _ = stage.put(links, "links")
    zero = F.lit(0).cast("long")
    needs = links.groupBy(*NODE).agg(F.count(F.lit(1)).alias("need"), F.min("on").alias("to_id"))
    needs, _ = stage.put(needs, "needs")
    settled_runs, endless = follow(stage, needs.filter("need = 1").select(*NODE, "to_id"), "run")
    runs = settled_runs.select(*NODE, F.col("to_id").alias("end"), "steps")
    # Edges of the other nodes lead to the ends of runs; those into a circle stay open for ever.
    run_of = runs.withColumnRenamed("node_id", "on")
    forks = links.join(needs.filter("need > 1").select(*NODE), NODE, "left_semi").join(run_of, ["graph_id", "on"], "left")
    forks = forks.join(
        endless.select("graph_id", F.col("node_id").alias("on"), F.lit(True).alias("lost")), ["graph_id", "on"], "left"
    ).filter("lost is null")
    forks, _ = stage.put(
        forks.select(*NODE, F.coalesce("end", "on").alias("on"), (F.coalesce("steps", zero) + 1).alias("steps")), "forks"
    )
    wanted = needs.filter("need > 1").select(*NODE, "need")
    start = nodes.select(*NODE).join(needs.select(*NODE), NODE, "left_anti").withColumn("level", zero)
    settled, seen = stage.append(start, "levels", 0, n=F.count(F.lit(1)))
    pending = None
    round_no = 0
    while seen["n"]:
        round_no += 1
        hits = settled.withColumnRenamed("node_id", "on").join(forks, ["graph_id", "on"])
        hits = hits.groupBy(*NODE).agg(F.count(F.lit(1)).alias("got"), F.max(F.col("level") + F.col("steps")).alias("level"))
        if pending is not None:
            hits = hits.unionByName(pending).groupBy(*NODE).agg(F.sum("got").alias("got"), F.max("level").alias("level"))
        touched, seen = stage.put(
            hits.join(wanted, NODE), f"touched={round_no}", n=F.count_if(F.col("got") == F.col("need")), all=F.count(F.lit(1))
        )
        if not seen["n"]:
            break
        settled, _ = stage.append(touched.filter("got = need").select(*NODE, "level"), "levels", round_no)
        pending = touched.filter("got < need").select(*NODE, "got", "level") if seen["all"] > seen["n"] else None
    ends = stage.log("levels").drop("round")
    ends, _ = stage.put(ends, "ends")
    along = runs.join(ends.withColumnRenamed("node_id", "end"), ["graph_id", "end"])
    along = along.select(*NODE, (F.col("level") + F.col("steps")).alias("level"))
    return ends.unionByName(along).select(*NODE, F.col("level").cast("int").alias(level))


def longest_path_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """depth(leaf) = 0, depth(n) = 1 + the highest depth among its targets.  Nodes from which
    a cycle can be reached are missing.  Both ends of every edge are in the node table."""
    return _peel(nodes, edges, waits_for="dst", waiting="src", level="depth")


def topological_level(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level 0 has no incoming edge; every edge goes to a higher level.  Nodes behind a cycle
    are missing."""
    return _peel(nodes, edges, waits_for="src", waiting="dst", level="level")


def relax(
    stage: StageTables,
    adjacency: DataFrame,
    start: DataFrame,
    key: list[str],
    extend: Callable[[Column], Column],
    allow: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Smallest label per key: labels travel along the adjacency until none gets smaller.

    `adjacency` holds the key columns of the source and, as `to_id`, the node that replaces
    node_id at the target.  `extend` makes the label a neighbour is offered, `allow` may
    refuse an offer.  Only labels improved in the last round travel on.
    """
    others = [c for c in key if c != "node_id"]
    epoch, round_no, recent_rows = 0, 0, 0
    changed, seen = stage.append(start.select(*key, "label"), "labels-0", 0, n=F.count(F.lit(1)))
    base_rows = seen["n"]

    def current() -> DataFrame:
        return stage.log(f"labels-{epoch}").groupBy(*key).agg(F.min("label").alias("label"))

    while seen["n"]:
        round_no += 1
        offers = changed.join(adjacency, key)
        if allow is not None:
            offers = offers.filter(allow(F.col("label")))
        offers = offers.select(*others, F.col("to_id").alias("node_id"), extend(F.col("label")).alias("offer"))
        offers = offers.groupBy(*key).agg(F.min("offer").alias("offer"))
        better = offers.join(current(), key, "left")
        better = better.filter(F.col("label").isNull() | (F.col("offer") < F.col("label")))
        better = better.select(*key, F.col("offer").alias("label"))
        changed, seen = stage.append(better, f"labels-{epoch}", round_no, n=F.count(F.lit(1)))
        recent_rows += seen["n"]
        if seen["n"] and recent_rows >= base_rows:
            # The log has doubled: fold it, so that a round reads about two rows per label.
            merged = current()
            epoch += 1
            _, kept = stage.append(merged, f"labels-{epoch}", 0, n=F.count(F.lit(1)))
            base_rows, recent_rows = kept["n"], 0
    return current()


def min_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest node id from which each node can be reached, itself included.

    Nodes with a single incoming edge are followed back to the start of their run at once; labels
    travel only between the other nodes."""
    stage = StageTables(nodes.sparkSession, "minreach")
    known = nodes.select("graph_id", F.col("node_id").alias("src"))
    links, _ = stage.put(drop_self_edges(_pairs(edges)).join(known, ["graph_id", "src"], "left_semi"), "links")
    needs = links.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to_id"))
    needs = needs.join(nodes.select(*NODE), NODE, "left_semi")
    needs, _ = stage.put(needs, "needs")
    runs, endless = follow(stage, needs.filter("n = 1").select(*NODE, "to_id"), "run", circles=True)
    forks = needs.filter("n > 1").select("graph_id", F.col("node_id").alias("dst"))
    into = links.join(forks, ["graph_id", "dst"], "left_semi")
    way = runs.select("graph_id", F.col("node_id").alias("src"), "to_id", "low").unionByName(
        endless.select("graph_id", F.col("node_id").alias("src"), F.when(F.lit(False), F.col("node_id")).alias("to_id"), "low")
    )
    into, _ = stage.put(into.join(way, ["graph_id", "src"], "left"), "into")
    anchors = nodes.select(*NODE).join(needs.filter("n = 1").select(*NODE), NODE, "left_anti")
    lows = into.filter("low is not null").select("graph_id", F.col("dst").alias("node_id"), F.col("low").alias("label"))
    start = anchors.withColumn("label", F.col("node_id")).unionByName(lows).groupBy(*NODE).agg(F.min("label").alias("label"))
    # An edge starts where the run that it ends starts; a circle was counted above.
    origin = F.when(F.col("low").isNull(), F.col("src")).otherwise(F.col("to_id"))
    adjacency = into.select("graph_id", origin.alias("node_id"), F.col("dst").alias("to_id")).filter("node_id is not null")
    adjacency, _ = stage.put(adjacency.distinct(), "adjacency")
    labels, _ = stage.put(relax(stage, adjacency, start, NODE, lambda label: label), "labels")
    along = runs.join(labels.select("graph_id", F.col("node_id").alias("to_id"), "label"), ["graph_id", "to_id"], "left")
    along = along.select(*NODE, F.least("low", F.coalesce("label", "low")).alias("label"))
    circles = endless.select(*NODE, F.col("low").alias("label"))
    return labels.unionByName(along).unionByName(circles).withColumnRenamed("label", "min_src")


def _contract(stage: StageTables, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with runs of nodes that have one link in and one out replaced by a link each:
    (links, runs, circles).  runs: graph_id, node_id, start, end (the nodes around the run);
    circles: graph_id, node_id, low, for rings of such nodes."""
    ins = links.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("ins"))
    outs = links.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("to_id"))
    single = ins.join(outs, NODE).filter("ins = 1 and outs = 1").select(*NODE, "to_id")
    way, circles = follow(stage, single, "run", circles=True)
    # The last node of a run names it.
    head = way.select("graph_id", F.col("node_id").alias("dst"), "last", F.col("to_id").alias("end"))
    inner = way.select("graph_id", F.col("node_id").alias("src")).unionByName(circles.select("graph_id", F.col("node_id").alias("src")))
    outer, _ = stage.put(links.join(inner, ["graph_id", "src"], "left_anti"), "outer")
    entries = outer.join(head, ["graph_id", "dst"]).select("graph_id", "last", F.col("src").alias("start"), "end")
    runs, _ = stage.put(way.select(*NODE, "last").join(entries, ["graph_id", "last"]).drop("last"), "runs")
    direct = outer.join(head.select("graph_id", "dst"), ["graph_id", "dst"], "left_anti")
    short = entries.select("graph_id", F.col("start").alias("src"), F.col("end").alias("dst")).filter("src <> dst")
    return direct.select("graph_id", "src", "dst").unionByName(short).distinct(), runs, circles.select(*NODE, "low")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components (graph_id, node_id, component); a component is named by
    its smallest node id.

    Each phase sends the smallest id along the edges and against them at once.  A node that
    meets the same id both ways is in that id's component.  Edges whose ends met different
    ids cannot lie inside a component and are dropped, as are finished nodes, and the rest
    goes into the next phase.  Each phase first replaces runs of nodes with one link in and one
    out by single links; their nodes belong to the component that holds both ends, if one does.
    """
    spark = nodes.sparkSession
    known = nodes.select("graph_id", F.col("node_id").alias("src"))
    found = StageTables(spark, "components")
    links = drop_self_edges(_pairs(edges)).join(known, ["graph_id", "src"], "left_semi")
    phase, folded, rings = 0, [], []
    while True:
        # Only a node with edges both in and out can be on a cycle.
        stage = StageTables(spark, "scc")
        has_in = links.select("graph_id", F.col("dst").alias("src")).distinct()
        has_out = links.select("graph_id", F.col("src").alias("dst")).distinct()
        links = links.join(has_in, ["graph_id", "src"], "left_semi").join(has_out, ["graph_id", "dst"], "left_semi")
        links, seen = stage.put(links, "links", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        links, runs, circles = _contract(stage, links)
        folded.append(runs)
        rings.append(circles)
        links, _ = stage.put(links, "contracted")
        ahead = links.select("graph_id", F.lit(True).alias("ahead"), F.col("src").alias("node_id"), F.col("dst").alias("to_id"))
        back = links.select("graph_id", F.lit(False).alias("ahead"), F.col("dst").alias("node_id"), F.col("src").alias("to_id"))
        start = ahead.unionByName(back).select("graph_id", "ahead", "node_id").distinct()
        start = start.withColumn("label", F.col("node_id"))
        labels = relax(stage, ahead.unionByName(back), start, ["graph_id", "ahead", "node_id"], lambda label: label)
        met = labels.groupBy(*NODE).agg(
            F.min(F.when(F.col("ahead"), F.col("label"))).alias("low_in"),
            F.min(F.when(~F.col("ahead"), F.col("label"))).alias("low_out"),
        )
        met, _ = found.append(met, "met", phase)
        open_nodes = met.filter(F.col("low_in") != F.col("low_out"))
        left = open_nodes.select("graph_id", F.col("node_id").alias("src"), "low_in", "low_out")
        right = open_nodes.select("graph_id", F.col("node_id").alias("dst"), "low_in", "low_out")
        links = links.join(left, ["graph_id", "src"]).join(right, ["graph_id", "dst", "low_in", "low_out"])
        links = links.select("graph_id", "src", "dst")
        phase += 1
    result = nodes.select(*NODE)
    if not phase:
        return result.withColumn("component", F.col("node_id"))
    members = found.log("met").filter(F.col("low_in") == F.col("low_out")).select(*NODE, F.col("low_in").alias("component"))
    for circles in rings:
        members = members.unionByName(circles.withColumnRenamed("low", "component"))
    # A later phase may have folded the ends of an earlier run, so the last phase is resolved first.
    for number, runs in reversed(list(enumerate(folded))):
        members, _ = found.put(members, f"members-{number}")
        around = runs
        for side in ("start", "end"):
            named = members.select("graph_id", F.col("node_id").alias(side), F.col("component").alias(f"_{side}"))
            around = around.join(named, ["graph_id", side], "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
        inside = around.filter("_start = _end").select(*NODE, F.col("_start").alias("component"))
        members = members.unionByName(inside)
        # A node whose run comes back to it names the component itself.
        names = inside.select("graph_id", F.col("component").alias("node_id"), "component").distinct()
        members = members.unionByName(names.join(members.select(*NODE), NODE, "left_anti"))
    members, _ = found.put(members.distinct(), "members")
    smallest = members.groupBy("graph_id", "component").agg(F.min("node_id").alias("_name"))
    members = members.join(smallest, ["graph_id", "component"]).select(*NODE, F.col("_name").alias("component"))
    return result.join(members, NODE, "left").withColumn("component", F.coalesce("component", "node_id"))


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes in a component of several nodes, and nodes with an edge to themselves."""
    components = strong_components(nodes, edges)
    sizes = components.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("size"))
    in_cycle = components.join(sizes.filter("size > 1"), ["graph_id", "component"], "left_semi").select(*NODE)
    looped = self_edges(edges).select("graph_id", F.col("src").alias("node_id"))
    looped = looped.join(nodes.select(*NODE), NODE, "left_semi")
    return in_cycle.unionByName(looped).distinct()


def base_closure(edges: DataFrame, seeds: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Base types of each seed (graph_id, seed, base, level), nearest level first, to the end of
    the chain.  Bases listed in `skip` (interfaces, the root context type) are neither reported nor
    walked through."""
    stage = StageTables(edges.sparkSession, "bases")
    bases = edges.filter(F.col("edge_type") == "Inheritance").select("graph_id", "src", F.col("dst").alias("base"))
    bases = bases.distinct()
    if skip is not None:
        bases = bases.join(skip.select("graph_id", F.col("node_id").alias("base")), ["graph_id", "base"], "left_anti")
    bases, _ = stage.put(bases, "bases")
    seeded = seeds.select("graph_id", F.col("node_id").alias("seed"), F.col("node_id").alias("base")).distinct()
    frontier, seen = stage.append(seeded, "closure", 0, n=F.count(F.lit(1)))
    level = 0
    while seen["n"]:
        level += 1
        up = frontier.withColumnRenamed("base", "src").join(bases, ["graph_id", "src"])
        up = up.select("graph_id", "seed", "base").distinct()
        fresh = up.join(stage.log("closure").drop("round"), ["graph_id", "seed", "base"], "left_anti")
        frontier, seen = stage.append(fresh, "closure", level, n=F.count(F.lit(1)))
    closure = stage.log("closure").withColumnRenamed("round", "level")
    return closure.filter(F.col("level") > 0)


def inherited_members(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Own members and those of the base chain; the most derived declaration of a name wins.

    `members` has graph_id, node_id, ordinal, name and further columns; the result adds
    declared_in and level.  Declarations travel from base to derived types, a level per round, and
    only where their name is new, so no pairs of types are kept.
    """
    from ..numbering import first_wins

    stage = StageTables(edges.sparkSession, "inherited")
    derived = edges.filter(F.col("edge_type") == "Inheritance").select("graph_id", F.col("src").alias("to_id"), F.col("dst").alias("node_id"))
    derived, _ = stage.put(derived.filter("to_id <> node_id").distinct(), "derived")
    member, order = [*NODE, "name"], ["ordinal", "declared_in"]
    own = first_wins(members.withColumn("declared_in", F.col("node_id")), member, order)
    fresh, seen = stage.append(own, "members", 0, n=F.count(F.lit(1)))
    level = 0
    while seen["n"]:
        level += 1
        offers = fresh.join(derived, NODE).drop("node_id").withColumnRenamed("to_id", "node_id").select(*own.columns)
        offers = first_wins(offers, member, order)
        offers = offers.join(stage.log("members").select(*member), member, "left_anti")
        fresh, seen = stage.append(offers, "members", level, n=F.count(F.lit(1)))
    return stage.log("members").withColumnRenamed("round", "level")
