"""Graph operators on small hand-made graphs and against brute force on random ones."""

import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from graphloom.operators.graph import edges as GE
from graphloom.operators.graph import iterate as GI
from graphloom.operators.graph import metrics as GM
from graphloom.operators.graph.tree import tree_expansion
from graphloom.schemas import NODE_KINDS
from graphloom.storage import StageTables

FIXTURES = {
    "chain": ("ABCD", ["AB", "BC", "CD"]),
    "diamond": ("ABCD", ["AB", "AC", "BD", "CD"]),
    "simple": ("ABCD", ["AB", "BC", "BD"]),
    "cyclic": ("ABCD", ["AB", "BC", "CA", "CD"]),
    "self": ("A", ["AA"]),
    "single": ("A", []),
    "star": (["P0", "P1", "P2", "P3", "P4", "P5"], [(f"P{i}", "P0") for i in range(1, 6)]),
    "kinds": ({"LibA": "Library", "LibB": "Library", "Tests": "Test", "App": "Executable"}, [("App", "LibA"), ("App", "LibB"), ("Tests", "LibA")]),
    "hot": ({"A": "Library", "B": "Library", "C": "Library", "D": "Test", "E": "Executable"}, ["DA", "EB", "AB", "AC", "BC"]),
    "modular": (
        {"App": "Executable", "Services": "Library", "Infrastructure": "Library", "Core": "Library", "Shared": "Library"},
        [("App", "Core"), ("App", "Infrastructure"), ("App", "Services"), ("Services", "Core"), ("Services", "Infrastructure"), ("Infrastructure", "Core")],
    ),
    "onlypackage": ({"P": "Package"}, []),
}


@pytest.fixture(scope="module")
def fixtures(make_graph):
    return make_graph(FIXTURES)


@pytest.fixture(scope="module")
def stats(fixtures):
    return {r.graph_id: r for r in GM.graph_stats(*fixtures).collect()}


def depth(row):
    return row.avg_depth, row.min_depth, row.max_depth, row.has_cycles


def test_depth_statistics(stats):
    assert depth(stats["chain"]) == (1.5, 0, 3, False)
    assert depth(stats["diamond"]) == (1.0, 0, 2, False)
    assert depth(stats["simple"]) == (0.75, 0, 2, False)
    assert depth(stats["modular"]) == (1.2, 0, 3, False)
    assert depth(stats["single"]) == (0.0, 0, 0, False)


def test_cycles_null_the_depths(stats):
    assert depth(stats["cyclic"]) == (None, None, None, True)
    assert depth(stats["self"]) == (None, None, None, True)


def test_package_only_graph_is_empty(stats):
    row = stats["onlypackage"]
    assert (row.total_nodes, *depth(row)) == (0, 0.0, 0, 0, False)
    assert row.hotspots == []


def test_breakdown_lists_all_kinds(stats, fixtures):
    assert stats["kinds"].total_nodes == 4
    assert dict(stats["kinds"].type_breakdown) == {"Library": 2, "Executable": 1, "Test": 1, "Other": 0}
    listed = rows(GM.type_breakdown(fixtures[0]).filter("graph_id = 'onlypackage'"), "kind", "n")
    assert listed == [("Executable", 0), ("Library", 0), ("Other", 0), ("Test", 0)]


def test_hotspots(stats, fixtures):
    def spots(name):
        return [(h["name"], h["in_degree"]) for h in stats[name].hotspots]

    assert spots("hot") == [("B", 2), ("C", 2), ("A", 1)]
    assert spots("star") == [("P0", 5)]
    assert spots("modular") == [("Core", 3), ("Infrastructure", 2), ("Services", 1)]
    top = GM.hotspots(*fixtures, n=2).filter("graph_id = 'hot'")
    assert rows(top, "rank", "name") == [(1, "B"), (2, "C")]
    with pytest.raises(ValueError):
        GM.hotspots(*fixtures, n=0)


def test_cycles_through_packages_count(spark, make_graph):
    nodes, edges = make_graph({"g": ({"A": "Library", "P": "Package"}, [])})
    looped = spark.createDataFrame([("g", "A", "P", "PackageReference", None, None), ("g", "P", "A", "PackageReference", None, None)], edges.schema)
    assert rows(GM.has_cycles(nodes, looped)) == [("g", True)]
    plain = looped.filter("src = 'A'")
    assert rows(GM.has_cycles(nodes, plain)) == [("g", False)]


def test_in_degree_counts_parallel_edges(make_graph):
    nodes, edges = make_graph({"g": ("AB", ["AB", "AB"])})
    assert rows(GM.in_degree(nodes, edges), "node_id", "in_degree") == [("A", 0), ("B", 2)]
    assert rows(GM.out_degree(nodes, edges), "node_id", "out_degree") == [("A", 2), ("B", 0)]
    assert rows(GI.longest_path_depth(nodes, edges), "node_id", "depth") == [("A", 1), ("B", 0)]


def test_edge_filters(make_graph):
    nodes, edges = make_graph({"g": ("AB", ["AB", "AX", "YB", "BB"])})
    assert rows(GE.edges_known(nodes, edges), "src", "dst") == [("A", "B"), ("B", "B")]
    assert rows(GE.self_edges(edges), "src") == [("B",)]
    assert rows(GE.external_nodes(nodes, edges), "node_id") == [("X",)]
    assert rows(GE.with_external_nodes(nodes, edges, "Other"), "node_id", "kind") == [("A", "Library"), ("B", "Library"), ("X", "Other")]
    assert rows(GE.roots(nodes, edges), "node_id") == [("A",)]


def test_unknown_sources_do_not_close_cycles(make_graph):
    nodes, edges = make_graph({"g": ("A", ["AX", "XA"])})
    assert rows(GI.strong_components(nodes, edges), "node_id", "component") == [("A", "A")]
    assert rows(GI.cyclic_nodes(nodes, edges)) == []


def test_bounded_bfs(make_graph):
    nodes, edges = make_graph({"g": ("ABCD", ["AB", "BC", "CD"])})
    seeds = nodes.filter("node_id = 'A'")
    found, kept = GI.bounded_bfs(nodes, edges, seeds, 0)
    assert rows(found, "node_id", "depth") == [("A", 0)] and rows(kept) == []
    found, kept = GI.bounded_bfs(nodes, edges, seeds, 2)
    assert rows(found, "node_id", "depth") == [("A", 0), ("B", 1), ("C", 2)]
    assert rows(kept, "src", "dst") == [("A", "B"), ("B", "C")]
    with pytest.raises(ValueError):
        GI.bounded_bfs(nodes, edges, seeds, -1)


def test_bounded_bfs_skips_system_nodes(make_graph):
    nodes, edges = make_graph({"g": ({"A": "Library", "S": "Other", "B": "Library"}, ["AS", "SB", "AB"])})
    found, kept = GI.bounded_bfs(nodes, edges, nodes.filter("node_id <> 'B'"), 3, is_system=F.col("kind") == "Other")
    assert rows(found, "node_id") == [("A",), ("B",)]
    assert rows(kept, "src", "dst") == [("A", "B")]


def test_deep_chain(make_graph):
    names = [f"n{i:03d}" for i in range(100)]
    nodes, edges = make_graph({"deep": (names, list(zip(names, names[1:])))})
    found = rows(GI.longest_path_depth(nodes, edges), "node_id", "depth")
    assert found == [(n, 99 - i) for i, n in enumerate(names)]


def test_inherited_members(spark, make_graph):
    nodes, edges = make_graph({"g": ("CBA", ["CB", "BA"])})
    edges = edges.withColumn("edge_type", F.lit("Inheritance"))
    members = spark.createDataFrame(
        [("g", "C", 1, "Id", "int"), ("g", "B", 1, "Id", "long"), ("g", "B", 2, "Name", "string"), ("g", "A", 1, "Name", "text")],
        "graph_id string, node_id string, ordinal int, name string, type string",
    )
    found = rows(GI.inherited_members(members, edges).filter("node_id = 'C'"), "name", "type", "declared_in", "level")
    assert found == [("Id", "int", "C", 0), ("Name", "string", "B", 1)]
    skipped = GI.base_closure(edges, nodes.filter("node_id = 'C'"), skip=nodes.filter("node_id = 'B'"))
    assert rows(skipped) == []


# ---- brute force --------------------------------------------------------------------------


def random_graphs(count, seed, cyclic=True):
    random.seed(seed)
    graphs = {}
    for i in range(count):
        names = [f"n{j}" for j in range(random.randint(1, 7))]
        pairs = []
        for _ in range(random.randint(0, 2 * len(names))):
            a, b = random.choice(names), random.choice(names)
            if cyclic or names.index(a) < names.index(b):
                pairs.append((a, b))
        graphs[f"g{i}"] = ({n: random.choice(NODE_KINDS) for n in names}, pairs)
    return graphs


def reach_sets(names, pairs):
    reach = {n: {b for a, b in pairs if a == n} for n in names}
    changed = True
    while changed:
        changed = False
        for n in names:
            wider = reach[n].union(*[reach[m] for m in reach[n]]) if reach[n] else set()
            if wider != reach[n]:
                reach[n], changed = wider, True
    return reach


def depth_first_tree(kinds, pairs):
    """The printed order of a recursive expansion."""
    out, seen = [], set()
    ahead = {}
    for a, b in sorted(pairs):
        ahead.setdefault(a, []).append(b)

    def walk(node, path):
        seen.add(node)
        for target in ahead.get(node, []):
            here = [*path, target]
            if target in path:
                out.append((here, "cycle"))
            elif target in seen:
                out.append((here, "see above"))
            else:
                out.append((here, "expand"))
                walk(target, here)

    targets = {b for _, b in pairs}
    for root in sorted((n for n in kinds if n not in targets), key=lambda n: (NODE_KINDS.index(kinds[n]), n)):
        out.append(([root], "root"))
        walk(root, [root])
    for root in sorted(kinds):
        if root not in seen:
            out.append(([root], "root"))
            walk(root, [root])
    return out


def test_components_and_cycles_match_brute_force(make_graph):
    graphs = random_graphs(150, seed=7)
    nodes, edges = make_graph(graphs)
    components, cyclic, lowest = [], [], []
    for g, (kinds, pairs) in graphs.items():
        reach = reach_sets(kinds, pairs)
        for n in kinds:
            mates = [m for m in kinds if m == n or (m in reach[n] and n in reach[m])]
            components.append((g, n, min(mates)))
            if n in reach[n]:
                cyclic.append((g, n))
            lowest.append((g, n, min(m for m in kinds if m == n or n in reach[m])))
    assert rows(GI.strong_components(nodes, edges)) == sorted(components, key=repr)
    assert rows(GI.cyclic_nodes(nodes, edges)) == sorted(cyclic, key=repr)
    assert rows(GI.min_reaching(nodes, edges)) == sorted(lowest, key=repr)


def test_depths_match_brute_force(make_graph):
    graphs = random_graphs(120, seed=11)
    nodes, edges = make_graph(graphs)
    expected = []
    for g, (kinds, pairs) in graphs.items():
        reach = reach_sets(kinds, pairs)
        stuck = {n for n in kinds if n in reach[n] or any(m in reach[m] for m in reach[n])}

        def deep(n):
            return max([deep(b) + 1 for a, b in pairs if a == n], default=0)

        expected += [(g, n, deep(n)) for n in kinds if n not in stuck]
    found = rows(GI.longest_path_depth(nodes, edges), "graph_id", "node_id", "depth")
    assert found == sorted(expected, key=repr)


def test_tree_matches_depth_first_walk(make_graph):
    graphs = random_graphs(150, seed=3)
    nodes, edges = make_graph(graphs)
    found = {}
    for r in tree_expansion(nodes, edges).collect():
        found.setdefault(r.graph_id, []).append((list(r.place), (r.parent, r.node_id, r.depth, r.marker)))
    for g, (kinds, pairs) in graphs.items():
        expected = [(path[-2] if len(path) > 1 else None, path[-1], len(path) - 1, marker) for path, marker in depth_first_tree(kinds, pairs)]
        assert [row for _, row in sorted(found.get(g, []))] == expected, (g, kinds, pairs)


def test_deep_trees_take_few_rounds(make_graph):
    """A chain, a comb whose teeth are leaves, a ring without a root and a chain with a way back."""
    names = [f"n{(i * 7) % 2000:04d}" for i in range(2000)]
    chain = list(zip(names, names[1:]))
    comb = [(n, f"{t}{n}") for n in names[:500] for t in ("a", "z")]
    graphs = {
        "chain": (names, chain),
        "comb": ([*names[:500], *(b for _, b in comb)], chain[:499] + comb),
        "ring": (names, [*chain, (names[-1], names[0])]),
        "back": (names[:300], chain[:299] + [(names[299], names[100]), (names[250], names[260])]),
    }
    nodes, edges = make_graph(graphs)
    began = time.time()
    found = {}
    for r in tree_expansion(nodes, edges).collect():
        found.setdefault(r.graph_id, []).append((list(r.place), (r.depth, r.node_id, r.marker)))
    assert time.time() - began < 120
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000)
    try:
        for g, (kinds, pairs) in graphs.items():
            expected = [(len(path) - 1, path[-1], marker) for path, marker in depth_first_tree(dict.fromkeys(kinds, "Library"), pairs)]
            assert [row for _, row in sorted(found[g])] == expected, g
    finally:
        sys.setrecursionlimit(limit)


def test_levels_grow_along_edges(make_graph):
    graphs = random_graphs(60, seed=5, cyclic=False)
    nodes, edges = make_graph(graphs)
    level = {(r.graph_id, r.node_id): r.level for r in GI.topological_level(nodes, edges).collect()}
    assert len(level) == sum(len(k) for k, _ in graphs.values())
    for g, (_, pairs) in graphs.items():
        assert all(level[g, a] < level[g, b] for a, b in pairs)


def test_folded_labels_give_the_same(make_graph):
    """Long sawtooth paths make the label log grow past its base several times."""
    names = [f"n{(i * 7) % 23:02d}" for i in range(23)]
    pairs = list(zip(names, names[1:])) + [(names[i], names[i + 3]) for i in range(0, 20, 2)]
    nodes, edges = make_graph({"g": (names, pairs)})
    reach = reach_sets(names, pairs)
    expected = sorted((n, min([n, *(a for a in names if n in reach[a])])) for n in names)
    assert rows(GI.min_reaching(nodes, edges), "node_id", "min_src") == expected


def test_deep_graphs_take_few_rounds(make_graph):
    """A chain and a ring of 2,000 nodes, and a ladder of runs between forks."""
    names = [f"n{i:04d}" for i in range(2000)]
    ring = [*names[1000:], *names[:1000]]
    forks = [f"f{i:02d}" for i in range(100)]
    ladder = [(forks[i], forks[i + 1]) for i in range(99)] + [(forks[0], "x"), ("x", "y"), ("y", "x"), ("f03", "r1"), ("r1", "r2"), ("r2", "f02")]
    nodes, edges = make_graph(
        {
            "chain": (names, list(zip(names, names[1:]))),
            "ring": (names, list(zip(ring, [*ring[1:], ring[0]]))),
            "ladder": ([*forks, "x", "y", "r1", "r2"], ladder),
        }
    )
    found = {(r.graph_id, r.node_id): r.component for r in GI.strong_components(nodes, edges).collect()}
    assert all(found["chain", n] == n for n in names) and all(found["ring", n] == "n0000" for n in names)
    assert {found["ladder", n] for n in ("f02", "f03", "r1", "r2")} == {"f02"} and found["ladder", "y"] == "x"
    depths = {(r.graph_id, r.node_id): r.depth for r in GI.longest_path_depth(nodes, edges).collect()}
    assert all(depths["chain", n] == 1999 - i for i, n in enumerate(names))
    assert not any(g == "ring" for g, _ in depths)
    assert depths["ladder", "f99"] == 0 and depths["ladder", "f04"] == 95 and ("ladder", "f00") not in depths
    lowest = {(r.graph_id, r.node_id): r.min_src for r in GI.min_reaching(nodes, edges).collect()}
    assert all(lowest[g, n] == "n0000" for g in ("chain", "ring") for n in names)


def test_long_base_chains(spark, make_graph):
    names = [f"t{i:02d}" for i in range(16)]
    nodes, edges = make_graph({"g": (names, list(zip(names, names[1:])))})
    edges = edges.withColumn("edge_type", F.lit("Inheritance"))
    found = rows(GI.base_closure(edges, nodes.filter("node_id = 't00'")), "base", "level")
    assert found == [(n, i) for i, n in enumerate(names) if i]
    members = spark.createDataFrame([("g", "t15", 1, "Id"), ("g", "t15", 2, "Name"), ("g", "t07", 9, "Id")], "graph_id string, node_id string, ordinal int, name string")
    got = rows(GI.inherited_members(members, edges).filter("node_id = 't00'"), "name", "declared_in", "level")
    assert got == [("Id", "t07", 7), ("Name", "t15", 15)]


def test_a_ring_elsewhere_does_not_keep_settled_rows_moving(spark):
    """Nodes that point at a hub settle at once, whatever circles there are in other graphs."""
    stage = StageTables(spark, "star")
    star = [("star", f"n{i:05d}", "hub") for i in range(20_000)]
    ring = [("ring", "a", "b"), ("ring", "b", "a"), ("ring", "c", "b")]
    pointers = spark.createDataFrame(star + ring, "graph_id string, node_id string, to_id string")
    settled, endless = GI.follow(stage, pointers, "ways", circles=True)
    assert stage.log("ways").select("round").distinct().count() <= 4
    assert settled.count() == 20_000 and rows(settled, "to_id", "steps")[0] == ("hub", 1)
    assert rows(endless, "node_id", "low") == [("a", "a"), ("b", "a"), ("c", "a")]
    # The moving rows alone are written again.
    assert stage.log("ways").filter("round > 0").count() <= 9
