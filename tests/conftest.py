import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphloom.session import local_session  # noqa: E402

NODE_SCHEMA = "graph_id string, node_id string, name string, kind string, path string, version string"
EDGE_SCHEMA = "graph_id string, src string, dst string, edge_type string, label string, cardinality string"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def make_graph(spark):
    """Builds (nodes, edges) of many graphs from {graph_id: (kinds by node, edge pairs)}."""

    def build(graphs):
        nodes, edges = [], []
        for graph_id, (kinds, pairs) in graphs.items():
            kinds = kinds if isinstance(kinds, dict) else {n: "Library" for n in kinds}
            nodes += [(graph_id, n, n, k, n, None) for n, k in kinds.items()]
            edges += [(graph_id, a, b, "ProjectReference", None, None) for a, b in pairs]
        return (
            spark.createDataFrame(nodes, NODE_SCHEMA).coalesce(2).cache(),
            spark.createDataFrame(edges, EDGE_SCHEMA).coalesce(2).cache(),
        )

    return build


def rows(df, *columns):
    """Sorted tuples of a result."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
