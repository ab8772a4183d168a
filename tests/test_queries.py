"""The entry points, and some queries against their SQL on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import canonical, connect  # noqa: E402

from graphloom.queries import QUERIES, SQL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

# The whole list is checked by tools/check_oracle.py; these cover each family.
CHECKED = [
    "package_nodes",
    "graph_in_degree",
    "graph_stats_moves",
    "graph_scc",
    "graph_scc_steps",
    "type_diagram_lines",
    "tree_rows",
    "bounded_bfs_edges",
    "pk_fallback",
    "fk_by_convention",
    "dedupe_relationships",
    "decompose_m2m_properties",
    "owned_table_resolution",
    "split_nested",
    "nested_parts",
    "model_parity",
    "nest_children",
    "profile_columns",
    "url_resolve",
    "nearest_declaration",
    "docs_containing_terms",
    "reclassify_edges",
    "text_solution_members",
    "rejected_text_solutions",
    "without_migrations",
    "large_solutions",
    "written_lines",
    "listed_models",
    "minimal_keys",
    "inclusion_dependencies",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.graph_id == "fk" and row.total_nodes > 0 and not row.has_cycles


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert ours == canonical(columns, result.fetchall())


@pytest.mark.parametrize("name", ["edges_known", "build_fk_graph"])
def test_repeats_of_references_go_before_node_ids_are_made(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(src#" not in plan
    test_query_matches_sql(spark, duck, name)


def test_both_derivations_of_a_model_start_from_facts_that_are_made_once(spark, monkeypatch):
    from graphloom.queries import models

    made, make = [], models.navigations
    monkeypatch.setattr(models, "navigations", lambda *given: made.append(1) or make(*given))
    assert entry.queries()["model_parity"](spark, SF_DIR).count() > 0 and len(made) == 1
