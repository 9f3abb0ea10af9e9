"""A spread of registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from parity import check, duck

SMALL = "/root/testdata/sf0.001"
NAMES = (
    "tumour_vs_reference_contrast", "batch_effect_sensitivity", "mann_whitney_native", "mutation_functional_evidence", "graph_node_metrics",
    "candidate_gene_priority", "study_global_partition", "capped_file_selection", "quality_silver_rules", "leaked_identifiers",
)
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@needs_tables
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    verdict, _, _ = check(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SMALL, duck(SMALL))
    assert verdict.startswith("ok"), verdict


@needs_tables
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "log2_fold_change" in df.columns


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
