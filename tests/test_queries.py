"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from compare import compare, connect
from quorumlens.plans import all_queries

SF = "/root/testdata/sf0.001"
# One or two per module; ALL_QUERIES=1, or `python tests/compare.py DIR`, runs all of them.
SAMPLE = [
    "soft_label_L1", "agreement_rollup_L9", "region_projection_P1", "next_turn_features_W1", "conditionals_T3", "metric_block_M6_M7_M14",
    "bleu_E1_E2", "generic_flags_X10", "best_of_n_K2", "entropy_tertiles_A1", "majority_J1", "over_seeds_B1", "nested_scan_S1_S3", "knn_graph_G8",
]


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no driver tables")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, all_queries()[name])
    assert ok, note


def test_entry_and_keys(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() == 144
