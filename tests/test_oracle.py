"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as driver
from glyphmill.plans.registry import QUERIES

# What these return depends on thousands of merges; test_full.py compares them with the library and with
# plain sums, test_sequences.py the batches, test_nearest.py the nearest phrasings.
WITHOUT_TWIN = set(
    "bpe_train cheap_costly_words cheap_word_pairs epoch_batches lexicon_token_cost_filter nearest_phrasings "
    "padding_waste_report scored_token_share token_cost_report vocab_bounds_check vocab_tables".split()
)
NAMES = sorted(set(QUERIES) - WITHOUT_TWIN)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_other_query_has_a_twin():
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) & set(driver.oracle_sql()) == set(NAMES)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    same, n, m, _, _, detail, plan = compare(
        spark, con, sf_dir, name, driver.queries()[name], driver.oracle_sql()[name]
    )
    assert same, f"{name}: {n} rows against {m}; {detail}"
    assert n > 0
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["n", "slot_acc", "sample_acc", "exact_match"]
    assert df.count() == 1
