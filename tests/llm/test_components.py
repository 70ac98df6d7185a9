"""Connected components, and the jobs they take."""

from __future__ import annotations

import random

import pytest

from glyphmill.llm import components as cc


def smallest_reachable(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            for n in (a, b):
                changed |= label[n] != low
                label[n] = low
    return label


def links_of(spark, edges):
    return spark.createDataFrame(edges, "a bigint, b bigint")


@pytest.mark.parametrize("kind", ["star", "chain", "random", "none"])
def test_labels_are_the_smallest_reachable_nodes(spark, kind):
    rng = random.Random(3)
    edges = {
        "star": [(9, k) for k in range(10, 20)] + [(1, 9)],
        "chain": [(k, k + 1) for k in range(30)],
        "random": [(rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)],
        "none": [],
    }[kind]
    got = {r["node"]: r["label"] for r in cc.components(links_of(spark, edges)).collect()}
    assert got == smallest_reachable(edges)


def test_groups_joined_by_links_get_the_label_of_all_links_together(spark):
    first, then = [(1, 5), (5, 7), (2, 3), (8, 9)], [(7, 3), (1, 5), (10, 9)]
    groups = smallest_reachable(first)
    grouped = spark.createDataFrame([(k, groups.get(k, k)) for k in range(1, 12)], "key bigint, group bigint")
    labels = {r["group"]: r["label"] for r in cc.contracted(links_of(spark, then), grouped).collect()}
    want = smallest_reachable(first + then)
    assert {k: labels.get(groups.get(k, k), groups.get(k, k)) for k in want} == want


def test_a_star_settles_without_a_round_to_find_that_out(spark):
    spark.sparkContext.setJobGroup("components", "")
    cc.components(links_of(spark, [(0, k) for k in range(1, 50)]))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) < 10
