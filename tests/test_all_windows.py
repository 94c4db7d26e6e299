"""Queries by window cover all windows, and scenarios average over all of them."""

import pytest

from corrolla.plans.registry import _pairs, queries

D = "/root/testdata/sf0.001"
BY_WINDOW = "h1_barcode truncation_audit betti_sweep k_core spectral_gap mst_ntl clustering_weighted communities walk_balance frustration eigenvector_centrality max_cliques removal_impact invariant_bundle core_numbers betti_series".split()


@pytest.fixture(scope="module")
def windows(spark):
    return {x["rn"] for x in _pairs(spark, D).select("rn").distinct().collect()}


@pytest.mark.parametrize("name", BY_WINDOW)
def test_every_window(spark, windows, name):
    assert {x["rn"] for x in queries()[name](spark, D).select("rn").distinct().collect()} == windows


def test_window_scan_counts_every_window(spark, windows):
    assert {x["w"]: x["n_windows"] for x in queries()["window_scan"](spark, D).collect()}[30] == len(windows)


def test_scenarios_average_over_every_window(spark):
    l1 = [x["L1_H1"] for x in queries()["gamma_series"](spark, D).collect() if x["L1_H1"] is not None]
    [own] = [x["l1"] for x in queries()["class_exclusion"](spark, D).collect() if x["scenario"] == "all"]
    assert own == pytest.approx(sum(l1) / len(l1), abs=1e-4)
