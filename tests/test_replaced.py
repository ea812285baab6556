"""Samples with replacement are returned edge by edge."""

from hopweave.plans import queries


def test_sample_with_replacement_returns_every_edge(spark, sf):
    rows = queries.QUERIES["sample_with_replacement"](spark, sf)
    assert {"batch", "layer", "dst", "src"} == set(rows.columns)
