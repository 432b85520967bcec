"""Work of queries that must not grow faster than their tables."""

from casewright.operators import correlate
from casewright.plans import catalog

SF = "/root/testdata/sf0.001"


def test_best_pair_of_a_case_needs_no_other_pairs(spark, monkeypatch):
    made = sorted(catalog.QUERIES["hypothesis_sub_correlation"](spark, SF).collect())
    monkeypatch.setattr(correlate, "correlate_all", None)
    assert sorted(catalog.QUERIES["hypothesis_sub_correlation"](spark, SF).collect()) == made
