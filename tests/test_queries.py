"""Registered queries against their SQL on the smallest tables.

All of them run with QUERIES=all; by default a cross-section does.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.check import compare

FOLDER = "/root/testdata/sf0.001"
SOME = "enrich roc_by_group p_adjust_bh prepare_msstats contrasts_by_regex label_multi_ptm translate_packed site_representatives bfdr longest_runs match_peaks one_factor_means range_join nearest_join".split()
NAMES = sorted(entry.registry()) if os.environ.get("QUERIES") == "all" else SOME


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    message, _, ok = compare(spark, entry.registry()[name], FOLDER)
    assert ok, message


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.registry()) <= set(entry.queries())


@pytest.mark.parametrize("name, module, operator", [("specificity_permutation", "A", "specificity_permutation"), ("gsea", "E", "gsea"), ("simplify_gsea", "E", "gsea"), ("localization_scores", "E", "localization_scores"), ("kinase_sea", "K", "kinase_sea")])
def test_permutations_as_many_as_the_operator_has(spark, monkeypatch, name, module, operator):
    from spectraloom.plans import q_apms, q_enrich

    class Called(Exception):
        pass

    def seen(*_, **given):
        raise Called(given)

    entry.registry()
    monkeypatch.setattr(getattr(q_apms if module == "A" else q_enrich, module), operator, seen)
    with pytest.raises(Called) as call:
        entry.queries()[name](spark, FOLDER)
    assert "n_perm" not in call.value.args[0]
