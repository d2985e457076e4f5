"""Registered queries against their check SQL. ALL_QUERIES=1 runs every one; the default is one or two per group."""

import os

import pytest

from hiremill.plans import catalog
from tests.check import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SOME = ["a2_source_size_guard", "a4_upsert_by_key", "b1_normalize_postings", "b5_clean_detail", "c1_snapshot_delta", "c2_validate_pair", "c13_cached_or_related", "d4_validation_report", "d6_release_gate", "e2_role_brief",
        "e9_market_profile", "f1_match_signals", "f8_resolve_role", "f9_scope_decision", "g2_seed_clusters", "h1_assign_themes", "h5_weighted_jaccard", "h9_cluster_summary", "h10_related_postings", "i1_stratified_round_robin",
        "i7_bucket_quota_pick", "j2_gold_metrics", "j8_quality_metrics", "k2_handoff_queue", "k6_apply_decisions"]
NAMES = list(catalog.ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    _, err = compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name])
    assert err is None, err


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
