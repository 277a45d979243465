"""Plans that must hold at scale: pushed predicates, pruned columns, group limits, top-k, no nested loops."""

import re

import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_pushed(spark):
    p = plan(spark, "scan_pushed")
    assert "LessThan(l_shipdate" in p and "GreaterThan(l_discount" in p
    assert "l_tax" not in p and "l_extendedprice" not in p


@pytest.mark.parametrize("name", ["latest_per_key", "top_m_per_group", "claim_next_job"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert p.index("WindowGroupLimit") < p.rindex("WindowGroupLimit") and "Partial" in p


@pytest.mark.parametrize("name", ["anchor_topk", "page_offset", "slow_requests", "keyword_rank"])
def test_top_k_is_not_a_global_sort(spark, name):
    p = plan(spark, name)
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


@pytest.mark.parametrize("name", ["interval_join_half_open", "interval_join_closed", "date_in_range_join", "or_join_as_union", "as_of_join", "geo_ip_join", "resolve_dated", "fuzzy_unique_match", "duplicate_pairs_overlap", "retag_by_date", "scd2_rotate"])
def test_no_nested_loops(spark, name):
    assert not re.search("NestedLoop|Cartesian", plan(spark, name))


@pytest.mark.parametrize("name", ["facets_topk", "level_counts_union", "coverage_matrix"])
def test_facets_scan_once_each(spark, name):
    tables = re.findall(r"Scan parquet|FileScan parquet", plan(spark, name))
    assert len(tables) <= {"facets_topk": 2, "level_counts_union": 1, "coverage_matrix": 4}[name]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"sequence_ratios", "nfkc_hash", "content_hash_groups", "dedup_by_hash", "repeat_suppression", "chunk_documents", "caption_lines", "cluster_levels", "projection", "stream_tumbling", "stream_sliding", "stream_sessions", "stream_idempotent", "materialized_view", "polygon_simplified"}))
def test_everything_else_stays_in_the_jvm(spark, name):
    assert not re.search("EvalPython|InPandas|InArrow", plan(spark, name))
