"""The registered queries: all operators are there, and a few of each family against their SQL."""

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tierlake.operators import rollup
from tierlake.plans import catalog, store, timeseries
from tierlake.sources import tiers

SF = "/root/testdata/sf0.001"
# The operators of the blueprint, family by family.
OPERATORS = """
scan_tier write_tier write_samples tier_stats normalise_poll_results ingest_summary adhoc_sql
filter_samples valid_only tier_bucket history history_all
rollup_5min rollup_raw_tier rollup_direct percentiles_exact percentiles_approx percentiles_relative percentiles_kll
rollup_merge rollup_merge_percentiles rollup_cascade compact_range aggregate_span
select_tier query_series query_target query_many merge_hot query_preferred
count_samples sample_range latest_sample hot_window trim_latest retain_samples delete_series retention_apply retention_report
counter_rate rate_rollup
poll_outcome poller_stats poller_stats_merge stats_global stats_by_namespace stats_by_target success_rate p95_poll_ms
fleet_status namespace_status namespace_counts target_counts target_detail poller_full_info health_counts oper_counts metric_alerts
health_timeline health_current health_transitions reachability_sticky level_hysteresis level_change_counts
stream_rollup_5min late_audit stream_health stream_poller_stats stream_fanout subscriptions_resolve stream_levels
list_targets list_pollers list_namespaces page_targets targets_by_label targets_with_label label_values label_histogram set_labels
label_filter enabled_pollers tag_index tag_query tag_query_and tag_query_or tag_counts tag_children has_tag update_tags
filter_targets host_glob index_counts effective_config delete_preview config_violations
view_paths_targets view_paths_pollers view_group_counts tree_children tree_ancestors tree_subtree tree_browse tree_browse_all
smart_folder_targets smart_folder_status link_resolve dangling_links links_to path_resolve target_listing poller_listing
content_hash inventory_diff diff_summary diff_actionable inventory_apply policy_route orphan_entities sync_unchanged
hierarchy_rollup board_counts relation_count metric_column entity_changes
""".split()


def test_every_operator_is_registered():
    assert set(OPERATORS) <= set(entry.queries())
    assert all(q.sql for q in catalog.QUERIES.values())


def test_the_rest_works_without_the_training_data_operators(monkeypatch):
    """As where their package and the pipeline are not installed."""
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None if name in ("tierlake.llm", "corpus_pipeline") else real(name))
    assert set(entry.queries()) == set(catalog.QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "bucket_start" in df.columns


@pytest.mark.parametrize(
    "name",
    ["normalise_poll_results", "rollup_direct", "query_target", "counter_rate", "fleet_status", "health_timeline",
     "effective_config", "tree_browse_all", "inventory_diff", "late_audit"],
)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    text, _, good = check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good and "types" not in text, text


@pytest.mark.parametrize("name", ["scan_tier", "rollup_cascade"])
def test_the_span_of_a_cascade_comes_from_the_stored_samples(spark, monkeypatch, name):
    """The events are joined once, to be stored, and not a second time for their first and last time."""
    wanted = store.span(spark, SF)
    asked = []
    real = rollup.run_cascade

    def run(session, root, first, end):
        asked.append((first, end - 1))
        real(session, root, first, end)

    monkeypatch.setattr(store, "_BUILT", {})
    monkeypatch.setattr(store, "span", lambda *_: pytest.fail("joined again"))
    monkeypatch.setattr(store, "run_cascade", run)
    monkeypatch.setattr(rollup, "run_cascade", run)
    entry.queries()[name](spark, SF)
    assert asked == [wanted]


def test_an_invalidated_day_leaves_the_files_of_other_days(spark, monkeypatch):
    """Both cascades still run over the whole span; the samples of the other dates are not written again."""
    listed, asked = [], []
    rewrite, cascade = tiers.rewrite_dates, rollup.run_cascade

    def rewriting(session, root, name, *rest):
        listed.append(tiers.stored_dates(session, f"{root}/{name}"))
        rewrite(session, root, name, *rest)
        listed.append(tiers.stored_dates(session, f"{root}/{name}"))

    def run(session, root, *span):
        asked.append(span)
        cascade(session, root, *span)

    monkeypatch.setattr(tiers, "rewrite_dates", rewriting)
    monkeypatch.setattr(rollup, "run_cascade", run)
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    name = "cascade_after_invalidation"
    text, _, good = check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good and "types" not in text, text
    before, after = listed
    assert set(before) == set(after)
    assert {d for d in before if before[d] != after[d]} == {tiers.utc_day(timeseries.INVALID_DAY)}
    assert len(asked) == 2 and asked[0] == asked[1]
