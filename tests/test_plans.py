"""Shape of the physical plans."""

import pytest

from feedloom.plans.catalog import QUERIES

WRITERS = {
    "scan_jsonl", "tar_roundtrip", "indexed_roundtrip", "indexed_greedy", "random_access", "fanout_formats", "tar_shards", "storage_footprint",
    "materialised_epochs", "feed_tar", "feed_indexed", "feed_parquet", "prepare_corpus", "gauge_windows_stream", "gauge_latest_stream",
    "run_spans_stream", "gauge_upserts", "live_counters", "byte_shards", "resolve_samples", "shard_balance",
    "mapped_samples", "layout_pairs", "shard_list", "results_roundtrip",
}


def plan_of(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_cross_join(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def exchanged_columns(df):
    """The columns that each exchange of a plan carries."""

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if "Exchange" in node.nodeName():
            yield {node.output().apply(i).name() for i in range(node.output().size())}
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("name", ["batch_tokens", "global_shuffle", "index_shuffle", "batches_global", "epoch_orders", "batch_cap", "block_shuffle"])
def test_texts_are_not_shuffled(spark, sf, name):
    exchanged = exchanged_columns(QUERIES[name](spark, sf))
    assert exchanged and not any("text" in columns for columns in exchanged)


def test_texts_that_are_shuffled_are_seen(spark, sf):
    assert any("text" in columns for columns in exchanged_columns(QUERIES["collate_text"](spark, sf)))


@pytest.mark.parametrize("name", ["data_stall", "first_batch_latency", "gauge_latest", "epoch_average", "corpus_profile", "batch_waits", "active_batches"])
def test_aggregates_hash(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name,columns", [("epoch_metrics", "event_type"), ("sample_keys", "doc_id"), ("shape_check", "n_chars")])
def test_scans_read_needed_columns_only(spark, sf, name, columns):
    scans = [line for line in plan_of(spark, sf, name).splitlines() if "ReadSchema" in line]
    assert scans and all("text:string" not in line and "props" not in line for line in scans)


def test_time_range_reaches_the_scan(spark, sf):
    plan = plan_of(spark, sf, "time_range")
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


@pytest.mark.parametrize("name", ["data_stall", "first_batch_latency", "epoch_metrics", "gauge_summary", "panel_stats"])
def test_run_totals_are_plain_aggregates(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") <= 2
