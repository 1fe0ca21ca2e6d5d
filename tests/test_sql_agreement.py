"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.run import compare, connect

NAMES = (
    "composite_threshold_sweep", "signal_ngram_overlap", "class_report", "roc_curve", "features_all", "pattern_hits",
    "keyword_scores", "ngram_proposals", "similarity_char", "nearest_centroid_euclidean", "margin_statistics",
    "stratified_split_two_keys", "label_reconciliation", "robustness_transforms", "gated_decision", "cross_dataset",
    "ablation_findings", "adaptive_threshold_clamped", "drift_check", "feedback_buffer", "mined_patterns", "streaming_windows",
    "feature_table", "collapse_check", "stratified_sample", "category_downsampling", "external_caps",
    "load_prompts", "report_sinks",
)


def test_every_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys() and set(NAMES) <= sql.keys()


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf, name):
    ours = entry.queries()[name](spark, sf).toPandas()
    theirs = connect(sf).sql(entry.oracle_sql()[name]).df()
    assert len(ours) > 0 and compare(ours, theirs) == ""


def test_reports_round_trip(spark, sf, tmp_path):
    from promptsieve.sources import sinks

    report = entry.queries()["score_threshold_sweep"](spark, sf)
    for fmt in ("json", "csv", "parquet"):
        target = str(tmp_path / fmt)
        sinks.write_report(report, target, fmt)
        assert sinks.read_report(spark, target, fmt, report.schema).count() == 50
