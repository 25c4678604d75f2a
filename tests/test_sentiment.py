"""Sentiment queries over every labelled comment."""

import datetime as dt

import pytest

from vidmart.plans.driver import catalogue


@pytest.fixture
def tables(spark, tmp_path):
    """Two labelled comments of each of 33 videos and one without a class, as events and customers."""
    kinds = ["purchase", "error", "other"]
    events = [(3 * u + i, u, dt.datetime(2024, 1, 1), k, 50.0 + u) for u in range(1, 34) for i, k in enumerate(kinds)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(u, 100.0 if u < 12 else 6000.0) for u in range(1, 34)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_every_labelled_video_has_features(spark, tables):
    got = {r["video_id"]: r for r in catalogue.QUERIES["sentiment_features"](spark, tables).collect()}
    assert sorted(got) == list(range(1, 34))
    assert (got[11]["total"], got[11]["positive_ratio"], got[11]["neutral_ratio"], got[11]["mean_score"]) == (2, 0.5, 0.0, 0.61)


def test_every_labelled_video_counts_by_trending(spark, tables):
    got = {r["is_trending"]: r["n_videos"] for r in catalogue.QUERIES["sentiment_by_trending"](spark, tables).collect()}
    assert got == {0: 11, 1: 22}


def test_comment_metrics_keeps_its_unlabelled_videos(spark, tables):
    got = {r["video_id"]: r["positive_count"] for r in catalogue.QUERIES["comment_metrics"](spark, tables).collect()}
    assert len(got) == 33 and sorted(u for u in got if got[u] is None) == [11, 22, 33]
