"""End-to-end refresh on landing-schema micro-tables (FIXTURES.md rows)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vidmart import schemas as S
from vidmart.plans.refresh import cleaned_video, ml_table, refresh_comments, refresh_warehouse

T = dt.datetime


def landing(spark):
    video = spark.createDataFrame([
        ("v1", "Song", "line1\nline \"2\"", "c1", "Chan 1", "2024-12-30T10:15:00Z", "u", "k", "trending", "trending",
         T(2025, 1, 1)),
        ("v1", "Song", "dup", "c1", "Chan 1", "2024-12-30T10:15:00Z", "u", "k", "music", "search", T(2025, 1, 2)),
        ("v2", "Game", "", "c2", "Chan 2", "not a date", "u", "k", None, "search", T(2025, 1, 1)),
        ("v3", "Talk", "", "c2", "Chan 2", "2021-01-01T23:00:00Z", "u", "k", "", "trending", T(2025, 1, 1)),
    ], S.RAW_VIDEO)
    stats = spark.createDataFrame([
        ("v1", 1, "100", "5", "1", 200, "hd", "false", "2d", True, 10, None, "vi", "a,b", T(2025, 1, 1, 1)),
        ("v1", 1, "200", "8", "2", 200, "hd", "false", "2d", True, 10, "vi", "vi", "a,b", T(2025, 1, 1, 2)),
        ("v1", 1, "200", "8", "2", 200, "hd", "false", "2d", True, 10, "vi", "vi", "a,b", T(2025, 1, 1, 2)),
        ("v2", 0, "0", "0", "0", 50, "sd", "true", "2d", False, 20, None, None, "", T(2025, 1, 1, 1)),
        ("v2", 0, "abc", "3", None, 50, "sd", "true", "2d", False, 20, None, None, "", T(2025, 1, 1, 3)),
        ("v3", 0, "12.0", "2", "1", 30, "sd", "true", "2d", False, 24, None, "pa", "", T(2025, 1, 1, 1)),
    ], S.RAW_VIDEO_STATS)
    chan = spark.createDataFrame([
        ("c1", "Chan 1", "@c1", "", "2020-01-01", "VN", 1000, 5000, 10, False, 1),
        ("c1", "Chan 1b", "@c1", "", "2020-01-01", "VN", 2000, 6000, 11, False, 2),
        ("c2", "Chan 2", "@c2", "", "2020-01-01", None, 0, 100, 3, False, 1),
    ], StructType(S.RAW_CHANNEL.fields + [StructField("ingest_seq", IntegerType())]))
    return video, stats, chan


def test_refresh_end_to_end(spark):
    video, stats, chan = landing(spark)
    w = refresh_warehouse(video, stats, chan, channel_order=["ingest_seq"])
    topics = sorted(tuple(r) for r in w["dim_topic"].collect())
    assert topics == [(1, "music"), (2, "trending")]
    assert {r.channel_id: r.subscriber_count for r in w["dim_channel"].collect()} == {"c1": 2000, "c2": 0}
    tm = {r.time_id: (r.week_of_year, r.weekday) for r in w["dim_time"].collect()}
    assert tm == {"2024123010": (1, 0), "2021010123": (53, 4)}
    dv = {r.video_id: r for r in w["dim_video"].collect()}
    assert dv["v1"].source == "trending" and dv["v1"].default_language == "vi" and dv["v1"].topic_id == 2
    assert dv["v2"].time_id is None
    fact = w["fact_video_metrics"]
    assert fact.count() == 5
    flat = w["final_dataset"]
    f1 = [r for r in flat.collect() if r.video_id == "v1"]
    assert all(r.topic == "music" for r in f1)            # trending topic back-filled from category 10
    cleaned = cleaned_video(flat)
    c = {(r.video_id, r.views): r for r in cleaned.collect()}
    assert ("v2", 0) not in c                             # views > 0 filter
    assert c[("v1", 200)].country_region == "Southeast Asia" and c[("v1", 200)].like_rate == 0.04
    assert c[("v3", 12)].country_region == "South Asia"   # no country, no language -> audio language 'pa'
    ml = {r.video_id: r for r in ml_table(cleaned).collect()}
    assert ml["v1"].is_trending is True and ml["v1"].publish_hour == 10


def test_refresh_comments(spark):
    video, stats, chan = landing(spark)
    comments = spark.createDataFrame([
        ("k1", "v1", "u1", "good", "3", T(2025, 1, 1), T(2025, 1, 1)), ("k1", "v1", "u1", "again", "9", T(2025, 1, 2), None),
        ("k2", "v1", "u2", None, "bad", None, None), ("k3", "v2", "u3", "so", "4.0", T(2025, 1, 1), None),
        ("k4", None, "u4", "no video", "1", None, None), (None, "v1", "u5", "no id", "1", None, None),
    ], S.RAW_COMMENT)
    w = refresh_warehouse(video, stats, chan, ["ingest_seq"], comments, ["published_at"])
    fact = w["fact_comment"]
    assert [(f.name, f.dataType) for f in fact.schema] == [(f.name, f.dataType) for f in S.FACT_COMMENT]
    # a comment without a time sorts first; k1 occurs with two times
    assert {(r.comment_id, r.like_count, r.comment_text) for r in fact.collect()} == \
        {("k1", 3, "good"), ("k2", 0, None), ("k3", 4, "so")}
    m = {r.video_id: r for r in w["fact_comment_metrics"].collect()}
    assert (m["v1"].total_comments, m["v1"].total_likes, m["v1"].max_like_comment, m["v1"].positive_count) == (2, 3, 3, None)
    assert w["comment_dataset"].columns == ["comment_id", "video_id", "comment_text", "like_count", "published_at"]
    label = comments.withColumn("sentiment_label", F.when(F.col("video_id") == "v1", F.lit("positive")))
    m = {r.video_id: r for r in refresh_comments(label, ["published_at"])["fact_comment_metrics"].collect()}
    assert (m["v1"].positive_count, m["v1"].sentiment_score, m["v2"].positive_count) == (2, 1.0, None)
    none = refresh_comments(comments.limit(0))
    assert none["fact_comment"].count() == none["fact_comment_metrics"].count() == 0


def test_publish_warehouse_bucketed(spark):
    import contextlib
    import io

    from vidmart.plans.refresh import publish_warehouse
    video, stats, chan = landing(spark)
    w = refresh_warehouse(video, stats, chan, channel_order=["ingest_seq"])
    saved = publish_warehouse(w, prefix="t_pub", buckets=4)
    assert "t_pub_fact_video_metrics" in saved and "t_pub_dim_topic" in saved
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact, dim = spark.table("t_pub_fact_video_metrics"), spark.table("t_pub_dim_video").drop(
            "channel_id", "time_id", "source")
        j = fact.join(dim, "video_id", "left")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            j.explain()
        assert "Exchange" not in buf.getvalue() and j.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
