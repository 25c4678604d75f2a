"""Zoned times, durations, unlabelled videos, text repair, unordered and replayed streams, pruned sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from testkit import SF_SMALL, rows
from vidmart.functions import text as TX
from vidmart.functions.timefn import iso_duration_seconds, parse_timestamp
from vidmart.operators import ml as ML
from vidmart.plans.warehouse import comment_metrics
from vidmart.session import scratch_path
from vidmart.sources.ingest import json_fields
from vidmart.streaming import stream as ST


@pytest.mark.parametrize(("text", "want"), [
    ("2024-01-01T10:00:00Z", dt.datetime(2024, 1, 1, 10)), ("2024-01-01T10:00:00+07:00", dt.datetime(2024, 1, 1, 3)),
    ("2024-01-01T10:00:00.250Z", dt.datetime(2024, 1, 1, 10, 0, 0, 250000)), ("2024-01-01", dt.datetime(2024, 1, 1)),
    ("2024-01-01T10:00:00", dt.datetime(2024, 1, 1, 10)), ("2024-13-01T10:00:00Z", None), ("soon", None), (None, None)])
def test_parse_timestamp_zones(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_timestamp("t")).first()[0] == want


def test_duration_fraction(spark):
    df = spark.createDataFrame([("PT1.5S",), ("PT1M0.9S",), ("PT2S",), ("x",)], "t string")
    assert [r[0] for r in df.select(iso_duration_seconds("t")).collect()] == [1, 60, 2, 0]


def test_unlabelled_video_has_no_class_counts(spark):
    c = spark.createDataFrame([("a", "v1", None, None), ("b", "v2", 3, "positive")], "comment_id string, video_id string, like_count long, sentiment_label string")
    got = {r["video_id"]: r for r in comment_metrics(c).collect()}
    assert got["v1"]["positive_count"] is None and got["v1"]["total_likes"] == 0 and got["v1"]["sentiment_score"] is None
    assert got["v2"]["positive_count"] == 1 and got["v2"]["negative_count"] == 0


def _repaired(t):
    try:
        return t.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return t


def test_repair_text_against_the_codecs(spark):
    broken = [s.encode().decode("cp1252", "ignore") for s in ("Việt Nam", "é€—“x”", "日本", "plain")]
    texts = [*broken, "é", "Ã", "\x81", "\x90 Ã©", "日本", "", "a\nÃ©", "€", "Ž™", "-]^\\ Ã©"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(TX.repair_text("t")).collect()] == [_repaired(t) for t in texts]


def test_json_fields_keeps_every_field(spark):
    df = spark.createDataFrame([('{"k": 1, "m": "x"}',), ("{}",)], "j string")
    assert rows(json_fields(df, "j", "k BIGINT, m STRING", {"k": 0})) == [(0, None), (1, "x")]


def test_surrogate_keeps_rows_with_null_features(spark):
    df = spark.createDataFrame([(float(i), None if i % 4 == 0 else float(i % 7), int(i > 10)) for i in range(40)], "a double, b double, y int")
    coef, means = ML.fit_surrogate(df, ["a", "b"], "y")
    got = ML.contributions(df, coef, means).select("b", F.expr("filter(all_contributions, x -> x.feature = 'b')[0].value").alias("c"))
    assert all(r["c"] == 0.0 for r in got.collect() if r["b"] is None)


def _events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "value")


def test_hourly_stream_unordered_files_and_replay(spark):
    ev = _events(spark)
    src, log = scratch_path(spark, "u-src"), scratch_path(spark, "u-log")
    ST.land_in_slices(ev, src, F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int"), 4)
    s = ST.stream_hourly(spark, src, ev.schema, log, "ts", "value", files_per_trigger=1)
    b = rows(ST.hourly_window_counts(ev, "ts", "value"), "hour_start", "n_events")
    assert rows(s, "hour_start", "n_events") == b
    sink = ST.hourly_sink(log, "ts", "value")
    batch = spark.read.parquet(log).agg(F.max("_batch")).first()[0]
    last = ev.where("event_id < 100")
    sink(last, batch + 1)
    once = rows(ST.read_hourly(spark.read.parquet(log)), "hour_start", "n_events")
    sink(last, batch + 1)  # the same batch again
    assert rows(ST.read_hourly(spark.read.parquet(log)), "hour_start", "n_events") == once
    assert rows(ST.compact_hourly(spark, log, scratch_path(spark, "u-compact")), "hour_start", "n_events") == once


def test_sink_reads_only_touched_partitions(spark):
    path = scratch_path(spark, "prune")
    spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("p")).write.partitionBy("p").parquet(path)
    target = spark.read.parquet(path)
    some = ST.in_partitions_of(target, spark.createDataFrame([(3,), (4,)], "p int"), "p")
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "IN (3,4)" in plan.replace("INSET", "IN").replace("3, 4", "3,4")
    assert some.count() == 20
