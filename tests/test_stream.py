"""Batch = stream, and replay idempotence of the streaming sinks."""

import pytest
from pyspark.sql import functions as F

from testkit import SF_SMALL, rows
from vidmart.operators.dedup import dedup
from vidmart.session import scratch_path
from vidmart.streaming import stream as ST


def test_insert_ignore_stream_random_split_equals_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_linenumber")
    src, tgt = scratch_path(spark, "t-src"), scratch_path(spark, "t-tgt")
    ST.land_in_slices(ev, src, F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)).cast("int"), 3)
    out = ST.stream_insert_ignore(spark, src, ev.schema, tgt, ["l_orderkey", "l_shipdate"])
    batch = dedup(ev, ["l_orderkey", "l_shipdate"], keep="first")
    assert rows(out, "l_orderkey", "l_shipdate") == rows(batch, "l_orderkey", "l_shipdate")
    # a replay of all files (fresh checkpoint) adds nothing
    again = ST.stream_insert_ignore(spark, src, ev.schema, tgt, ["l_orderkey", "l_shipdate"])
    assert again.count() == out.count()


def test_upsert_stream_last_wins(spark):
    a = spark.createDataFrame([("c1", 1, "a"), ("c2", 1, "b")], "channel_id string, v long, t string")
    b = spark.createDataFrame([("c1", 2, "a2"), ("c3", 1, "c")], "channel_id string, v long, t string")
    src, root = scratch_path(spark, "u-src"), scratch_path(spark, "u-root")
    ST.upsert_into(root, a, ["channel_id"], ["v"])
    b.write.parquet(src)
    out = ST.stream_upsert(spark, src, b.schema, root, ["channel_id"], ["v"])
    assert rows(out) == [("c1", 2, "a2"), ("c2", 1, "b"), ("c3", 1, "c")]
    ST.upsert_into(root, b, ["channel_id"], ["v"])      # replay: same table
    assert rows(ST.read_upserted(spark, root)) == [("c1", 2, "a2"), ("c2", 1, "b"), ("c3", 1, "c")]


def test_upsert_survives_a_failed_write_and_a_replay(spark):
    schema = "channel_id string, v long, t string"
    root = scratch_path(spark, "u-crash")
    ST.upsert_into(root, spark.createDataFrame([("c1", 1, "a"), ("c2", 1, "b")], schema), ["channel_id"], ["v"])
    sink = ST.upsert_sink(root, ["channel_id"], ["v"])
    batch = spark.createDataFrame([("c1", 2, "a2"), ("c3", 1, "c"), (None, 5, "n")], schema).repartition(3, "channel_id")
    broken = batch.withColumn("t", F.when(F.col("channel_id") == "c3", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        sink(broken, 0)
    assert rows(ST.read_upserted(spark, root)) == [("c1", 1, "a"), ("c2", 1, "b")]
    sink(batch, 0)
    sink(spark.createDataFrame([("c1", 0, "a3")], schema), 1)      # the later batch wins over a greater v
    sink(batch, 0)                                                 # replayed late: keeps its place
    want = {("c1", 0, "a3"), ("c2", 1, "b"), ("c3", 1, "c"), (None, 5, "n")}
    assert {tuple(r) for r in ST.read_upserted(spark, root).collect()} == want
    small = ST.compact_upserted(spark, root, scratch_path(spark, "u-small"), ["channel_id"])
    assert {tuple(r) for r in small.collect()} == want


def test_hourly_stream_equals_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "value")
    src, root = scratch_path(spark, "h-src"), scratch_path(spark, "h-root")
    ST.land_in_slices(ev, src, F.floor(F.dayofmonth("ts") / 8).cast("int"), 4)
    s = ST.stream_hourly(spark, src, ev.schema, root, "ts", "value", watermark="1 day")
    b = ST.hourly_window_counts(ev, "ts", "value")
    assert rows(s, "hour_start", "n_events") == rows(b, "hour_start", "n_events")
