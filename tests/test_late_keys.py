"""Late-row audit of the bounded-state append, and stable keys of a growing dictionary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from testkit import rows
from vidmart.operators.dedup import extend_keys
from vidmart.session import scratch_path
from vidmart.streaming import late as LT
from vidmart.streaming import parts as PT
from vidmart.streaming import stream as ST

DAY = dt.datetime(2024, 1, 1)


def _batches():
    """(batch, key, hours after DAY): late, repeated, untimed and expired keys."""
    return [(0, 1, 0), (0, 2, 30), (0, 2, 31), (0, 9, None),
            (1, 1, 1), (1, 3, 40), (1, 4, 2),                 # nothing is late yet: the first mark counts from batch 2
            (2, 5, 20), (2, 6, 21), (2, 2, 32), (2, 7, 90),   # mark of late rows 31 - 10 = 21 h: 5 and 6 are late
            (3, 3, 29), (3, 8, 31), (3, 4, 95), (3, None, 96), (3, None, 97)]   # mark 40 - 10 = 30 h: 3 is late


def _expected(delay=10):
    """The rules in plain Python: the mark of late rows is that of the previous batch."""
    marks, state, kept, audit = [None], {}, [], []
    for b in range(4):
        mine = [(k, h) for n, k, h in _batches() if n == b]
        mark = marks[b - 1] if b else None
        timed = [(k, h) for k, h in mine if h is not None]
        ok = [(k, h) for k, h in timed if mark is None or h > mark]
        out = {}
        for k, h in ok:
            if k not in state and k not in out:
                out[k] = h
        state.update({k: h + delay for k, h in out.items()})
        now = marks[b]
        state = {k: e for k, e in state.items() if now is None or e > now}
        kept += [(k, b) for k in out]
        audit.append((b, len(mine), len(mine) - len(timed), len(timed) - len(ok), len(ok) - len(out), len(out)))
        top = max([h for _, h in timed] + ([marks[b] + delay] if marks[b] is not None else []))
        marks.append(top - delay)
    return kept, audit


def test_late_rows_are_counted(spark):
    data = [(k, None if h is None else DAY + dt.timedelta(hours=h), b) for b, k, h in _batches()]
    df = spark.createDataFrame(data, "k long, ts timestamp_ntz, b int").coalesce(1)
    src = scratch_path(spark, "late-src")
    per = ST.land_in_slices(df, src, F.col("b"), 4, drop=["b"])
    out, audit = LT.stream_within_watermark(spark, src, df.drop("b").schema, scratch_path(spark, "late-root"), ["k"], "ts",
                                            "10 hours", files_per_trigger=per)
    kept, want = _expected()
    got = rows(audit, "batch_id", "n_arrived", "n_untimed", "n_late", "n_duplicates", "n_kept")
    assert got == want
    assert sorted(r.k if r.k is not None else -1 for r in out.collect()) == sorted(-1 if k is None else k for k, _ in kept)
    assert all(a == u + late + d + k for _, a, u, late, d, k in got)
    # the batch twin less the rows that were counted as late
    assert sum(r[3] for r in got) == 3 and out.count() == sum(r[5] for r in got)


def test_a_second_run_adds_its_own_batches(spark):
    schema = "k long, ts timestamp"
    src, root, ck = (scratch_path(spark, n) for n in ("late-src", "late-root", "late-ck"))
    spark.createDataFrame([(1, DAY), (2, DAY)], schema).write.parquet(src)
    one = spark.createDataFrame([], schema).schema
    LT.stream_within_watermark(spark, src, one, root, ["k"], "ts", "1 hour", checkpoint=ck)
    spark.createDataFrame([(2, DAY), (3, DAY + dt.timedelta(hours=1))], schema).write.mode("append").parquet(src)
    out, audit = LT.stream_within_watermark(spark, src, one, root, ["k"], "ts", "1 hour", checkpoint=ck)
    assert sorted(r.k for r in out.collect()) == [1, 2, 3]
    assert sum(r.n_arrived for r in audit.collect()) == 4 and sum(r.n_kept for r in audit.collect()) == 3


def test_given_keys_stay(spark):
    known = spark.createDataFrame([(1, "b"), (2, "d")], "topic_id long, topic string")
    got = extend_keys(known, spark.createDataFrame([("a",), ("c",), ("d",), (None,), ("c",)], "topic string"), "topic", "topic_id")
    assert rows(got) == [(3, "a"), (4, "c")]
    first = extend_keys(known.limit(0), known.select("topic"), "topic", "topic_id")
    assert rows(first) == [(1, "b"), (2, "d")]


def test_dictionary_survives_a_failed_batch_and_a_replay(spark):
    root = scratch_path(spark, "keys")
    sink = PT.key_sink(root, "v", "id")
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    sink(batch("m", "c", None, "m"), 0)
    broken = batch("a", "z").withColumn("v", F.when(F.col("v") == "z", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        sink(broken, 1)
    read = lambda: rows(PT.read_keys(spark, root, "v", batch("x").schema["v"].dataType, "id"))
    assert read() == [(1, "c"), (2, "m")]
    sink(batch("a", "z", "d"), 1)
    sink(batch("a", "z", "q"), 1)                       # delivered again: nothing changes
    sink(batch("m"), 2)                                 # nothing new
    assert read() == [(1, "c"), (2, "m"), (3, "a"), (4, "d"), (5, "z")]
