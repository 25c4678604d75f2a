"""Sinks with a manifest: whole commits, replays, key filters, bounded reads."""

import random

import pytest
from pyspark.sql import functions as F

from testkit import rows
from vidmart.session import scratch_path
from vidmart.streaming import parts as PT

SCHEMA = "k string, v long"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_quarantine_fails_between_the_writes_and_is_replayed(spark, monkeypatch):
    root = scratch_path(spark, "q")
    sink = PT.quarantine_sink(root, {"positive": F.col("v") > 0, "named": F.col("k").isNotNull()})
    first, second = frame(spark, [("a", 1), ("b", -1)]), frame(spark, [("c", 2), (None, -2), (None, 3), ("d", None)])
    sink(first, 0)
    write = PT.Parts.write

    def broken(self, df, table, **about):
        if table == PT.REJECTS:
            raise OSError("lost")
        return write(self, df, table, **about)

    good = lambda: rows(PT.read_parts(spark, root, PT.GOOD, first.schema))
    bad = lambda: sorted((r["k"], r["v"], tuple(r[PT.FAILED])) for r in PT.read_rejects(spark, root, first.schema).fillna("", "k").fillna(0, "v").collect())
    before = good(), bad()
    monkeypatch.setattr(PT.Parts, "write", broken)
    with pytest.raises(OSError, match="lost"):
        sink(second, 1)
    monkeypatch.setattr(PT.Parts, "write", write)
    assert (good(), bad()) == before == ([("a", 1)], [("b", -1, ("positive",))])
    commit = PT.Parts.commit

    def late(self, *a):
        raise OSError("before the commit")

    monkeypatch.setattr(PT.Parts, "commit", late)
    with pytest.raises(OSError, match="before"):
        sink(second, 1)
    monkeypatch.setattr(PT.Parts, "commit", commit)
    assert (good(), bad()) == before
    for _ in range(2):  # the replay, and one more delivery
        sink(second, 1)
    want = [("a", 1), ("c", 2)], [("", -2, ("positive", "named")), ("", 3, ("named",)), ("b", -1, ("positive",)), ("d", 0, ("positive",))]
    assert (good(), bad()) == want
    assert PT.Parts(spark, root).vacuum() == 3 and (good(), bad()) == want


def test_new_keys_read_no_old_part(spark, monkeypatch):
    root = scratch_path(spark, "n")
    sink = PT.insert_new_sink(root, ["k"], ["v"], fan=3)
    read_before = []
    asked = PT.parts_with
    monkeypatch.setattr(PT, "parts_with", lambda *a: read_before.append(asked(*a)) or read_before[-1])
    for b in range(7):
        sink(frame(spark, [(f"k{b}-{i}", i) for i in range(50)] + [(f"k{b}-0", -1)]), b)
    assert read_before == [[]] * 7  # no file of an earlier batch is opened for new keys
    assert len(PT.Parts(spark, root).of(PT.FILTER)) <= 4 and len(PT.Parts(spark, root).of(PT.ROWS)) == 7
    sink(frame(spark, [("k2-5", 99), ("k2-6", 99), ("new", 1), ("new", 2)]), 7)
    state = PT.Parts(spark, root)
    assert 1 <= len(read_before[-1]) <= 3  # the parts whose (merged) filter holds a key
    got = {r["k"]: r["v"] for r in PT.read_parts(spark, root, PT.ROWS, frame(spark, []).schema).collect()}
    assert len(got) == 351 and got["k2-5"] == 5 and got["new"] == 1 and got["k3-0"] == -1
    sink(frame(spark, [("k2-5", 99)]), 7)  # delivered again: skipped
    assert PT.Parts(spark, root).number == state.number


def test_filters_miss_no_key(spark):
    keys = frame(spark, [(f"x{i}", i) for i in range(3000)] + [(None, 1)])
    words, log = PT.key_filter(keys, ["k"], 3000)
    word, bits = PT._word(["k"], F.lit(log))
    ask = lambda df: df.select("k", word.alias("word"), bits.alias("b")).join(words, "word").where(F.col("b").bitwiseAND(F.col("bits")) == F.col("b")).count()
    assert ask(keys) == 3001
    assert ask(frame(spark, [(f"y{i}", i) for i in range(20_000)])) < 40


def test_fifty_batches_are_few_parts(spark, monkeypatch):
    rng, root, fan = random.Random(2), scratch_path(spark, "l"), 4
    sink, want = PT.upsert_levels_sink(root, ["k"], ["v"], fan=fan), {}
    write = PT.Parts.write
    for b in range(50):
        data = [(f"k{rng.randint(0, 40)}", b * 10 + j) for j in range(5)]
        if b in (15, 31):  # the commit that merges two levels fails and comes again
            def broken(self, df, table, level=0, **about):
                if level == 1:
                    raise OSError("lost")
                return write(self, df, table, level=level, **about)
            monkeypatch.setattr(PT.Parts, "write", broken)
            with pytest.raises(OSError, match="lost"):
                sink(frame(spark, data).coalesce(1), b)
            monkeypatch.setattr(PT.Parts, "write", write)
        sink(frame(spark, data).coalesce(1), b)
        want.update({k: max(v for x, v in data if x == k) for k, _ in data})
        assert len(PT.Parts(spark, root).parts) <= (fan - 1) * 3
    assert {r["k"]: r["v"] for r in PT.read_levels(spark, root, frame(spark, []).schema, ["k"]).collect()} == want
    assert len(PT.Parts(spark, root).parts) == sum(int(d) for d in "302")  # 50 in base 4
