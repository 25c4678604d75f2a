"""Property tests (hypothesis) and SURVEY §5 invariants on driver data."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from testkit import SF_SMALL, rows
from vidmart.functions.numeric import round_ratio_half_even
from vidmart.functions.timefn import iso_duration_seconds
from vidmart.operators import dedup as D
from vidmart.operators import insight as I
from vidmart.operators import ml as ML
from vidmart.operators import profile as P
from vidmart.operators.ranking import global_rank

SETTINGS = settings(max_examples=15, deadline=None)


def _half_even(n: int, d: int, digits: int) -> float:
    x = Fraction(n, d) * 10 ** digits
    q, r = divmod(x.numerator, x.denominator)
    if 2 * r > x.denominator or (2 * r == x.denominator and q % 2 == 1):
        q += 1
    return q / 10 ** digits


@SETTINGS
@given(st.lists(st.tuples(st.integers(-10**6, 10**6), st.integers(1, 5000)), min_size=1, max_size=30))
def test_ratio_rounding_matches_exact_fractions(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(round_ratio_half_even("n", "d", 4)).collect()]
    assert got == [_half_even(n, d, 4) for n, d in pairs]


@SETTINGS
@given(st.lists(st.integers(0, 20), min_size=1, max_size=200), st.integers(1, 9))
def test_global_rank_is_a_stable_total_numbering(spark, keys, parts):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long").repartition(parts)
    got = [(r.k, r.i) for r in global_rank(df, ["k", "i"], "r").orderBy("r").collect()]
    assert got == sorted((k, i) for i, k in enumerate(keys))


@SETTINGS
@given(st.tuples(*[st.one_of(st.none(), st.integers(0, 500)) for _ in range(5)]))
def test_iso_duration_matches_components(spark, parts):
    w, d, h, m, s = parts
    text = "P" + (f"{w}W" if w is not None else "") + (f"{d}D" if d is not None else "")
    if any(x is not None for x in (h, m, s)):
        text += "T" + "".join(f"{v}{u}" for v, u in ((h, "H"), (m, "M"), (s, "S")) if v is not None)
    want = sum((v or 0) * k for v, k in zip(parts, (604800, 86400, 3600, 60, 1)))
    got = spark.createDataFrame([(text,)], "t string").select(iso_duration_seconds("t")).first()[0]
    assert got == want


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_more_operators_partition_independent(spark, parts):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    base = ev.repartition(1)
    moved = ev.repartition(parts)
    order = [F.col("value").desc(), F.col("event_id")]
    assert rows(D.cap_per_key(moved, ["user_id"], order, 3)) == rows(D.cap_per_key(base, ["user_id"], order, 3))
    fnn = lambda d: D.first_nonnull(d.withColumn("v", F.when(F.col("value") > 100, F.col("value"))),
                                    ["user_id"], ["ts", "event_id"], ["v", "event_type"])
    assert rows(fnn(moved)) == rows(fnn(base))
    assert rows(D.pack_batches(moved, "user_id", 7)) == rows(D.pack_batches(base, "user_id", 7))
    split = lambda d: ML.stratified_split(d.select("event_id", (F.col("event_type") == "purchase")
                                                   .cast("int").alias("y")), "y", "event_id")
    assert rows(split(moved)) == rows(split(base))


def test_crosstab_and_histogram_sums(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    ct = I.crosstab(o, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    assert ct.agg(F.sum(F.col("F") + F.col("O") + F.col("P"))).first()[0] == o.count()
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    h = P.histogram(ev, "value", bins=50, by=["event_type"])
    assert h.agg(F.sum("count")).first()[0] == ev.where(F.col("value").isNotNull()).count()
    pct = I.crosstab_pct(o, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    for r in pct.collect():
        assert r.F + r.O + r.P == pytest.approx(100.0)


def test_split_keeps_class_share_within_one_row(spark):
    d = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("y"))
    s = ML.stratified_split(d, "y", "event_id")
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = c[(y, "train")] + c[(y, "test")]
        assert abs(c[(y, "test")] - 0.2 * n) <= 1


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 6)), min_size=1, max_size=120),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_select_quantiles_equal_sort_quantiles(spark, data, probs):
    from vidmart.operators.ranking import exact_quantiles
    df = spark.createDataFrame(data, "g string, v long")
    a = rows(exact_quantiles(df, "v", probs, ["g"], method="select"))
    b = rows(exact_quantiles(df, "v", probs, ["g"], method="sort"))
    assert [(g, q, round(x, 9)) for g, q, x in a] == [(g, q, round(x, 9)) for g, q, x in b]
