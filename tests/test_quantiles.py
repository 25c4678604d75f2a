"""Exact quantiles by bracketed selection: equal to the sort, and to numpy, whatever the data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidmart.operators import profile as P
from vidmart.operators import ranking as R

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r[:-1])
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert [r[:-1] for r in a] == [r[:-1] for r in b]
    for x, y in zip(a, b, strict=True):
        assert x[-1] == y[-1] or (math.isnan(x[-1]) and math.isnan(y[-1])) or math.isclose(x[-1], y[-1], rel_tol=1e-12), (x, y)


def sample(spark, n=6000):
    rng = random.Random(4)
    kinds = {"even": lambda i: rng.random(), "heavy": lambda i: rng.choice([0.0, 0.0, 0.0, 1.0, rng.random()]), "two": lambda i: float(i % 2),
             "odd": lambda i: rng.choice([float("nan"), float("inf"), -float("inf"), None, -0.0, 5.5]), "null": lambda i: None, "one": lambda i: 7.0,
             None: lambda i: rng.gauss(0, 1e9)}
    rows = [(g, f(i)) for g, f in kinds.items() for i in range(n // len(kinds))] + [(f"small{k}", float(k * j)) for k in range(40) for j in range(k % 5)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize(("band", "margin"), [(1_000_000, 0.005), (30, 0.005), (1_000_000, 1e-6), (5, 1e-6)])
def test_select_equals_sort(spark, monkeypatch, band, margin):
    """Small bands force further passes, small margins missed brackets."""
    monkeypatch.setattr(R, "BAND_ROWS", band)
    monkeypatch.setattr(R, "MARGIN", margin)
    df = sample(spark)
    for by in (["g"], []):
        got = R.exact_quantiles(df, "v", PROBS, by)
        same([tuple(r) for r in got.collect()], [tuple(r) for r in R.exact_quantiles(df, "v", PROBS, by, method="sort").collect()])


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.exponential(10, 30_000), np.full(15_000, 3.25)])
    df = spark.createDataFrame([(float(x),) for x in values], "v double")
    got = {r["q"]: r["value"] for r in R.exact_quantiles(df, "v", PROBS).collect()}
    for p in PROBS:
        assert math.isclose(got[p], float(np.quantile(values, p)), rel_tol=1e-12)


def test_only_the_bands_are_moved(spark, monkeypatch):
    """What the second pass puts out is a small share of the values, and equal values are one row."""
    sizes = {}
    written = R._written
    monkeypatch.setattr(R, "_written", lambda df, name: sizes.setdefault(name, []).append(out := written(df, name)) or out)
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("v"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).cast("double").alias("w"))
    R.quantiles_with(df, {"v": F.col("v"), "w": F.col("w")}, [0.25, 0.5, 0.75])
    bands = sizes["bands"][-1]
    assert bands.count() < 0.05 * 400_000
    assert bands.where("_vm_t >= 0").groupBy("_vm_t", "_vm_v").count().where("count > 1").isEmpty()


def test_describe_of_many_columns_and_nothing(spark):
    df = spark.range(500).select(*[(F.col("id") * (i + 1) % 97).cast("double").alias(f"c{i}") for i in range(25)], (F.col("id") % 2).alias("g"))
    cols = [f"c{i}" for i in range(25)]
    for by in ([], ["g"]):
        a, b = (sorted(map(tuple, P.describe_numeric(df, cols, by, method=m).collect())) for m in ("select", "sort"))
        assert len(a) == 25 * (2 if by else 1)
        for x, y in zip(a, b, strict=True):
            assert x[0] == y[0] and all(math.isclose(p, q, rel_tol=1e-9) for p, q in zip(x[2:], y[2:], strict=True) if not isinstance(p, str))
    none = P.describe_numeric(df.where("false"), ["c0", "c1"]).collect()
    assert [(r["column"], r["count"], r["p50"]) for r in none] == [("c0", 0, None), ("c1", 0, None)]
    assert P.describe_numeric(df.where("false"), ["c0"], ["g"]).collect() == []


@pytest.mark.parametrize("limit", [100_000, 3])
def test_split_without_a_sort_equals_the_ranked_one(spark, monkeypatch, limit):
    from vidmart.operators import ml as ML
    monkeypatch.setattr(ML, "SPLIT_ROWS", limit)
    df = spark.range(3000).select("id", F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 7 == 0, 1).when(F.col("id") == 1, 2).otherwise(0).alias("y"))
    for data in (df, df.unionByName(df.where("id < 40")), df.where("false"), df.where("id < 2")):
        h = F.md5(F.concat(F.col("id").cast("string"), F.lit("42")))
        want = ML._ranked_split(data.where("y is not null").withColumn("_vm_h", h), "y", "id", 0.2, "split")
        got = ML.stratified_split(data, "y", "id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.columns == ["id", "y", "split"]
    assert "Exchange" not in ML.stratified_split(df, "y", "id")._jdf.queryExecution().executedPlan().toString()
