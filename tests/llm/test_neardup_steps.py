"""Steps of the near-duplicate search: components of several graphs at once, keys told by a bitmap."""

import random

import pytest
from pyspark.sql import functions as F

from vidmart.llm import components as C
from vidmart.llm.common import in_buckets, mostly_in


def by_hand(links):
    least = {}
    for g, u, v in links:
        for x in (u, v) if u != v else ():
            least.setdefault((g, x), x)
    changed = True
    while changed:
        changed = False
        for g, u, v in links:
            if u != v and least[g, u] != least[g, v]:
                least[g, u] = least[g, v] = min(least[g, u], least[g, v])
                changed = True
    return sorted((g, x, c) for (g, x), c in least.items())


def test_components_of_several_graphs_in_the_same_rounds(spark):
    rng = random.Random(3)
    links = [("a", 1, 5), ("b", 5, 9), ("b", 2, 9), ("a", 7, 7), ("a", -4, 5)]
    links += [("chain", i, i + 1) for i in range(40)] + [("hub", 99, i) for i in range(30)]
    links += [("any", rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    df = spark.createDataFrame(links, "g string, u long, v long")
    assert sorted(map(tuple, C.components(df, "g").collect())) == by_hand(links)
    chain = df.where("g = 'chain'").select("u", "v")
    assert sorted(map(tuple, C.components(chain).collect())) == [(x, 0) for x in range(41)]
    assert C.components(df.where("false"), "g").collect() == []


def test_stars_are_done_without_a_round(spark, monkeypatch):
    monkeypatch.setattr(C, "_large_star", lambda *a: pytest.fail("stars need no round"))
    stars = spark.createDataFrame([(1, 5), (5, 1), (1, 6), (2, 7)], "u long, v long")
    assert sorted(map(tuple, C.components(stars).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)]


def test_other_texts_are_left_out_before_the_shuffle(spark):
    texts = spark.range(-5000, 5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    ids = spark.createDataFrame([(i,) for i in (-4000, -1, 0, 17, 4999, 12345)], "doc_id long")
    some = mostly_in(texts.unionByName(texts.where("doc_id = 17")), ids, "doc_id")
    got = sorted(r["doc_id"] for r in some.collect())
    assert len(got) < 100 and {-4000, -1, 0, 17, 4999} <= set(got) and got.count(17) == 2
    assert mostly_in(texts, ids.where("false"), "doc_id").count() == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = in_buckets(some, "doc_id").join(ids, "doc_id")
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r["doc_id"] for r in joined.collect()) == [-4000, -1, 0, 17, 17, 4999]
        assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
