"""Golden micro-tables, invariants and partition independence for operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from testkit import rows
from vidmart.operators import dedup as D
from vidmart.operators import insight as I
from vidmart.operators import ml as ML
from vidmart.operators import profile as P
from vidmart.operators import ranking as R
from vidmart.plans import warehouse as W
from vidmart.sources import ingest as ING
from vidmart.sources import io as IO

T0 = dt.datetime(2024, 1, 1)


def snaps(spark):
    # three snapshots of v1 (first has NULL language), two equal times on v2, an exact duplicate row
    data = [("v1", T0, None, 10), ("v1", T0 + dt.timedelta(hours=1), "en", 20), ("v1", T0 + dt.timedelta(hours=2), "vi", 30),
            ("v2", T0, "ko", 5), ("v2", T0, "ja", 6), ("v3", None, "fr", 1), ("v3", T0, None, 2), ("v3", T0, None, 2)]
    return spark.createDataFrame(data, "video_id string, snapshot_time timestamp_ntz, lang string, views long")


def test_dedup_keep_first_last(spark):
    df = snaps(spark)
    first = rows(D.dedup(df, ["video_id"], ["snapshot_time"], keep="first"))
    last = rows(D.dedup(df, ["video_id"], ["snapshot_time"], keep="last"))
    assert first == [("v1", T0, None, 10), ("v2", T0, "ja", 6), ("v3", T0, None, 2)]
    assert last == [("v1", T0 + dt.timedelta(hours=2), "vi", 30), ("v2", T0, "ko", 5), ("v3", T0, None, 2)]


def test_first_snapshot_vs_first_nonnull(spark):
    df = snaps(spark)
    w3 = {r.video_id: r.lang for r in D.first_snapshot(df, "video_id", "snapshot_time").collect()}
    w4 = {r.video_id: r.lang for r in D.first_nonnull(df, ["video_id"], ["snapshot_time"], ["lang"]).collect()}
    assert w3["v1"] is None and w4["v1"] == "en"        # row vs per-column semantics differ
    assert w4["v3"] == "fr"                              # NULL time sorts last but is the only non-null lang


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partition_independence(spark, parts):
    df = snaps(spark).repartition(parts)
    base = rows(D.dedup(snaps(spark), ["video_id"], ["snapshot_time"]))
    assert rows(D.dedup(df, ["video_id"], ["snapshot_time"])) == base
    g = R.global_rank(spark.range(0, 1000).repartition(parts).withColumn("k", F.col("id") % 97), ["k", "id"], "r")
    got = [r.id for r in g.orderBy("r").collect()]
    assert got == sorted(range(1000), key=lambda i: (i % 97, i))
    assert [r.r for r in g.orderBy("r").collect()] == list(range(1, 1001))


def test_global_rank_hot_key(spark):
    # one key holds a third of the rows: the rank stays gap-free and exact
    df = spark.range(0, 3000).withColumn("k", F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id")))
    g = R.global_rank(df, ["k"], "r")
    assert g.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first() == (1, 3000, 3000)


def test_exact_quantiles_match_linear_interpolation(spark):
    import numpy as np
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 7.0), ("b", None)], "g string, v double")
    q = {r.g: (r.p25, r.p50, r.p90) for r in
         R.quantile_columns(df, "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}, ["g"]).collect()}
    assert q["a"] == pytest.approx(tuple(np.quantile(vals, [0.25, 0.5, 0.9])))
    assert q["b"] == (7.0, 7.0, 7.0)


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "s long, x long").repartition(5)
    t = R.running_totals(df, [F.col("s").desc()], {"cum": "x"})
    got = {r.s: r.cum for r in t.collect()}
    exp, run = {}, 0
    for s in range(49, -1, -1):
        run += s % 3
        exp[s] = run
    assert got == exp


def test_insert_ignore_idempotent(spark):
    target = spark.createDataFrame([("c1", "old"), ("c2", "old")], "comment_id string, txt string")
    batch = spark.createDataFrame([("c2", "new"), ("c3", "new"), ("c3", "dup")], "comment_id string, txt string")
    add = D.insert_ignore(target, batch, ["comment_id"], ["txt"])
    assert rows(add) == [("c3", "dup")]
    after = target.unionByName(add)
    assert D.insert_ignore(after, batch, ["comment_id"]).count() == 0


def test_merge_keep_last_and_first(spark):
    old = spark.createDataFrame([("ch1", "A", 1), ("ch2", "B", 1)], "channel_id string, title string, v long")
    new = spark.createDataFrame([("ch1", "A2", 2, "VN")], "channel_id string, title string, v long, country string")
    last = {r.channel_id: (r.title, r.country) for r in D.merge_keep_last(old, new, ["channel_id"]).collect()}
    first = {r.channel_id: r.title for r in D.merge_keep_first(old, new, ["channel_id"]).collect()}
    assert last == {"ch1": ("A2", "VN"), "ch2": ("B", None)}
    assert first == {"ch1": "A", "ch2": "B"}
    again = D.merge_keep_last(D.merge_keep_last(old, new, ["channel_id"]), new, ["channel_id"])
    assert rows(again, "channel_id", "title") == [("ch1", "A2"), ("ch2", "B")]


def test_cap_pack_surrogate(spark):
    df = spark.createDataFrame([("v", i) for i in range(120)] + [("w", 1)], "video_id string, likes long")
    capped = D.cap_per_key(df, ["video_id"], [F.col("likes").desc()], 100)
    assert capped.where("video_id = 'v'").count() == 100 and capped.agg(F.min("likes")).first()[0] == 1
    ids = spark.createDataFrame([(i,) for i in range(1, 121)] + [(5,), (None,)], "k long")
    b = D.pack_batches(ids, "k", 50).orderBy("batch_no").collect()
    assert [r.batch_size for r in b] == [50, 50, 20] and b[2].ids.startswith("101,102")
    topics = spark.createDataFrame([(" Music ",), ("music",), ("",), (None,), ("Gaming",)], "topic string")
    assert rows(W.build_dim_topic(topics)) == [(1, "gaming"), (2, "music")]


def test_membership_and_new_only(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    trending = spark.createDataFrame([("a",), ("a",), (None,)], "video_id string")
    assert rows(D.membership_flag(df, "video_id", trending, name="t")) == [("a", 1), ("b", 0), ("c", 0)]
    assert rows(D.new_only(df, trending, ["video_id"])) == [("b",), ("c",)]


def comments(spark):
    data = [("c1", "v1", 3, "positive"), ("c2", "v1", 4, "positive"), ("c3", "v2", 1, None),
            ("c4", "v3", 2, "negative"), ("c5", "v3", 5, "neutral"), ("c6", "v3", None, "negative")]
    return spark.createDataFrame(data, "comment_id string, video_id string, like_count long, sentiment_label string")


def test_comment_metrics(spark):
    m = {r.video_id: r for r in W.comment_metrics(comments(spark)).collect()}
    assert (m["v1"].positive_count, m["v1"].negative_count, m["v1"].sentiment_score) == (2, 0, 1.0)
    assert m["v2"].sentiment_score is None and m["v2"].positive_count is None  # no labelled comment: no counts either
    assert m["v3"].avg_like_per_comment == 3.5 and m["v3"].sentiment_score == round(-2 / 3, 4)
    assert m["v3"].total_comments == 3 and m["v3"].total_likes == 7
    nolabel = W.comment_metrics(comments(spark).drop("sentiment_label")).first()
    assert nolabel.sentiment_score is None and nolabel.positive_count is None


def test_sentiment_ratios_sum_to_one(spark):
    f = W.sentiment_features(comments(spark).withColumn("sentiment_score", F.lit(0.5)))
    for r in f.collect():
        assert r.positive_ratio + r.negative_ratio + r.neutral_ratio == pytest.approx(1.0)


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0), (2.0, 5.0, None), (3.0, 5.0, 2.0)], "a double, c double, z double")
    corr = {(r.col_a, r.col_b): r.corr for r in P.corr_matrix(df, ["a", "c", "z"]).collect()}
    assert corr[("a", "a")] == pytest.approx(1.0) and corr[("a", "c")] is None and corr[("a", "z")] == pytest.approx(1.0)
    d = {r.column: r for r in P.describe_numeric(df, ["a", "z"]).collect()}
    assert d["a"].p50 == 2.0 and d["z"].n_missing == 1 and d["z"].n_zero == 1 and d["a"].std == 1.0
    one = P.describe_numeric(df.limit(1), ["a"]).first()
    assert one.std is None
    nulls = {r.column: r.null_count for r in P.null_profile(df).collect()}
    assert nulls == {"a": 0, "c": 0, "z": 1}
    dup = {r.subset: r.n_duplicates for r in P.duplicate_count(df, {"c": ["c"], "all": df.columns}).collect()}
    assert dup == {"c": 2, "all": 0}


def test_histogram_and_box(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 100]], "v double")
    h = P.histogram(df, "v", bins=10).collect()
    assert sum(r["count"] for r in h) == 10 and max(r.bin for r in h) == 10
    b = P.box_stats(df, "v").first()
    assert (b.q1, b.median, b.q3) == (2.25, 4.5, 6.75) and b.whisker_hi == 8.0 and b.n_outliers == 1


def test_crosstab_and_impact(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("b", None)], "r string, c string")
    ct = {r.r: (r.x, r.y) for r in I.crosstab(df, "r", "c", ["x", "y"]).collect()}
    assert ct == {"a": (1, 1), "b": (1, 0)}
    pct = {r.r: (r.x, r.y) for r in I.crosstab_pct(df, "r", "c", ["x", "y"]).collect()}
    assert pct["a"] == (50.0, 50.0) and pct["b"] == (100.0, 0.0)
    lab = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "h int, y int")
    imp = {r.h: (r.n_positive, r.n, r.rate) for r in I.label_impact(lab, "h", "y").collect()}
    assert imp == {1: (1, 2, 0.5), 2: (1, 1, 1.0)}
    rv = I.rate_vs_mean(I.label_impact(lab, "h", "y"), "rate")
    assert {r.h: r.above_mean for r in rv.collect()} == {1: 0, 2: 1}


def test_complete_domain(spark):
    counts = spark.createDataFrame([("Tue", 3)], "weekday string, count long")
    out = I.complete_domain(spark, counts, "weekday", ["Mon", "Tue", "Wed"]).orderBy("ordinal").collect()
    assert [(r.weekday, r["count"]) for r in out] == [("Mon", 0), ("Tue", 3), ("Wed", 0)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "y int, s double")
    auc = ML.roc_auc(df, "y", "s").first().auc
    assert auc == pytest.approx(0.875)
    rev = ML.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first().auc
    assert rev == pytest.approx(1 - auc)
    assert ML.roc_auc(df.where("y = 1"), "y", "s").first().auc is None
    rep = {r["class"]: r for r in ML.classification_report(
        df.withColumn("p", (F.col("s") > 0.5).cast("int")), "y", "p").collect()}
    assert rep["1"].recall == 1.0 and rep["1"].precision == pytest.approx(2 / 3) and rep["accuracy"].f1 == 0.75


def test_stratified_split_share(spark):
    df = spark.createDataFrame([(i, 1 if i < 341 else 0) for i in range(399)], "doc_id long, quality int")
    s = ML.stratified_split(df, "quality", "doc_id")
    c = {(r.quality, r.split): r["count"] for r in s.groupBy("quality", "split").count().collect()}
    assert c[(1, "test")] == 69 and c[(0, "test")] == 12 and c[(1, "train")] == 272


def test_encode_and_contributions(spark):
    df = spark.createDataFrame([("vi",), ("en",), ("vi",)], "lang string")
    assert sorted({(r.lang, r.lang_code) for r in ML.encode_categories(df, ["lang"]).collect()}) == \
        [("en", 0), ("vi", 1)]
    assert [r[0] for r in df.select(ML.encode_known("lang", ["en", "fr"], "en")).collect()] == [0, 0, 0]
    x = spark.createDataFrame([(1.0, 0.0)], "like_rate double, topic double")
    c = ML.contributions(x, {"like_rate": -2.0, "topic": 1.0}, {"like_rate": 0.0, "topic": 1.0}, k=1).first()
    assert c.top_contributions[0]["feature"] == "like_rate"
    r2 = ML.contributions(x, {"like_rate": -2.0, "topic": 1.0}, {"like_rate": 0.0, "topic": 1.0})
    texts = r2.select(ML.recommend("all_contributions")).first()[0]
    assert len(texts) == 2 and texts[0].startswith("Increase audience engagement")


def test_api_page_flatten_and_quarantine(spark):
    page = ('{"items": [{"id": "v1", "snippet": {"title": "t", "categoryId": "10", "tags": ["a", "b"]}, '
            '"statistics": {"viewCount": "12.0", "likeCount": "abc"}, "contentDetails": {"duration": "PT1H2M3S"}}, '
            '{"id": "v2", "contentDetails": {"duration": "P1DT1H"}}]}')
    pages = spark.createDataFrame([(page,), ('{"items": []}',)], "payload string")
    items = ING.explode_items(pages)
    st = {r.video_id: r for r in ING.flatten_video_stats(items, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert st["v1"].views == 12 and st["v1"].likes == 0 and st["v1"].duration_seconds == 3723
    assert st["v1"].tags == "a,b" and st["v2"].duration_seconds == 90000 and st["v2"].licensed_content is False
    ok, bad = ING.quarantine_split(spark.createDataFrame([("1",), ("x",), (None,)], "v string"),
                                   {"numeric": F.col("v").try_cast("int").isNotNull()})
    assert ok.count() == 1 and bad.count() == 2


def test_io_guards(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    with pytest.raises(IO.MissingColumnsError):
        IO.require_columns(df, ["x", "z"])
    with pytest.raises(IO.EmptyInputError):
        IO.require_rows(df.limit(0))
    assert IO.select_present(df, ["y", "nope", "x"]).columns == ["y", "x"]
    p = str(tmp_path / "t")
    IO.write_table(df, p)
    IO.append_table(df, p)
    got = IO.load_tables(spark, {"t": p, "missing": str(tmp_path / "none")})
    assert list(got) == ["t"] and got["t"].count() == 2


def test_approx_quantiles_close_to_exact(spark):
    df = spark.range(0, 10001).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    ex = {r.g: r.p50 for r in R.quantile_columns(df, "v", {"p50": 0.5}, ["g"]).collect()}
    ap = {r.g: r.p50 for r in R.quantile_columns(df, "v", {"p50": 0.5}, ["g"], method="approx").collect()}
    for g in ex:
        assert abs(ex[g] - ap[g]) <= 10


def test_bucketed_tables_join_without_shuffle(spark):
    import contextlib
    import io as _io
    spark.sql("DROP TABLE IF EXISTS vm_fact")
    spark.sql("DROP TABLE IF EXISTS vm_dim")
    fact = spark.range(0, 2000).select((F.col("id") % 300).alias("video_id"), F.col("id").alias("views"))
    dim = spark.range(0, 300).select(F.col("id").alias("video_id"), (F.col("id") * 2).alias("topic"))
    IO.write_bucketed(fact, "vm_fact", "video_id", 4)
    IO.write_bucketed(dim, "vm_dim", "video_id", 4)
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("vm_fact").join(spark.table("vm_dim"), "video_id", "left")
        buf = _io.StringIO()
        with contextlib.redirect_stdout(buf):
            j.explain()
        assert "SortMergeJoin" in buf.getvalue() and "Exchange" not in buf.getvalue()
        assert j.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)


def test_pipeline_save_load_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b", i % 3 == 0) for i in range(60)],
                               "x double, cat string, y boolean").withColumn("y", F.col("y").cast("int"))
    model = ML.build_pipeline(["cat"], ["x"], "y", max_iter=3, max_depth=2).fit(df)
    path = str(tmp_path / "model")
    ML.save_model(model, path)
    again = ML.load_model(path)
    a = [r.score for r in ML.score(model, df).orderBy("x").collect()]
    b = [r.score for r in ML.score(again, df).orderBy("x").collect()]
    assert a == b


def test_flatten_channels_comments_and_flags(spark):
    from vidmart import schemas as S
    from vidmart.plans.features import feature_flags
    ch = ('{"items": [{"id": "c1", "snippet": {"title": "T", "country": "VN"}, '
          '"statistics": {"subscriberCount": "12", "viewCount": "x"}}]}')
    got = ING.flatten_channels(ING.explode_items(spark.createDataFrame([(ch,)], "payload string"),
                                                 schema=S.API_CHANNEL_PAGE)).first()
    assert (got.subscriber_count, got.view_count, got.video_count, got.hidden_subscriber_count) == (12, 0, 0, False)
    cm = ('{"items": [{"snippet": {"videoId": "v1", "topLevelComment": {"id": "k1", "snippet": '
          '{"textDisplay": "hi", "publishedAt": "2024-01-02T03:04:05Z"}}}}]}')
    c = ING.flatten_comments(ING.explode_items(spark.createDataFrame([(cm,)], "payload string"),
                                               schema=S.API_COMMENT_PAGE)).first()
    assert (c.comment_id, c.video_id, c.like_count, c.published_at.hour) == ("k1", "v1", 0, 3)
    df = spark.createDataFrame([(9, 5, 10, "HD"), (8, 1, 24, None)], "h int, w int, c int, d string")
    f = df.select(*[v.alias(k) for k, v in feature_flags(F.col("h"), F.col("w"), F.col("c"),
                                                          definition=F.col("d")).items()]).collect()
    assert [tuple(r) for r in f] == [(1, 1, 1, 1), (0, 0, 0, 0)]


def test_box_stats_without_aqe(spark):
    # the checkpointed rank frame is joined back to its own lineage: must
    # resolve without AQE's re-planning too
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 1.0)], "g string, v double")
        got = {r.g: (r.median, r.n) for r in P.box_stats(df, "v", by=["g"]).collect()}
        assert got == {"a": (4.5, 10), "b": (1.0, 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_select_method_matches_sort_on_driver_data(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn(
        "t", (F.col("l_returnflag") == "R").cast("int"))
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    a = rows(P.describe_numeric(li, cols, by=["t"], method="select"))
    b = rows(P.describe_numeric(li, cols, by=["t"], method="sort"))
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a] == \
        [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b]


def test_scale_conf_sizes_partitions():
    from vidmart.session import scale_conf
    c = scale_conf(100 * (1 << 40), cores=8000)            # 100 TB on 8000 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_land_csv_multiline_and_quotes(spark, tmp_path):
    from vidmart import schemas as S
    src = tmp_path / "raw_video.csv"
    src.write_text(
        "video_id,title,description,channel_id,channel_title,publish_time,thumbnail,keyword,topic,source,discover_time\n"
        'v1,Song,"line one\nline ""two""",c1,Chan,2024-01-01T00:00:00Z,u,k,music,search,2024-01-02 00:00:00\n'
        "v2,Game,,c2,Chan2,bad,u,k,,trending,2024-01-02 00:00:00\n", encoding="utf-8")
    dst = str(tmp_path / "landed")
    IO.land_csv(spark, str(src), dst, S.RAW_VIDEO)
    got = {r.video_id: r for r in IO.read_table(spark, dst).collect()}
    assert got["v1"].description == 'line one\nline "two"' and got["v2"].topic is None
    assert IO.read_table(spark, dst, cols=["video_id"], where=F.col("source") == "search").count() == 1


def test_join_helpers_and_small_scalars(spark):
    from vidmart.functions import numeric as NU
    from vidmart.functions import text as TX
    from vidmart.operators import joins as J
    df = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, code int")
    dim = spark.createDataFrame([(10, "ten")], "k int, name string")
    got = rows(J.lookup_join(df, "code", dim, "k", {"name": "label"}, default="Unknown").select("id", "label"))
    assert got == [(1, "ten"), (2, "Unknown"), (3, "Unknown")]
    other = spark.createDataFrame([(1, 5.0), (2, None)], "id int, score double")
    assert rows(J.inner_complete(df, other, "id", ["score"]).select("id")) == [(1,)]
    x = spark.createDataFrame([(1234567.0, -5.0)], "a double, b double")
    r = x.select(TX.thousands("a"), NU.clamp("b", 1, 99), *NU.log1p_cols(["a"]).values()).first()
    assert r[0] == "1,234,567" and r[1] == 1.0 and r[2] > 14
