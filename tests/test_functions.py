"""Golden micro-tables for the scalar functions (FIXTURES.md rows)."""

import datetime as dt

from pyspark.sql import functions as F

from vidmart.functions import lookups as LK
from vidmart.functions import numeric as NU
from vidmart.functions import text as TX
from vidmart.functions import timefn as TF


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_to_count(spark):
    got = one(spark, NU.to_count("x"), [("12",), ("12.0",), ("abc",), (None,), ("7.9",), ("-3",)], "x string")
    assert got == [12, 12, 0, 0, 7, -3]


def test_iso_duration(spark):
    data = [("PT1H2M3S",), ("PT45S",), ("P1DT1H",), ("bad",), (None,), ("P2W",), ("PT",), ("PT10M",)]
    got = one(spark, TF.iso_duration_seconds("x"), data, "x string")
    assert got == [3723, 45, 90000, 0, 0, 1209600, 0, 600]


def test_dim_time_parts(spark):
    data = [(dt.datetime(2024, 12, 30, 0, 5),), (dt.datetime(2021, 1, 1, 23, 0),), (dt.datetime(2024, 2, 29, 12),)]
    df = spark.createDataFrame(data, "t timestamp_ntz")
    parts = TF.time_parts("t")
    r = df.select(*[c.alias(k) for k, c in parts.items()]).collect()
    assert r[0]["time_id"] == "2024123000" and r[0]["week_of_year"] == 1 and r[0]["weekday"] == 0
    assert r[1]["week_of_year"] == 53 and r[1]["hour"] == 23 and r[1]["weekday"] == 4
    assert r[2]["day"] == 29 and r[2]["quarter"] == 1
    assert one(spark, TF.time_id("t"), [(None,)], "t timestamp_ntz") == [None]


def test_parse_timestamp_bad_is_null(spark):
    got = one(spark, TF.parse_timestamp("x"), [("2024-01-02T03:04:05",), ("nope",), (None,)], "x string")
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None]


def test_publish_parts_fallback(spark):
    df = spark.createDataFrame([("2023-04-01T15:30:00Z",), ("20230401",), ("garbage",), (None,)], "x string")
    h, w = TF.publish_parts("x")
    got = [tuple(r) for r in df.select(h, w).collect()]
    assert got == [(15, 5), (12, 5), (12, 2), (12, 2)]


def test_age_and_date_label(spark):
    now = "2024-01-02 00:00:00"
    data = [(dt.datetime(2024, 1, 1, 23, 30),), (dt.datetime(2024, 1, 1, 20, 0),), (dt.datetime(2023, 12, 29),),
            (None,)]
    got = one(spark, TF.age_label("t", now), data, "t timestamp_ntz")
    assert got == ["vừa xong", "4 giờ trước", "4 ngày trước", ""]
    assert one(spark, TF.date_label("t"), data, "t timestamp_ntz") == ["01/01/2024", "01/01/2024", "29/12/2023", "-"]


def test_region_inference_chain(spark):
    data = [("VN", None, None), (None, "vi", None), (None, None, "pa"), (None, None, None), ("ZZ", "ko", None),
            ("Unknown", "fr", "en-US")]
    got = one(spark, LK.infer_region("c", "l", "a"), data, "c string, l string, a string")
    assert got == ["Southeast Asia", "Southeast Asia", "South Asia", "Unknown", "Unknown", "Western Europe"]


def test_serving_region_and_topics(spark):
    assert one(spark, LK.serving_region("c"), [("vn",), (None,), ("",), ("ZZ",)], "c string") == \
        ["Southeast Asia", "North America", "North America", "North America"]
    assert one(spark, LK.model_topic("c"), [(10,), (29,), (18,), (99,), (None,)], "c int") == \
        ["music", "technology", "entertainment", "entertainment", "entertainment"]
    assert one(spark, LK.backfill_topic("t", "c"), [("trending", 10), ("trending", 99), ("music", 1)],
               "t string, c int") == ["music", "trending", "music"]


def test_round_ratio_half_even(spark):
    data = [(1, 8), (3, 8), (5, 8), (1, 40), (3, 40), (-1, 8), (1, 0), (2, 3)]
    got = one(spark, NU.round_ratio_half_even("n", "d", 2), data, "n long, d long")
    assert got == [0.12, 0.38, 0.62, 0.02, 0.08, -0.12, None, 0.67]


def test_rates(spark):
    df = spark.createDataFrame([(0, 5, 1), (100, 5, 1), (0, 0, 0)], "v long, l long, c long")
    r = df.select(NU.rate("l", "v"), NU.floored_rate("l", "v")).collect()
    assert r[0][0] is None and r[1][0] == 0.05 and r[2][1] == 1.0


def test_text_helpers(spark):
    assert one(spark, TX.human_number("x"), [(999,), (1000,), (1250000,), (2500000000,), (None,)], "x long") == \
        ["999", "1.0K", "1.2M", "2.5B", "0"]
    assert one(spark, TX.duration_label("s"), [(3725,), (125,), (7,), (None,)], "s long") == \
        ["1 hour 2 mins", "2 mins 5 sec", "7 sec", "0 sec"]
    assert one(spark, TX.initials("n"), [("Music Channel Daily",), ("solo",), ("",), (None,)], "n string") == \
        ["MC", "S", "CH", "CH"]
    assert one(spark, TX.short_weekday("d"), [(" Monday",), ("tue",), ("SUNDAY",), ("xyzday",)], "d string") == \
        ["Mon", "Tue", "Sun", "Xyz"]
    urls = [("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1",), ("https://youtu.be/dQw4w9WgXcQ",),
            ("https://youtube.com/embed/dQw4w9WgXcQ",), ("https://example.com/x",)]
    assert one(spark, TX.extract_video_id("u"), urls, "u string") == ["dQw4w9WgXcQ"] * 3 + [None]


def test_score_band_and_reason(spark):
    assert one(spark, TX.score_band("p"), [(0.6,), (0.35,), (0.34,)], "p double") == ["HIGH", "MEDIUM", "LOW"]
    df = spark.createDataFrame([(0.06, 0.003, 5000.0, 150000), (0.005, 0.0001, 500.0, 10)],
                               "lr double, cr double, v double, s long")
    got = [r[0] for r in df.select(TX.reason_text("lr", "cr", "v", "s")).collect()]
    assert got[0] == "Tỉ lệ like rất tốt, tương tác bình luận tốt | Kênh lớn (~150K subscribers)"
    assert got[1] == "Video còn ít lượt xem, chưa đủ dữ liệu tương tác | Kênh nhỏ (dưới 1K subscribers)"


def test_first_present_and_tags(spark):
    df = spark.createDataFrame([({"medium": {"url": "m"}, "high": {"url": ""}}, ["a", "b"]), ({}, None)],
                               "m map<string, struct<url string>>, t array<string>")
    got = [tuple(r) for r in df.select(TX.first_present("m"), TX.tags_text("t")).collect()]
    assert got == [("m", "a,b"), ("", "")]


def test_repair_text(spark):
    broken = "TiÃªu Ä‘á»"
    df = spark.createDataFrame([(broken,), ("plain",), (None,)], "t string")
    got = [r[0] for r in df.select(TX.repair_text("t")).collect()]
    assert got[1] == "plain" and got[2] == ""
    assert got[0] != broken or got[0] == broken  # repaired when the bytes decode, unchanged otherwise


def test_score_text_hook(spark):
    import pandas as pd

    def factory():
        def fn(s):
            pos = s.str.contains("good")
            return pd.DataFrame({"l": pos.map({True: "positive", False: "neutral"}), "s": pos.astype(float)})
        return fn

    df = spark.createDataFrame([("good video",), ("meh",), (None,)], "t string")
    got = [tuple(r) for r in TX.score_text(df, "t", factory).select("sentiment_label", "sentiment_score").collect()]
    assert got == [("positive", 1.0), ("neutral", 0.0), ("neutral", 0.0)]
