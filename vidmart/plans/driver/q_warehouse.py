"""Driver queries: warehouse build, lookups, cleaning and features
(J1-J5, J8, J9, A1-A6, C1-C4, C7, F1, F2, F7, F8, D2-D6, D11, M1-M3, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import lookups as LK
from ...functions.timefn import hours_between, weekday0
from ...operators.dedup import first_snapshot, membership_flag
from ...operators.joins import inner_complete, lookup_join
from ...operators.ranking import quantile_columns
from ..features import clean_snapshots, engagement_rates, feature_flags, ml_dataset, valid_engagement
from ..warehouse import (build_dim_time, build_dim_topic, build_dim_video, build_fact_video_metrics,
                         comment_metrics, flat_dataset, sentiment_features)
from .registry import LINEITEM_REST, half_even_sql, order_sql, query, r6, sql_case, table, trend

# --------------------------------------------------------------------------- role frames


def videos(spark, sf):
    """orders in the raw_video role."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("channel_id"),
        F.col("o_orderdate").alias("publish_time"), F.col("o_orderpriority").alias("topic"),
        F.col("o_orderstatus").alias("source"))


def stats(spark, sf):
    """lineitem in the raw_video_stats role."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_shipdate").alias("snapshot_time"),
        F.col("l_quantity").cast("bigint").alias("duration_seconds"), F.col("l_linestatus").alias("definition"),
        F.col("l_linenumber").alias("category_id"))


def snapshot_facts(spark, sf):
    """lineitem in the snapshot-measure role (views, likes, comments, label)."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_extendedprice").alias("views"),
        F.col("l_quantity").alias("likes"), (F.col("l_tax") + F.lit(0.0)).alias("comments"),
        F.col("l_shipdate").alias("snapshot_time"), trend().alias("is_trending"))


def channels(spark, sf):
    """customer ⋈ nation ⋈ region in the dim_channel role."""
    c = table(spark, sf, "customer")
    c = lookup_join(c, "c_nationkey", table(spark, sf, "nation"), "n_nationkey",
                    {"n_name": "country", "n_regionkey": "regionkey"})
    c = lookup_join(c, "regionkey", table(spark, sf, "region"), "r_regionkey", {"r_name": "region"})
    return c.select(F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("channel_title"),
                    "country", "region", F.col("c_acctbal").alias("subscriber_count"))


def comments(spark, sf):
    """events in the comment role with the sentiment class map of SURVEY §2.0."""
    label = (F.when(F.col("event_type").isin("purchase", "signup"), "positive")
             .when(F.col("event_type") == "error", "negative")
             .when(F.col("event_type").isin("click", "view"), "neutral"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("comment_id"), F.col("user_id").alias("video_id"),
        F.floor("value").cast("bigint").alias("like_count"), label.alias("sentiment_label"),
        (F.col("value") / 100.0).alias("sentiment_score"), F.col("ts").alias("published_at"))


def partly_labelled(comments):
    """All comments of some videos have no label."""
    return comments.withColumn("sentiment_label", F.when(F.col("video_id") % 11 == 0, None).otherwise(F.col("sentiment_label")))


def _comments_sql(unlabelled=""):
    return f"""SELECT event_id AS comment_id, user_id AS video_id, CAST(floor(value) AS BIGINT) AS like_count,
  CASE {unlabelled}WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative'
       WHEN event_type IN ('click', 'view') THEN 'neutral' END AS sentiment_label,
  value / 100.0 AS sentiment_score FROM events"""


COMMENTS_SQL = _comments_sql()
PARTLY_LABELLED_SQL = _comments_sql("WHEN user_id % 11 = 0 THEN NULL ")

TIME_COLS_SQL = """CAST(year(t) AS INTEGER) AS year, CAST(quarter(t) AS INTEGER) AS quarter,
  CAST(month(t) AS INTEGER) AS month, CAST(week(t) AS INTEGER) AS week_of_year, CAST(day(t) AS INTEGER) AS day,
  CAST(isodow(t) - 1 AS INTEGER) AS weekday, CAST(hour(t) AS INTEGER) AS hour"""

# --------------------------------------------------------------------------- dimensions


@query("dim_topic", """
SELECT CAST(row_number() OVER (ORDER BY t) AS INTEGER) AS topic_id, t AS topic_name
FROM (SELECT DISTINCT nullif(lower(trim(o_orderpriority)), '') AS t FROM orders) WHERE t IS NOT NULL
""")
def dim_topic(spark, sf):
    return build_dim_topic(table(spark, sf, "orders"), "o_orderpriority")


@query("dim_time", f"""
SELECT DISTINCT strftime(t, '%Y%m%d%H') AS time_id, CAST(CAST(t AS DATE) AS VARCHAR) AS date, {TIME_COLS_SQL}
FROM (SELECT date_trunc('hour', ts) AS t FROM events WHERE ts IS NOT NULL)
""")
def dim_time(spark, sf):
    return build_dim_time(table(spark, sf, "events"), "ts").withColumn("date", F.col("date").cast("string"))


@query("time_features", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS publish_hour, dayname(ts) AS publish_weekday,
       CAST(isodow(ts) - 1 AS INTEGER) AS publish_weekday_num,
       CAST(CASE WHEN isodow(ts) - 1 IN (4, 5, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
FROM events
""")
def time_features_q(spark, sf):
    from ..features import time_features
    ev = time_features(table(spark, sf, "events"), "ts")
    flags = feature_flags(F.col("publish_hour"), F.col("publish_weekday_num"), F.col("event_type"))
    return ev.select("event_id", "publish_hour", "publish_weekday", "publish_weekday_num",
                     flags["is_weekend"].alias("is_weekend"))


DIM_VIDEO_SQL = """
WITH s AS (SELECT l_orderkey AS video_id, l_shipdate AS snapshot_time, CAST(l_quantity AS BIGINT) AS duration_seconds,
                  l_linestatus AS definition, l_linenumber AS category_id FROM lineitem),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY snapshot_time DESC NULLS LAST,
           duration_seconds DESC NULLS LAST, definition DESC NULLS LAST, category_id DESC NULLS LAST) AS rn FROM s)
         WHERE rn = 1)
SELECT o.o_orderkey AS video_id, o.o_custkey AS channel_id, o.o_orderdate AS publish_time,
       o.o_orderpriority AS topic, o.o_orderstatus AS source, strftime(o.o_orderdate, '%Y%m%d%H') AS time_id,
       last.duration_seconds, last.definition, last.category_id
FROM orders o LEFT JOIN last ON o.o_orderkey = last.video_id
"""
# videos without snapshots leave NULL integers; compared as DOUBLE so both engines type them alike
DIM_VIDEO_OUT_SQL = f"""
SELECT video_id, channel_id, publish_time, topic, source, time_id, CAST(duration_seconds AS DOUBLE) AS duration_seconds,
       definition, CAST(category_id AS DOUBLE) AS category_id FROM ({DIM_VIDEO_SQL})
"""


def dim_video_frame(spark, sf):
    return build_dim_video(videos(spark, sf), stats(spark, sf),
                           stats_cols=("duration_seconds", "definition", "category_id"))


@query("dim_video", DIM_VIDEO_OUT_SQL)
def dim_video(spark, sf):
    return dim_video_frame(spark, sf).withColumns(
        {"duration_seconds": F.col("duration_seconds").cast("double"), "category_id": F.col("category_id").cast("double")})


FACT_SQL = """
SELECT f.*, o.o_custkey AS channel_id, strftime(o.o_orderdate, '%Y%m%d%H') AS time_id, o.o_orderstatus AS source
FROM (SELECT DISTINCT l_orderkey AS video_id, l_extendedprice AS views, l_quantity AS likes, l_tax + 0.0 AS comments,
             l_shipdate AS snapshot_time, CAST(l_returnflag = 'R' AS INTEGER) AS is_trending FROM lineitem) f
LEFT JOIN orders o ON f.video_id = o.o_orderkey
"""


def fact_frame(spark, sf):
    v = videos(spark, sf).withColumn("time_id", F.date_format("publish_time", "yyyyMMddHH"))
    return build_fact_video_metrics(snapshot_facts(spark, sf), v)


@query("fact_video_metrics", FACT_SQL)
def fact_video_metrics(spark, sf):
    return fact_frame(spark, sf)


_FLAT_COLS = ["video_id", "snapshot_time", "views", "likes", "comments", "is_trending", "channel_id", "time_id",
              "source", "publish_time", "topic", "duration_seconds", "definition", "category_id",
              "channel_title", "country", "region", "subscriber_count", "date", "year", "quarter", "month",
              "week_of_year", "day", "weekday", "hour"]
TOPIC_MARKER = "4-NOT SPECIFIED"


def _flat_sql():
    backfill = (f"CASE WHEN v.topic = '{TOPIC_MARKER}' THEN coalesce("
                f"{sql_case('v.category_id', LK.CATEGORY_TOPIC_ANALYSIS)}, v.topic) ELSE v.topic END")
    return f"""
WITH f AS ({FACT_SQL}),
v AS ({DIM_VIDEO_SQL}),
ch AS (SELECT c_custkey AS channel_id, c_name AS channel_title, n_name AS country, r_name AS region,
              c_acctbal AS subscriber_count
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
tm AS (SELECT DISTINCT strftime(t, '%Y%m%d%H') AS time_id, CAST(CAST(t AS DATE) AS VARCHAR) AS date, {TIME_COLS_SQL}
       FROM (SELECT date_trunc('hour', o_orderdate) AS t FROM orders WHERE o_orderdate IS NOT NULL))
SELECT f.video_id, f.snapshot_time, f.views, f.likes, f.comments, f.is_trending, f.channel_id, f.time_id, f.source,
       v.publish_time, {backfill} AS topic, v.duration_seconds, v.definition, v.category_id,
       ch.channel_title, ch.country, ch.region, ch.subscriber_count,
       tm.date, tm.year, tm.quarter, tm.month, tm.week_of_year, tm.day, tm.weekday, tm.hour
FROM f LEFT JOIN v ON f.video_id = v.video_id
       LEFT JOIN ch ON f.channel_id = ch.channel_id
       LEFT JOIN tm ON f.time_id = tm.time_id
"""


@query("flat_dataset", _flat_sql())
def flat_dataset_q(spark, sf):
    tm = build_dim_time(table(spark, sf, "orders"), "o_orderdate").withColumn("date", F.col("date").cast("string"))
    out = flat_dataset(fact_frame(spark, sf), dim_video_frame(spark, sf), channels(spark, sf), tm,
                       trending_marker=TOPIC_MARKER)
    return out.select(*_FLAT_COLS)


# --------------------------------------------------------------------------- lookups


@query("is_trending_flag", """
WITH t AS (SELECT quantile_cont(o_totalprice, 0.9) AS thr FROM orders),
m AS (SELECT DISTINCT o_custkey FROM orders, t WHERE o_totalprice >= t.thr)
SELECT o.o_orderkey, o.o_custkey, CAST(CASE WHEN m.o_custkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_trending
FROM orders o LEFT JOIN m ON o.o_custkey = m.o_custkey
""")
def is_trending_flag(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    thr = quantile_columns(o, "o_totalprice", {"p90": 0.9}).select("p90").scalar()
    members = o.where(F.col("o_totalprice") >= thr)
    return membership_flag(o.drop("o_totalprice"), "o_custkey", members, name="is_trending")


@query("region_lookup", """
SELECT c_custkey, coalesce(n_name, 'Unknown') AS country, coalesce(r_name, 'Unknown') AS region
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def region_lookup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    c = lookup_join(c, "c_nationkey", table(spark, sf, "nation"), "n_nationkey",
                    {"n_name": "country", "n_regionkey": "_rk"})
    c = lookup_join(c, "_rk", table(spark, sf, "region"), "r_regionkey", {"r_name": "region"}, default="Unknown")
    return c.select("c_custkey", F.coalesce("country", F.lit("Unknown")).alias("country"), "region")


def _region_inputs_sql():
    return """SELECT doc_id, lang, source,
  CASE lang WHEN 'en' THEN NULL WHEN 'es' THEN 'XX' ELSE upper(lang) END AS country,
  CASE WHEN sn < 5 THEN 'vi' WHEN sn < 10 THEN 'hi' WHEN sn < 15 THEN NULL ELSE 'zz' END AS default_language,
  CASE WHEN sn < 13 THEN 'pa' ELSE NULL END AS default_audio_language
FROM (SELECT *, TRY_CAST(substr(source, 4) AS INTEGER) AS sn FROM documents)"""


def _infer_sql():
    lang = sql_case("default_language", LK.LANG_TO_REGION)
    audio = sql_case("default_audio_language", LK.AUDIO_TO_REGION)
    country = sql_case("coalesce(country, 'Unknown')", LK.COUNTRY_TO_REGION_ANALYSIS)
    return f"""SELECT doc_id, lang, source, country, default_language, default_audio_language,
  coalesce(CASE WHEN coalesce(country, 'Unknown') = 'Unknown' THEN coalesce({lang}, {audio}) ELSE {country} END,
           'Unknown') AS country_region
FROM ({_region_inputs_sql()})"""


def region_frame(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    sn = F.substring("source", 4, 10).try_cast("int")
    d = d.select("doc_id", "lang", "source",
                 F.when(F.col("lang") == "en", F.lit(None)).when(F.col("lang") == "es", F.lit("XX"))
                 .otherwise(F.upper("lang")).alias("country"),
                 F.when(sn < 5, "vi").when(sn < 10, "hi").when(sn < 15, F.lit(None)).otherwise("zz")
                 .alias("default_language"),
                 F.when(sn < 13, "pa").alias("default_audio_language"))
    return d.withColumn("country_region", LK.infer_region("country", "default_language", "default_audio_language"))


@query("infer_region", f"SELECT doc_id, country, default_language, default_audio_language, country_region "
                       f"FROM ({_infer_sql()})")
def infer_region_q(spark, sf):
    return region_frame(spark, sf).drop("lang", "source")


@query("region_unknown", f"SELECT doc_id, lang, source FROM ({_infer_sql()}) WHERE country_region = 'Unknown'")
def region_unknown(spark, sf):
    return region_frame(spark, sf).where(F.col("country_region") == LK.UNKNOWN).select("doc_id", "lang", "source")


@query("model_topic", f"""
SELECT p_partkey, CAST(p_size AS INTEGER) AS category_id, name AS category_name,
       coalesce({sql_case('name', LK.CATEGORY_TO_MODEL_TOPIC)}, 'entertainment') AS model_topic
FROM (SELECT p_partkey, p_size, coalesce({sql_case('p_size', LK.CATEGORY_NAME_SERVING)}, 'entertainment') AS name
      FROM part)
""")
def model_topic_q(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.col("p_size").cast("int").alias("category_id"),
                    LK.category_name("p_size").alias("category_name"), LK.model_topic("p_size").alias("model_topic"))


# --------------------------------------------------------------------------- cleaning and features


@query("clean_snapshots", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
       coalesce(nullif(l_returnflag, 'N'), 'Unknown') AS l_returnflag,
       coalesce(nullif(l_linestatus, 'O'), 'Unknown') AS l_linestatus, l_shipdate
FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_extendedprice > 0 AND l_quantity * 100 <= l_extendedprice
""")
def clean_snapshots_q(spark, sf):
    li = (table(spark, sf, "lineitem")
          .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
                  F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"), "l_shipdate"))
    return clean_snapshots(li, required=["l_orderkey", "l_shipdate"], fill_text=["l_returnflag", "l_linestatus"],
                           valid=valid_engagement(F.col("l_extendedprice"), F.col("l_quantity") * 100),
                           casts={"l_linenumber": "int"})


@query("engagement_rates", """
SELECT l_orderkey, l_linenumber, l_quantity / l_extendedprice AS like_rate, l_tax / l_extendedprice AS comment_rate,
       greatest(l_quantity, 1) / greatest(l_extendedprice, 1) AS like_rate_floored
FROM lineitem
""")
def engagement_rates_q(spark, sf):
    from ...functions.numeric import floored_rate
    li = table(spark, sf, "lineitem")
    r = engagement_rates(li, "l_extendedprice", "l_quantity", "l_tax")
    return r.select("l_orderkey", "l_linenumber", "like_rate", "comment_rate",
                    floored_rate("l_quantity", "l_extendedprice").alias("like_rate_floored"))


@query("log_features", """
SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS log_quantity,
       round(ln(1 + l_extendedprice), 6) AS log_price, round(ln(1 + l_tax), 6) AS log_tax,
       round(ln(1 + l_discount), 6) AS log_discount, round(exp(ln(1 + l_quantity)) - 1, 6) AS quantity_back
FROM lineitem
""")
def log_features(spark, sf):
    li = table(spark, sf, "lineitem")
    lq = F.log1p("l_quantity")
    return li.select("l_orderkey", "l_linenumber", r6(lq).alias("log_quantity"),
                     r6(F.log1p("l_extendedprice")).alias("log_price"), r6(F.log1p("l_tax")).alias("log_tax"),
                     r6(F.log1p("l_discount")).alias("log_discount"), r6(F.expm1(lq)).alias("quantity_back"))


@query("feature_flags", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
       CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS is_music,
       CAST(hour(ts) IN (9, 10, 21, 22, 23) AS INTEGER) AS is_peak_hour,
       CAST(isodow(ts) - 1 IN (4, 5, 6) AS INTEGER) AS is_weekend
FROM events
""")
def feature_flags_q(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type")
    hour, wd = F.hour("ts").cast("int"), weekday0("ts")
    flags = feature_flags(hour, wd, F.col("event_type"), music=("purchase", "signup"))
    return ev.select("event_id", hour.alias("hour"), wd.alias("weekday"), *[c.alias(k) for k, c in flags.items()])


_ML_ORDER = "snapshot_time, views, likes, comments, definition NULLS FIRST, is_trending, like_rate, comment_rate"
_ML_FEATS = ["views", "like_rate", "comment_rate", "definition", "is_trending"]


def _ml_sql():
    firsts = ",\n  ".join(f"first({c} ORDER BY {_ML_ORDER}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _ML_FEATS)
    return f"""
WITH s AS (SELECT l_orderkey AS video_id, l_shipdate AS snapshot_time, l_extendedprice AS views, l_quantity AS likes,
                  l_tax + 0.0 AS comments, nullif(l_linestatus, 'O') AS definition,
                  CAST(l_returnflag = 'R' AS INTEGER) AS is_trending,
                  l_quantity / l_extendedprice AS like_rate, (l_tax + 0.0) / l_extendedprice AS comment_rate
           FROM lineitem),
fv AS (SELECT video_id,
  {firsts}
  FROM s GROUP BY video_id)
SELECT fv.*, o.o_custkey AS channel_id, o.o_orderpriority AS topic,
       CAST(hour(o.o_orderdate) AS INTEGER) AS publish_hour, CAST(isodow(o.o_orderdate) - 1 AS INTEGER) AS publish_weekday_num,
       c.c_acctbal AS subscriber_count, coalesce(r.r_name, 'Unknown') AS country_region
FROM fv LEFT JOIN orders o ON fv.video_id = o.o_orderkey
        LEFT JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""


@query("ml_dataset", _ml_sql())
def ml_dataset_q(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.select(F.col("l_orderkey").alias("video_id"), F.col("l_shipdate").alias("snapshot_time"),
                  F.col("l_extendedprice").alias("views"), F.col("l_quantity").alias("likes"),
                  (F.col("l_tax") + F.lit(0.0)).alias("comments"),
                  F.nullif("l_linestatus", F.lit("O")).alias("definition"), trend().alias("is_trending"))
    s = engagement_rates(s, "views", "likes", "comments")
    fv = ml_dataset(s, "video_id", ["snapshot_time"], _ML_FEATS)
    v = videos(spark, sf).select("video_id", "channel_id", "topic",
                                 F.hour("publish_time").cast("int").alias("publish_hour"),
                                 weekday0("publish_time").alias("publish_weekday_num"))
    ch = channels(spark, sf).select("channel_id", "subscriber_count",
                                    F.coalesce("region", F.lit("Unknown")).alias("country_region"))
    return fv.join(v, "video_id", "left").join(ch, "channel_id", "left")


# --------------------------------------------------------------------------- comments


@query("comment_metrics", f"""
WITH c AS ({PARTLY_LABELLED_SQL}),
g AS (SELECT video_id, count(comment_id) AS total_comments, CAST(coalesce(sum(like_count), 0) AS BIGINT) AS total_likes,
             CAST(sum(like_count) AS BIGINT) AS s, count(like_count) AS n, max(like_count) AS max_like_comment,
             CASE WHEN count(sentiment_label) > 0 THEN count(*) FILTER (WHERE sentiment_label = 'positive') END AS positive_count,
             CASE WHEN count(sentiment_label) > 0 THEN count(*) FILTER (WHERE sentiment_label = 'negative') END AS negative_count,
             CASE WHEN count(sentiment_label) > 0 THEN count(*) FILTER (WHERE sentiment_label = 'neutral') END AS neutral_count
      FROM c WHERE video_id IS NOT NULL GROUP BY video_id)
SELECT video_id, total_comments, total_likes, {half_even_sql('s', 'n', 2)} AS avg_like_per_comment, max_like_comment,
       positive_count, negative_count, neutral_count,
       {half_even_sql('positive_count - negative_count', 'positive_count + negative_count + neutral_count', 4)}
         AS sentiment_score
FROM g
""")
def comment_metrics_q(spark, sf):
    return comment_metrics(partly_labelled(comments(spark, sf)))


SENT_FEATURES_SQL = f"""
SELECT video_id, count(*) AS total,
       count(*) FILTER (WHERE sentiment_label = 'positive') / count(*) AS positive_ratio,
       count(*) FILTER (WHERE sentiment_label = 'negative') / count(*) AS negative_ratio,
       count(*) FILTER (WHERE sentiment_label = 'neutral') / count(*) AS neutral_ratio,
       round(avg(sentiment_score), 6) AS mean_score
FROM ({COMMENTS_SQL}) WHERE sentiment_label IS NOT NULL AND video_id IS NOT NULL GROUP BY video_id
"""


@query("sentiment_features", SENT_FEATURES_SQL)
def sentiment_features_q(spark, sf):
    return sentiment_features(comments(spark, sf)).withColumn("mean_score", r6("mean_score"))


@query("sentiment_by_trending", f"""
SELECT CAST(c.c_acctbal > 5000 AS INTEGER) AS is_trending, count(*) AS n_videos,
       round(avg(positive_ratio), 6) AS positive_ratio, round(avg(negative_ratio), 6) AS negative_ratio,
       round(avg(neutral_ratio), 6) AS neutral_ratio, round(avg(mean_score), 6) AS mean_score
FROM ({SENT_FEATURES_SQL}) f JOIN customer c ON f.video_id = c.c_custkey
WHERE positive_ratio IS NOT NULL AND c.c_acctbal IS NOT NULL
GROUP BY 1
""")
def sentiment_by_trending(spark, sf):
    feats = sentiment_features(comments(spark, sf)).withColumn("mean_score", r6("mean_score"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), "c_acctbal")
    j = inner_complete(feats, cust, "video_id", ["positive_ratio", "c_acctbal"])
    return j.groupBy((F.col("c_acctbal") > 5000).cast("int").alias("is_trending")).agg(
        F.count(F.lit(1)).alias("n_videos"),
        *[r6(F.avg(c)).alias(c) for c in ("positive_ratio", "negative_ratio", "neutral_ratio", "mean_score")])


@query("time_to_event", f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY {order_sql(["l_shipdate", *LINEITEM_REST])}) AS rn FROM lineitem) WHERE rn = 1)
SELECT o.o_orderkey AS video_id,
       CASE WHEN f.l_returnflag = 'R' THEN (epoch_us(f.l_shipdate) - epoch_us(o.o_orderdate)) / 3.6e9 END
         AS hours_to_trending
FROM orders o JOIN f ON o.o_orderkey = f.l_orderkey
""")
def time_to_event(spark, sf):
    snaps = first_snapshot(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = o.join(snaps, o.o_orderkey == snaps.l_orderkey)
    h = F.when(F.col("l_returnflag") == "R", hours_between("l_shipdate", "o_orderdate"))
    return j.select(F.col("o_orderkey").alias("video_id"), h.alias("hours_to_trending"))


# --------------------------------------------------------------------------- typed fact and keep-last dimension


@query("fact_comment", """
SELECT comment_id, video_id, CAST(coalesce(CAST(trunc(TRY_CAST(like_count AS DOUBLE)) AS BIGINT), 0) AS INTEGER)
         AS like_count, published_at
FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY published_at ASC NULLS LAST, video_id ASC NULLS LAST,
             like_count ASC NULLS LAST) AS rn
      FROM (SELECT CAST(event_id AS VARCHAR) AS comment_id, CAST(user_id AS VARCHAR) AS video_id,
                   CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS like_count,
                   ts AS published_at FROM events)
      WHERE comment_id IS NOT NULL AND video_id IS NOT NULL)
WHERE rn = 1
""")
def fact_comment(spark, sf):
    from ..warehouse import build_fact_comment
    ev = table(spark, sf, "events")
    raw = ev.select(F.col("event_id").cast("string").alias("comment_id"), F.col("user_id").cast("string").alias("video_id"),
                    F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
                    .alias("like_count"), F.col("ts").alias("published_at"))
    return build_fact_comment(raw, ["published_at"]).drop("loaded_at")


@query("dim_channel", """
WITH v AS (SELECT o.o_custkey AS channel_id, c.c_name AS channel_title, n.n_name AS country,
                  CAST(o.o_totalprice AS VARCHAR) AS subscriber_count, o.o_orderdate, o.o_orderkey
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY o_orderdate DESC NULLS LAST,
           o_orderkey DESC NULLS LAST, channel_title DESC NULLS LAST, country DESC NULLS LAST,
           subscriber_count DESC NULLS LAST) AS rn FROM v) WHERE rn = 1)
SELECT channel_id, channel_title, country,
       coalesce(CAST(trunc(TRY_CAST(subscriber_count AS DOUBLE)) AS BIGINT), 0) AS subscriber_count
FROM last
""")
def dim_channel(spark, sf):
    """Every order is a channel snapshot (title, country, subscriber text);
    the latest snapshot per channel wins."""
    from ..warehouse import build_dim_channel
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    c = lookup_join(c, "c_nationkey", table(spark, sf, "nation"), "n_nationkey", {"n_name": "country"})
    v = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("channel_id"), F.col("c_name").alias("channel_title"), "country",
        F.col("o_totalprice").cast("string").alias("subscriber_count"), "o_orderdate", "o_orderkey")
    return build_dim_channel(v, ["o_orderdate", "o_orderkey"])
