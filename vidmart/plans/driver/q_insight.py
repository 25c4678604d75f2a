"""Driver queries: dashboard and notebook insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.timefn import weekday0
from ...operators.dedup import first_snapshot
from ...operators.insight import label_impact
from .registry import LINEITEM_REST, order_sql, query, r6, table, trend


@query("label_impact_weekday", f"""
WITH f AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY {order_sql(["l_shipdate", *LINEITEM_REST])}) AS rn FROM lineitem) WHERE rn = 1)
SELECT CAST(isodow(o.o_orderdate) - 1 AS INTEGER) AS weekday,
       CAST(sum(CASE WHEN f.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
       count(*) AS n,
       round(avg(CASE WHEN f.l_returnflag = 'R' THEN 1 ELSE 0 END), 6) AS rate
FROM f LEFT JOIN orders o ON f.l_orderkey = o.o_orderkey
WHERE o.o_orderdate IS NOT NULL
GROUP BY 1
""")
def label_impact_weekday(spark, sf):
    snaps = first_snapshot(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")
    videos = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = snaps.join(videos, snaps.l_orderkey == videos.o_orderkey, "left")
    g = label_impact(j, weekday0("o_orderdate"), trend(), name="weekday")
    return g.withColumn("rate", r6("rate"))


from ...functions import text as TX  # noqa: E402
from ...functions.timefn import weekday_name  # noqa: E402
from ...operators.dedup import dedup  # noqa: E402
from ...operators.insight import (complete_domain, crosstab, crosstab_pct, group_mean, rank_rows,  # noqa: E402
                                  rate_vs_mean, top_k, topn_totals)
from ...operators.profile import value_counts, with_share  # noqa: E402


def _snaps_videos(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left")


SNAPS_VIDEOS_SQL = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"


@query("crosstab_topic", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
       count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1
""")
def crosstab_topic(spark, sf):
    return crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("crosstab_pct_region", """
SELECT r_name AS region,
       round(count(*) FILTER (WHERE l_returnflag <> 'R') * 100.0 / count(*), 6) AS pct_not_trending,
       round(count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*), 6) AS pct_trending
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IS NOT NULL
GROUP BY 1
""")
def crosstab_pct_region(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", trend().alias("is_trending"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    p = crosstab_pct(j, "region", "is_trending", [0, 1], ["pct_not_trending", "pct_trending"])
    return p.select("region", r6("pct_not_trending").alias("pct_not_trending"),
                    r6("pct_trending").alias("pct_trending"))


@query("label_impact_hour", """
SELECT CAST(hour(ts) AS INTEGER) AS hour,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, count(*) AS n,
       round(avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS rate
FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1
""")
def label_impact_hour(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type").isNotNull())
    g = label_impact(ev, F.hour("ts").cast("int"), F.col("event_type") == "purchase", name="hour")
    return g.withColumn("rate", r6("rate"))


@query("rate_by_topic", f"""
SELECT o_orderpriority AS topic, round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100, 6) AS rate_pct
FROM {SNAPS_VIDEOS_SQL} WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def rate_by_topic(spark, sf):
    j = _snaps_videos(spark, sf).withColumn("is_trending", trend()).withColumnRenamed("o_orderpriority", "topic")
    return group_mean(j, "topic", "is_trending", "rate_pct", scale=100.0).withColumn("rate_pct", r6("rate_pct"))


@query("mean_views_by_topic", f"""
SELECT o_orderpriority AS topic, round(avg(l_extendedprice), 6) AS mean_views
FROM {SNAPS_VIDEOS_SQL} WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def mean_views_by_topic(spark, sf):
    j = _snaps_videos(spark, sf).withColumnRenamed("o_orderpriority", "topic")
    return group_mean(j, "topic", "l_extendedprice", "mean_views").withColumn("mean_views", r6("mean_views"))


@query("rate_vs_mean", f"""
WITH g AS (SELECT o_orderpriority AS topic, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rate
           FROM {SNAPS_VIDEOS_SQL} WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT topic, round(rate, 6) AS rate, round(avg(rate) OVER (), 6) AS mean_rate,
       CAST(rate > avg(rate) OVER () AS INTEGER) AS above_mean
FROM g
""")
def rate_vs_mean_q(spark, sf):
    j = _snaps_videos(spark, sf).withColumn("is_trending", trend()).withColumnRenamed("o_orderpriority", "topic")
    g = rate_vs_mean(group_mean(j, "topic", "is_trending", "rate"), "rate")
    return g.select("topic", r6("rate").alias("rate"), r6("mean_rate").alias("mean_rate"), "above_mean")


@query("kpi_overview", f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY {order_sql(["l_shipdate", *LINEITEM_REST])}) AS rn FROM lineitem) WHERE rn = 1)
SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_videos,
       (SELECT count(DISTINCT o_custkey) FROM orders) AS n_channels,
       (SELECT count(*) FROM events) AS n_comments,
       (SELECT round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100, 6) FROM f) AS trending_rate_pct
""")
def kpi_overview(spark, sf):
    li = table(spark, sf, "lineitem")
    first = first_snapshot(li, "l_orderkey", "l_shipdate")
    n_videos = li.agg(F.count_distinct("l_orderkey")).scalar()
    n_channels = table(spark, sf, "orders").agg(F.count_distinct("o_custkey")).scalar()
    n_comments = table(spark, sf, "events").agg(F.count(F.lit(1))).scalar()
    # the rate is the one row; the counts are scalar subqueries over their own tables
    rate = first.agg(r6(F.avg(trend()) * 100).alias("trending_rate_pct"))
    return rate.select(n_videos.alias("n_videos"), n_channels.alias("n_channels"), n_comments.alias("n_comments"),
                       "trending_rate_pct")


TOPN = 30
FEED_SQL = f"""
top AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
               row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rk
        FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {TOPN})),
agg AS (SELECT l_orderkey, sum(l_quantity) AS likes, count(*) AS comments FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM top) GROUP BY 1),
feed AS (SELECT top.*, coalesce(agg.likes, 0) AS likes, coalesce(agg.comments, 0) AS comments
         FROM top LEFT JOIN agg ON top.o_orderkey = agg.l_orderkey)"""


def feed_frame(spark, sf):
    """The ranked top-N feed: orders by price (TakeOrderedAndProject), their
    lines aggregated through a semi-join on the N keys only."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    top = top_k(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], TOPN)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    li = li.join(top.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    agg = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("likes"), F.count(F.lit(1)).alias("comments"))
    feed = top.join(agg, top.o_orderkey == agg.l_orderkey, "left").drop("l_orderkey") \
        .withColumn("likes", F.coalesce("likes", F.lit(0.0))).withColumn("comments", F.coalesce("comments", F.lit(0)))
    return rank_rows(feed, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "rk")


@query("topn_totals", f"""
WITH {FEED_SQL}, n AS (SELECT unnest([10, 20, 30]) AS top_n)
SELECT top_n, count(*) AS n_videos, round(sum(o_totalprice), 6) AS total_views, round(sum(likes), 6) AS total_likes,
       CAST(sum(comments) AS BIGINT) AS total_comments,
       round(CASE WHEN sum(o_totalprice) = 0 THEN 0 ELSE (sum(likes) + sum(comments)) / sum(o_totalprice) END, 6)
         AS engagement,
       round(least(99.0, greatest(1.0, CASE WHEN sum(o_totalprice) = 0 THEN 0
             ELSE (sum(likes) + sum(comments)) / sum(o_totalprice) END * 1000)), 6) AS growth_est
FROM feed, n WHERE rk <= top_n GROUP BY top_n
""")
def topn_totals_q(spark, sf):
    t = topn_totals(feed_frame(spark, sf), "rk", [10, 20, 30], "o_totalprice", "likes", "comments")
    return t.select(F.col("top_n").cast("int").alias("top_n"), "n_videos", r6("total_views").alias("total_views"),
                    r6("total_likes").alias("total_likes"), F.col("total_comments").cast("bigint").alias("total_comments"),
                    r6("engagement").alias("engagement"), r6("growth_est").alias("growth_est"))


@query("topn_channels", f"""
WITH {FEED_SQL},
ch AS (SELECT o_custkey AS channel_id, sum(o_totalprice) AS views FROM feed GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY views DESC, channel_id) AS rank FROM ch)
SELECT channel_id, round(views, 6) AS views, CAST(rank AS INTEGER) AS rank, CAST(rank <= 3 AS INTEGER) AS is_top3,
       round(views * 100.0 / (SELECT sum(o_totalprice) FROM feed), 6) AS share_pct
FROM rk WHERE rank <= 5
""")
def topn_channels(spark, sf):
    feed = feed_frame(spark, sf)
    ch = feed.groupBy(F.col("o_custkey").alias("channel_id")).agg(F.sum("o_totalprice").alias("views"))
    top = rank_rows(top_k(ch, [F.col("views").desc(), F.col("channel_id")], 5),
                    [F.col("views").desc(), F.col("channel_id")], "rank")
    total = feed.agg(F.sum("o_totalprice")).scalar()
    return top.select("channel_id", r6("views").alias("views"), F.col("rank").cast("int").alias("rank"),
                      (F.col("rank") <= 3).cast("int").alias("is_top3"),
                      r6(F.col("views") * 100.0 / total).alias("share_pct"))


@query("topn_categories", f"""
WITH {FEED_SQL}
SELECT o_orderpriority AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM feed GROUP BY 1
""")
def topn_categories(spark, sf):
    g = value_counts(feed_frame(spark, sf), "o_orderpriority", name="n").withColumnRenamed("o_orderpriority", "category")
    return with_share(g, "n").withColumn("pct", r6("pct"))


@query("top_channel_rates", """
WITH top AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10),
title AS (SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name,
          row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) AS rn FROM customer) WHERE rn = 1)
SELECT o.o_custkey AS channel_id, t.c_name AS channel_title, count(*) AS n_snapshots,
       round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 6) AS rate
FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey
     LEFT JOIN title t ON o.o_custkey = t.c_custkey
WHERE o.o_custkey IN (SELECT o_custkey FROM top)
GROUP BY 1, 2
""")
def top_channel_rates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    top = top_k(value_counts(o, "o_custkey", name="n"), [F.col("n").desc(), F.col("o_custkey")], 10)
    vids = o.join(top.select("o_custkey"), "o_custkey", "left_semi")
    li = table(spark, sf, "lineitem").select("l_orderkey", trend().alias("is_trending"))
    j = li.join(vids, li.l_orderkey == vids.o_orderkey)
    g = j.groupBy(F.col("o_custkey").alias("channel_id")).agg(F.count(F.lit(1)).alias("n_snapshots"),
                                                              r6(F.avg("is_trending")).alias("rate"))
    titles = dedup(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], ["c_name"])
    return g.join(titles, g.channel_id == titles.c_custkey, "left").select(
        "channel_id", F.col("c_name").alias("channel_title"), "n_snapshots", "rate")


_WEEKDAYS_SQL = ", ".join(f"({i}, '{d}')" for i, d in enumerate(TX.WEEKDAY_ORDER))


@query("weekday_counts", f"""
WITH d AS (SELECT * FROM (VALUES {_WEEKDAYS_SQL}) AS t(ordinal, weekday)),
c AS (SELECT left(dayname(ts), 3) AS weekday, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT CAST(d.ordinal AS INTEGER) AS ordinal, d.weekday, coalesce(c.count, 0) AS count
FROM d LEFT JOIN c ON d.weekday = c.weekday
""")
def weekday_counts(spark, sf):
    ev = table(spark, sf, "events").where(F.col("ts").isNotNull())
    counts = value_counts(ev.select(TX.short_weekday(weekday_name("ts")).alias("weekday")), "weekday")
    return complete_domain(spark, counts, "weekday", TX.WEEKDAY_ORDER)


@query("hour_counts", """
WITH d AS (SELECT CAST(range AS INTEGER) AS hour FROM range(24)),
c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT d.hour, coalesce(c.count, 0) AS count FROM d LEFT JOIN c ON d.hour = c.hour
""")
def hour_counts(spark, sf):
    ev = table(spark, sf, "events").where(F.col("ts").isNotNull())
    counts = value_counts(ev.select(F.hour("ts").cast("int").alias("hour")), "hour")
    return complete_domain(spark, counts, "hour", list(range(24))).drop("ordinal")
