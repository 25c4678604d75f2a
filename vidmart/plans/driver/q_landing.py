"""Driver queries: landed API pages (S6). Pages of 50 items are made from the driver tables with
some fields and whole objects missing, then flattened; each twin states the expected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ... import schemas as S
from ...functions.timefn import instant_to_ntz
from ...session import scratch_path
from ...sources import ingest as IN
from ...sources.io import land_csv, read_table
from .registry import query, table

PAGE_ITEMS = 50


def _pages(df: DataFrame, key: str, item: Column) -> DataFrame:
    """JSON pages; a page holds the items of 50 neighbouring keys, NULL fields are left out."""
    pages = df.groupBy(F.floor(F.col(key) / PAGE_ITEMS)).agg(F.collect_list(item).alias("items"))
    return pages.select(F.to_json(F.struct("items")).alias("payload"))


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("landed_videos", """
SELECT 'v' || k AS video_id, CASE WHEN k % 3 <> 0 THEN o_orderpriority END AS title,
       CASE WHEN k % 5 <> 0 THEN o_orderstatus END AS description, CAST(o_custkey AS VARCHAR) AS channel_id,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS publish_time,
       CASE WHEN k % 2 = 0 THEN 'http://img.example.com/' || k END AS thumbnail,
       'trending' AS keyword, 'trending' AS topic, 'trending' AS source
FROM (SELECT *, o_orderkey AS k FROM orders)
""")
def landed_videos(spark, sf):
    k = F.col("o_orderkey")
    url = F.struct(F.concat(F.lit("http://img.example.com/"), _text(k)).alias("url"))
    item = F.struct(F.concat(F.lit("v"), _text(k)).alias("id"), F.struct(
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("title"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("description"),
        _text("o_custkey").alias("channelId"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.when(k % 2 == 0, F.create_map(F.lit("default"), url)).otherwise(F.create_map(F.lit("high"), url)).alias("thumbnails"),
    ).alias("snippet"))
    items = IN.explode_items(_pages(table(spark, sf, "orders"), "o_orderkey", item))
    out = IN.flatten_videos(items, "trending", F.current_timestamp(), keyword=F.lit("trending"))
    return out.drop("channel_title", "discover_time")


@query("landed_stats", """
SELECT 'v' || k AS video_id, CASE WHEN k % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS views,
       CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN o_custkey ELSE 0 END AS likes,
       CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN k % 100 ELSE 0 END AS comments,
       CASE WHEN k % 13 = 0 THEN 0 WHEN k % 4 = 0 THEN 3600 + 60 * (k % 60)
            WHEN k % 4 = 1 THEN 60 * (k % 60) + k % 50 ELSE 0 END AS duration_seconds,
       CASE WHEN k % 13 <> 0 THEN o_orderstatus END AS definition,
       CASE WHEN k % 13 <> 0 AND k % 2 = 0 THEN '2d' END AS dimension,
       k % 13 <> 0 AND k % 2 = 0 AS licensed_content,
       CAST(CASE WHEN k % 11 <> 0 THEN k % 30 END AS INTEGER) AS category_id,
       CASE WHEN k % 11 <> 0 AND k % 3 = 0 THEN 'vi' END AS default_language,
       CASE WHEN k % 11 <> 0 AND k % 6 = 0 THEN o_orderpriority || ',' || o_orderstatus ELSE '' END AS tags,
       CAST(o_totalprice > 300000 AS INTEGER) AS is_trending
FROM (SELECT *, o_orderkey AS k FROM orders)
""")
def landed_stats(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    video = F.concat(F.lit("v"), _text(k))
    duration = F.when(k % 4 == 0, F.format_string("PT1H%dM", k % 60)).when(k % 4 == 1, F.format_string("PT%dM%d.5S", k % 60, k % 50)) \
        .when(k % 4 == 2, "one hour")
    item = F.struct(
        video.alias("id"),
        F.when(k % 7 != 0, F.struct(
            _text(F.floor("o_totalprice")).alias("viewCount"), F.when(k % 3 != 0, _text("o_custkey")).alias("likeCount"),
            F.when(k % 5 != 0, _text(k % 100)).alias("commentCount"))).alias("statistics"),
        F.when(k % 13 != 0, F.struct(
            duration.alias("duration"), F.col("o_orderstatus").alias("definition"),
            F.when(k % 2 == 0, "2d").alias("dimension"), (k % 2 == 0).alias("licensedContent"))).alias("contentDetails"),
        F.when(k % 11 != 0, F.struct(
            _text(k % 30).alias("categoryId"), F.when(k % 3 == 0, "vi").alias("defaultLanguage"),
            F.when(k % 6 == 0, F.array("o_orderpriority", "o_orderstatus")).alias("tags"))).alias("snippet"))
    trending = o.where(F.col("o_totalprice") > 300000).select(video.alias("video_id"))
    out = IN.flatten_video_stats(IN.explode_items(_pages(o, "o_orderkey", item)), F.current_timestamp(), trending)
    return out.drop("snapshot_time", "caption", "default_audio_language").withColumn("is_trending", F.col("is_trending").cast("int"))


@query("landed_channels", """
SELECT 'c' || k AS channel_id, c_name AS channel_title, CASE WHEN k % 2 = 0 THEN '@' || k END AS custom_url,
       c_mktsegment AS channel_description, CASE WHEN k % 3 <> 0 THEN 'N' || c_nationkey END AS country,
       CASE WHEN k % 8 <> 0 THEN 37 * k ELSE 0 END AS subscriber_count,
       CASE WHEN k % 8 <> 0 AND k % 5 <> 0 THEN 1000 * k ELSE 0 END AS view_count,
       CASE WHEN k % 8 <> 0 AND k % 4 <> 1 THEN k % 90 ELSE 0 END AS video_count,
       k % 8 <> 0 AND k % 6 <> 0 AND k % 4 = 1 AS hidden_subscriber_count
FROM (SELECT *, c_custkey AS k FROM customer)
""")
def landed_channels(spark, sf):
    k = F.col("c_custkey")
    item = F.struct(
        F.concat(F.lit("c"), _text(k)).alias("id"),
        F.struct(F.col("c_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("@"), _text(k))).alias("customUrl"),
                 F.col("c_mktsegment").alias("description"),
                 F.when(k % 3 != 0, F.concat(F.lit("N"), _text("c_nationkey"))).alias("country")).alias("snippet"),
        F.when(k % 8 != 0, F.struct(
            _text(37 * k).alias("subscriberCount"), F.when(k % 5 != 0, _text(1000 * k)).alias("viewCount"),
            F.when(k % 4 != 1, _text(k % 90)).otherwise(F.lit("many")).alias("videoCount"),
            F.when(k % 6 != 0, k % 4 == 1).alias("hiddenSubscriberCount"))).alias("statistics"))
    pages = _pages(table(spark, sf, "customer"), "c_custkey", item)
    return IN.flatten_channels(IN.explode_items(pages, schema=S.API_CHANNEL_PAGE)).drop("published_at")


@query("landed_comments", """
SELECT CAST(event_id AS VARCHAR) AS comment_id, 'v' || user_id AS video_id,
       CASE WHEN event_id % 9 <> 0 THEN event_type END AS author_name, props AS comment_text,
       CASE WHEN event_id % 4 <> 0 THEN event_id % 50 ELSE 0 END AS like_count, ts AS published_at,
       CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 7 HOUR WHEN 2 THEN date_trunc('second', ts) END AS updated_at
FROM events
""")
def landed_comments(spark, sf):
    k = F.col("event_id")
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    updated = F.when(k % 3 == 0, F.concat(plain, F.lit("+07:00"))).when(k % 3 == 1, "yesterday").otherwise(plain)
    item = F.struct(F.struct(
        F.concat(F.lit("v"), _text("user_id")).alias("videoId"),
        F.struct(_text(k).alias("id"), F.struct(
            F.when(k % 9 != 0, F.col("event_type")).alias("authorDisplayName"), F.col("props").alias("textDisplay"),
            F.when(k % 4 != 0, k % 50).alias("likeCount"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("publishedAt"), updated.alias("updatedAt"),
        ).alias("snippet")).alias("topLevelComment")).alias("snippet"))
    pages = _pages(table(spark, sf, "events"), "event_id", item)
    out = IN.flatten_comments(IN.explode_items(pages, schema=S.API_COMMENT_PAGE))
    return out.withColumns({c: instant_to_ntz(c) for c in ("published_at", "updated_at")})


@query("json_all_fields", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, event_type AS m
FROM events
""")
def json_all_fields(spark, sf):
    """A field without a default is kept as well."""
    ev = table(spark, sf, "events").withColumn("j", F.to_json(F.struct(
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("event_type").alias("m"))))
    return IN.json_fields(ev, "j", "k BIGINT, m STRING", {"k": 0}, keep=("event_id",))


@query("landed_csv", """
SELECT doc_id, lang, md5(text) AS text_md5, length(text) - length(replace(text, chr(10), '')) AS line_breaks, n_chars FROM documents
""")
def landed_csv(spark, sf):
    """Quoted CSV files with line breaks in their texts, landed in splits (S1, S3, K1), read back as a table."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars")
    src, dst = scratch_path(spark, "land-csv"), scratch_path(spark, "landed-csv")
    (docs.write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(src))
    land_csv(spark, src, dst, docs.schema)
    back = read_table(spark, dst)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return back.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"), breaks.cast("bigint").alias("line_breaks"), "n_chars")
