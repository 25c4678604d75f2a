"""Fixed schemas of the landing, warehouse and analysis tables.

Ids are always strings; nothing is inferred at read time.
"""

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType, IntegerType,
                               LongType, MapType, StringType, StructField, StructType,
                               TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, nullable) for n, t, nullable in
                       [(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields]])


S, L, I, D, B, TS, DT = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType(), TimestampType(), DateType()

KEYWORD_SEED = _s(("keyword", S), ("topic", S), ("active", I))

RAW_VIDEO = _s(("video_id", S), ("title", S), ("description", S), ("channel_id", S),
               ("channel_title", S), ("publish_time", S), ("thumbnail", S), ("keyword", S),
               ("topic", S), ("source", S), ("discover_time", TS))

RAW_VIDEO_STATS = _s(("video_id", S), ("is_trending", I), ("views", S), ("likes", S),
                     ("comments", S), ("duration_seconds", L), ("definition", S), ("caption", S),
                     ("dimension", S), ("licensed_content", B), ("category_id", I),
                     ("default_language", S), ("default_audio_language", S), ("tags", S),
                     ("snapshot_time", TS))

RAW_CHANNEL = _s(("channel_id", S), ("channel_title", S), ("custom_url", S),
                 ("channel_description", S), ("published_at", S), ("country", S),
                 ("subscriber_count", L), ("view_count", L), ("video_count", L),
                 ("hidden_subscriber_count", B))

RAW_COMMENT = _s(("comment_id", S), ("video_id", S), ("author_name", S), ("comment_text", S),
                 ("like_count", S), ("published_at", TS), ("updated_at", TS))

DIM_TOPIC = _s(("topic_id", I), ("topic_name", S))

DIM_CHANNEL = _s(("channel_id", S), ("channel_title", S), ("custom_url", S),
                 ("channel_description", S), ("published_at", S), ("country", S),
                 ("subscriber_count", L), ("view_count", L), ("video_count", L))

DIM_TIME = _s(("time_id", S), ("date", DT), ("year", I), ("quarter", I), ("month", I),
              ("week_of_year", I), ("day", I), ("weekday", I), ("hour", I))

FACT_VIDEO_METRICS = _s(("video_id", S), ("views", L), ("likes", L), ("comments", L),
                        ("snapshot_time", TS), ("is_trending", I), ("channel_id", S),
                        ("time_id", S), ("source", S))

# PK comment_id, NOT NULL video_id, like_count default 0, loaded_at default now
FACT_COMMENT = _s(("comment_id", S, False), ("video_id", S, False), ("author_name", S),
                  ("comment_text", S), ("like_count", I), ("published_at", TS),
                  ("updated_at", TS), ("loaded_at", TS))

FACT_COMMENT_METRICS = _s(("video_id", S), ("total_comments", L), ("total_likes", L),
                          ("avg_like_per_comment", D), ("max_like_comment", L),
                          ("positive_count", L), ("negative_count", L), ("neutral_count", L),
                          ("sentiment_score", D))

# Landed API page (one JSON document per page)
_THUMBS = MapType(S, StructType([StructField("url", S)]))
API_VIDEO_PAGE = StructType([StructField("items", ArrayType(StructType([
    StructField("id", S),
    StructField("snippet", StructType([
        StructField("title", S), StructField("description", S), StructField("channelId", S),
        StructField("channelTitle", S), StructField("publishedAt", S), StructField("categoryId", S),
        StructField("tags", ArrayType(S)), StructField("defaultLanguage", S),
        StructField("defaultAudioLanguage", S), StructField("thumbnails", _THUMBS)])),
    StructField("statistics", StructType([
        StructField("viewCount", S), StructField("likeCount", S), StructField("commentCount", S)])),
    StructField("contentDetails", StructType([
        StructField("duration", S), StructField("definition", S), StructField("caption", S),
        StructField("dimension", S), StructField("licensedContent", B)])),
])))])

TABLES = {
    "keyword_seed": KEYWORD_SEED, "raw_video": RAW_VIDEO, "raw_video_stats": RAW_VIDEO_STATS,
    "raw_channel": RAW_CHANNEL, "raw_comment": RAW_COMMENT, "dim_topic": DIM_TOPIC,
    "dim_channel": DIM_CHANNEL, "dim_time": DIM_TIME, "fact_video_metrics": FACT_VIDEO_METRICS,
    "fact_comment": FACT_COMMENT, "fact_comment_metrics": FACT_COMMENT_METRICS,
}

API_CHANNEL_PAGE = StructType([StructField("items", ArrayType(StructType([
    StructField("id", S),
    StructField("snippet", StructType([
        StructField("title", S), StructField("customUrl", S), StructField("description", S),
        StructField("publishedAt", S), StructField("country", S)])),
    StructField("statistics", StructType([
        StructField("subscriberCount", S), StructField("viewCount", S), StructField("videoCount", S),
        StructField("hiddenSubscriberCount", B)])),
])))])

API_COMMENT_PAGE = StructType([StructField("items", ArrayType(StructType([
    StructField("snippet", StructType([
        StructField("videoId", S),
        StructField("topLevelComment", StructType([
            StructField("id", S),
            StructField("snippet", StructType([
                StructField("authorDisplayName", S), StructField("textDisplay", S),
                StructField("likeCount", L), StructField("publishedAt", S), StructField("updatedAt", S)])),
        ])),
    ])),
])))])
