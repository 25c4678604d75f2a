"""End-to-end refresh on the landing schemas:
landing tables -> dimensions and facts -> flat dataset -> cleaned analysis
table -> one-row-per-video ML table. Every output is a lazy DataFrame; the
caller decides which ones to write (``write_table`` / ``write_bucketed``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_count
from ..functions.timefn import ntz_to_instant, parse_timestamp
from ..operators.dedup import dedup
from .features import clean_snapshots, engagement_rates, region_column, time_features, valid_engagement
from .warehouse import (build_dim_channel, build_dim_time, build_dim_topic, build_dim_video, build_fact_comment,
                        build_fact_video_metrics, comment_metrics, flat_dataset)

# text columns filled with "Unknown", and the channel counts a row must have
TEXT_COLS = ["description", "tags", "default_language", "default_audio_language", "channel_title", "custom_url",
             "channel_description", "country"]
REQUIRED = ["video_count", "view_count"]
ML_FEATURES = ["channel_id", "subscriber_count", "view_count", "video_count", "like_rate", "comment_rate",
               "duration_seconds", "topic", "country_region", "is_trending", "publish_hour", "publish_weekday_num"]


def iso_utc(col: str):
    """ISO-8601 text (with or without a zone suffix) -> timestamp; bad -> NULL."""
    return ntz_to_instant(parse_timestamp(col))


def refresh_warehouse(raw_video: DataFrame, raw_video_stats: DataFrame, raw_channel: DataFrame,
                      channel_order: Sequence[str] = (), raw_comment: DataFrame | None = None,
                      comment_order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Star schema + flat dataset from the landing tables.

    * videos: first discovery wins (``discover_time``);
    * snapshots: counts coerced to whole numbers, one row per
      (video_id, snapshot_time);
    * channels: last version in ``channel_order`` wins;
    * comments, if given: first in ``comment_order`` wins; fact, metrics by video and
      the comment analysis table."""
    video = dedup(raw_video, ["video_id"], ["discover_time"], keep="first") \
        .withColumn("publish_time", iso_utc("publish_time"))
    stats = raw_video_stats
    for c in ("views", "likes", "comments"):
        stats = stats.withColumn(c, to_count(c))
    stats = dedup(stats, ["video_id", "snapshot_time"], keep="first")
    dim_topic = build_dim_topic(raw_video, "topic")
    dim_time = build_dim_time(video, "publish_time")
    dim_channel = build_dim_channel(raw_channel, channel_order)
    dim_video = build_dim_video(video, stats, topics=dim_topic)
    fact = build_fact_video_metrics(stats, dim_video)
    flat = flat_dataset(fact, dim_video, dim_channel, dim_time)
    out = {"dim_topic": dim_topic, "dim_time": dim_time, "dim_channel": dim_channel, "dim_video": dim_video,
           "fact_video_metrics": fact, "final_dataset": flat}
    return out if raw_comment is None else out | refresh_comments(raw_comment, comment_order)


def refresh_comments(raw_comment: DataFrame, order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Typed comment fact, its metrics by video and the comment analysis table. Sentiment counts
    and score are there if ``raw_comment`` has a ``sentiment_label``, else NULL."""
    fact = build_fact_comment(raw_comment, order)
    labels = raw_comment.select("comment_id", "sentiment_label") if "sentiment_label" in raw_comment.columns else None
    labelled = fact if labels is None else \
        fact.join(dedup(labels.where("sentiment_label is not null"), ["comment_id"], keep="first"), "comment_id", "left")
    return {"fact_comment": fact, "fact_comment_metrics": comment_metrics(labelled),
            "comment_dataset": fact.select("comment_id", "video_id", "comment_text", "like_count", "published_at")}


def cleaned_video(flat: DataFrame) -> DataFrame:
    """The analysis table: channel creation renamed, text gaps filled,
    region inferred, invalid engagement removed, rates and time parts added."""
    d = flat.withColumnRenamed("published_at", "channel_created_at") if "published_at" in flat.columns else flat
    present = [c for c in TEXT_COLS if c in d.columns]
    d = clean_snapshots(d, required=[c for c in REQUIRED if c in d.columns], fill_text=present,
                        valid=valid_engagement(F.col("views"), F.col("likes")))
    d = region_column(d)
    d = engagement_rates(d, "views", "likes", "comments")
    return time_features(d, "publish_time", "snapshot_time")


def ml_table(cleaned: DataFrame) -> DataFrame:
    """One row per video: first non-NULL value of each feature in snapshot order."""
    from .features import ml_dataset
    feats = [c for c in ML_FEATURES if c in cleaned.columns]
    d = cleaned.withColumn("is_trending", F.col("is_trending").cast("boolean"))
    return ml_dataset(d.select("video_id", "snapshot_time", *feats), "video_id", ["snapshot_time"], feats)


def publish_warehouse(tables: dict[str, DataFrame], prefix: str = "vm", buckets: int = 64) -> list[str]:
    """Save the refreshed tables as catalog tables. Tables keyed by video
    (dim_video, fact_video_metrics, final_dataset) are bucketed and sorted by
    ``video_id`` with one bucket count, so later joins between them need no
    shuffle; the other dimensions are small and written plainly."""
    from ..sources.io import write_bucketed
    saved = []
    for name, df in tables.items():
        table = f"{prefix}_{name}"
        if "video_id" in df.columns:
            write_bucketed(df, table, "video_id", buckets)
        else:
            df.write.mode("overwrite").format("parquet").saveAsTable(table)
        saved.append(table)
    return saved
