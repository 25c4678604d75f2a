"""Star-schema builders (J1-J4, A1-A5, D2-D5, Q3, Q16) and the flat dataset.

Column names default to the landing schema (``vidmart.schemas``); every
builder is a lazy DataFrame -> DataFrame function, so a whole warehouse
refresh is one DAG per output table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import backfill_topic
from ..functions.numeric import round_ratio_half_even, to_count
from ..functions.text import clean_label
from ..functions.timefn import time_parts
from ..operators.dedup import dedup, distinct_rows, surrogate_key
from ..schemas import FACT_COMMENT
from ..sources.io import select_present

SENTIMENTS = ("positive", "negative", "neutral")


def build_dim_topic(df: DataFrame, topic_col: str = "topic") -> DataFrame:
    """topic_id 1..n over the alphabetical distinct cleaned topics; NULL and
    empty topics are dropped (Q1)."""
    t = df.select(clean_label(topic_col).alias("topic_name"))
    return surrogate_key(t, "topic_name", "topic_id")


def build_dim_channel(channels: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Last version per channel (in ``order``), counts coerced to whole numbers."""
    d = dedup(channels, ["channel_id"], order, keep="last")
    for c in ("subscriber_count", "view_count", "video_count"):
        if c in d.columns:
            d = d.withColumn(c, to_count(c))
    return select_present(d, ["channel_id", "channel_title", "custom_url", "channel_description",
                              "published_at", "country", "subscriber_count", "view_count", "video_count"])


def build_fact_comment(comments: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Typed comment fact (K5): one row per comment_id (first wins), rows
    without a video dropped (NOT NULL), like_count coerced to a whole number
    (bad -> 0), ``loaded_at`` stamped at load time."""
    d = comments.where(F.col("comment_id").isNotNull() & F.col("video_id").isNotNull())
    d = dedup(d, ["comment_id"], order, keep="first")
    d = d.withColumn("like_count", to_count("like_count").cast("int"))
    types = {f.name: f.dataType for f in FACT_COMMENT}
    d = select_present(d.withColumn("loaded_at", F.current_timestamp()), list(types))
    # a zone-less time stays as it came: giving it a zone is the reader's decision
    zoneless = {c for c, t in d.dtypes if t == "timestamp_ntz"}
    return d.select(*[F.col(c) if c in zoneless else F.col(c).cast(types[c]) for c in d.columns])


def build_dim_time(df: DataFrame, ts_col: str = "snapshot_time") -> DataFrame:
    """One row per hour key of the timestamps present; every part is a
    function of the hour key, so a distinct is exact."""
    d = df.select(F.col(ts_col).alias("_vm_ts")).where(F.col("_vm_ts").isNotNull())
    parts = time_parts(F.date_trunc("hour", F.col("_vm_ts")))
    return distinct_rows(d.select(*[c.alias(k) for k, c in parts.items()]))


def latest_stats(stats: DataFrame, key: str = "video_id", order: str = "snapshot_time") -> DataFrame:
    return dedup(stats, [key], [order], keep="last")


def build_dim_video(videos: DataFrame, stats: DataFrame, key: str = "video_id",
                    publish_col: str = "publish_time", stats_order: str = "snapshot_time",
                    stats_cols: Sequence[str] = ("duration_seconds", "definition", "caption",
                                                 "licensed_content", "category_id", "default_language",
                                                 "default_audio_language", "tags"),
                    topics: DataFrame | None = None) -> DataFrame:
    """Video attributes ⟕ the latest snapshot's attributes (J1). The latest
    snapshot is taken BEFORE the join, so the join key is unique on both
    sides; time_id stays NULL for a bad publish time (Q3)."""
    last = latest_stats(stats, key, stats_order)
    last = last.select(key, *[c for c in stats_cols if c in last.columns])
    v = videos.withColumn("time_id", time_parts(publish_col)["time_id"])
    out = v.join(last, key, "left")
    if topics is not None and "topic" in out.columns:  # Q16: attach topic_id by name
        out = out.join(topics.select(F.col("topic_name").alias("_vm_tn"), "topic_id"),
                       clean_label("topic") == F.col("_vm_tn"), "left").drop("_vm_tn")
    return out


def build_fact_video_metrics(stats: DataFrame, videos: DataFrame, key: str = "video_id",
                             measures: Sequence[str] = ("views", "likes", "comments", "snapshot_time",
                                                        "is_trending"),
                             attrs: Sequence[str] = ("channel_id", "time_id", "source")) -> DataFrame:
    """Distinct snapshot rows ⟕ video attributes."""
    facts = distinct_rows(stats.select(key, *measures))
    v = videos.select(key, *[c for c in attrs if c in videos.columns])
    return facts.join(v, key, "left")


def flat_dataset(fact: DataFrame, dim_video: DataFrame, dim_channel: DataFrame, dim_time: DataFrame,
                 key: str = "video_id", channel_key: str = "channel_id", time_key: str = "time_id",
                 drop_from_video: Sequence[str] = ("channel_id", "time_id", "source", "channel_title"),
                 trending_marker: str = "trending", category_col: str = "category_id") -> DataFrame:
    """fact ⟕ video ⟕ channel ⟕ time (J3) with the topic back-fill.
    Columns that would collide are dropped from the video side first."""
    v = dim_video.drop(*drop_from_video)
    out = (fact.join(v, key, "left")
           .join(dim_channel, channel_key, "left")
           .join(dim_time, time_key, "left"))
    if "topic" in out.columns and category_col in out.columns:
        out = out.withColumn("topic", backfill_topic("topic", category_col, trending_marker))
    return out


def comment_metrics(comments: DataFrame, key: str = "video_id", id_col: str = "comment_id",
                    like_col: str = "like_count", label_col: str = "sentiment_label") -> DataFrame:
    """Per video, ONE aggregation (A1+A2+A3, J4 fused): comment count, like
    sum / mean (2 dp, half-even) / max, fixed-class sentiment counts (0 for an
    absent class, NULL when no comment is labelled) and net sentiment (pos-neg)/(pos+neg+neu) at 4 dp; NULL when
    the video has no labelled comment, NULL columns when there is no label."""
    likes = F.col(like_col).cast("bigint")
    aggs = [F.count(id_col).alias("total_comments"),
            F.coalesce(F.sum(likes), F.lit(0)).alias("total_likes"),
            round_ratio_half_even(F.sum(likes), F.count(likes), 2).alias("avg_like_per_comment"),
            F.max(likes).alias("max_like_comment")]
    has_label = label_col in comments.columns
    for s in SENTIMENTS:
        c = F.when(F.count(label_col) > 0, F.count_if(F.col(label_col) == s)) if has_label else F.lit(None).cast("bigint")
        aggs.append(c.alias(f"{s}_count"))
    g = comments.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    if has_label:
        pos, neg, neu = (F.col(f"{s}_count") for s in SENTIMENTS)
        score = round_ratio_half_even(pos - neg, pos + neg + neu, 4)
    else:
        score = F.lit(None).cast("double")
    return g.withColumn("sentiment_score", score)


def sentiment_features(comments: DataFrame, key: str = "video_id", label_col: str = "sentiment_label",
                       score_col: str = "sentiment_score") -> DataFrame:
    """Per video class ratios, total and mean score (A4, A5) in one aggregate."""
    d = comments.where(F.col(label_col).isNotNull() & F.col(key).isNotNull())
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("total"),
                           *[F.count_if(F.col(label_col) == s).alias(f"_vm_{s}") for s in SENTIMENTS],
                           F.avg(score_col).alias("mean_score"))
    return g.select(key, "total", *[(F.col(f"_vm_{s}") / F.col("total")).alias(f"{s}_ratio") for s in SENTIMENTS],
                    "mean_score")


def with_columns(df: DataFrame, cols: Mapping) -> DataFrame:
    return df.withColumns(dict(cols))
