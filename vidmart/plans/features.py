"""Cleaning and feature engineering (F1-F8, M1-M3, C2, C3, C7, D11) and
the one-row-per-video ML table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import infer_region
from ..functions.numeric import rate
from ..functions.timefn import weekday0, weekday_name
from ..operators.dedup import first_nonnull

TEXT_FILL = "Unknown"
PEAK_HOURS = (9, 10, 21, 22, 23)
WEEKEND_DAYS = (4, 5, 6)       # Fri-Sun as weekday ordinals (0 = Mon)
MUSIC_CATEGORIES = (10, 20)


def valid_engagement(views: Column, likes: Column) -> Column:
    """views > 0 AND likes <= views."""
    return (views > 0) & (likes <= views)


def clean_snapshots(df: DataFrame, required: Sequence[str], fill_text: Sequence[str],
                    valid: Column | None = None, casts: dict[str, str] | None = None) -> DataFrame:
    """dropna(subset) -> fillna("Unknown") on text columns -> validity filter ->
    safe casts (bad values become NULL, never an error)."""
    d = df.dropna(subset=list(required))
    d = d.na.fill(TEXT_FILL, list(fill_text))
    if valid is not None:
        d = d.where(valid)
    for c, t in (casts or {}).items():
        d = d.withColumn(c, F.col(c).try_cast(t))
    return d


def engagement_rates(df: DataFrame, views: str, likes: str, comments: str) -> DataFrame:
    return df.withColumn("like_rate", rate(likes, views)).withColumn("comment_rate", rate(comments, views))


def time_features(df: DataFrame, publish_col: str, snapshot_col: str | None = None) -> DataFrame:
    d = (df.withColumn("publish_hour", F.hour(publish_col).cast("int"))
         .withColumn("publish_weekday", weekday_name(publish_col))
         .withColumn("publish_weekday_num", weekday0(publish_col)))
    if snapshot_col:
        d = d.withColumn("snapshot_weekday", weekday_name(snapshot_col))
    return d


def feature_flags(hour: Column, weekday: Column, category: Column, music: Sequence = MUSIC_CATEGORIES,
                  peak: Sequence[int] = PEAK_HOURS, weekend: Sequence[int] = WEEKEND_DAYS,
                  definition: Column | None = None) -> dict[str, Column]:
    """0/1 flags; weekend compares the weekday ORDINAL (Q2); ``is_hd`` when a
    definition column is given."""
    flags = {"is_music": category.isin(list(music)).cast("int"),
             "is_peak_hour": hour.isin(list(peak)).cast("int"),
             "is_weekend": weekday.isin(list(weekend)).cast("int")}
    if definition is not None:
        flags["is_hd"] = F.coalesce(F.lower(definition) == "hd", F.lit(False)).cast("int")
    return flags


def region_column(df: DataFrame, country: str = "country", language: str = "default_language",
                  audio: str = "default_audio_language", name: str = "country_region") -> DataFrame:
    return df.withColumn(name, infer_region(country, language, audio))


def ml_dataset(snapshots: DataFrame, key: str, order: Sequence[str], feature_cols: Sequence[str]) -> DataFrame:
    """One row per video: per feature the first non-NULL value in snapshot
    order (W4), one aggregate."""
    return first_nonnull(snapshots, [key], order, feature_cols)
