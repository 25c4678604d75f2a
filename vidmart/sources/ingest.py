"""Landing of nested API payloads and row-level quarantine.

A landed page is one JSON document with an ``items`` array; it is parsed
with a fixed schema (``from_json``), exploded to one row per item and
flattened with per-field defaults. No Python touches a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import to_count
from ..functions.text import tags_text
from ..functions.timefn import iso_duration_seconds, ntz_to_instant, parse_timestamp
from ..schemas import API_VIDEO_PAGE


def json_fields(df: DataFrame, col: str, schema: StructType | str,
                defaults: Mapping[str, object] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse a JSON text column with a fixed schema and lift its fields to
    columns; a missing/NULL/malformed field gets its default."""
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    names = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names
    out = [F.col(k) for k in keep]
    for n in names:
        v = parsed.getField(n)
        if defaults and n in defaults:
            v = F.coalesce(v, F.lit(defaults[n]))
        out.append(v.alias(n))
    return df.select(*out)


def explode_items(pages: DataFrame, json_col: str = "payload", schema: StructType = API_VIDEO_PAGE) -> DataFrame:
    """One row per ``items[]`` element; an empty or missing array gives no rows."""
    parsed = pages.select(F.from_json(F.col(json_col), schema).alias("_vm_p"))
    return parsed.select(F.explode_outer("_vm_p.items").alias("item")).where(F.col("item").isNotNull())


def flatten_video_stats(items: DataFrame, snapshot_time: Column, trending_ids: DataFrame | None = None) -> DataFrame:
    """API video items -> raw_video_stats rows with the landing defaults
    (counts 0, duration "PT0S" -> 0, tags "", licensed False); other missing fields are NULL."""
    i = F.col("item")
    out = items.select(
        i.getField("id").alias("video_id"),
        to_count(i.getField("statistics").getField("viewCount")).alias("views"),
        to_count(i.getField("statistics").getField("likeCount")).alias("likes"),
        to_count(i.getField("statistics").getField("commentCount")).alias("comments"),
        iso_duration_seconds(F.coalesce(i.getField("contentDetails").getField("duration"), F.lit("PT0S")))
        .alias("duration_seconds"),
        i.getField("contentDetails").getField("definition").alias("definition"),
        i.getField("contentDetails").getField("caption").alias("caption"),
        i.getField("contentDetails").getField("dimension").alias("dimension"),
        F.coalesce(i.getField("contentDetails").getField("licensedContent"), F.lit(False)).alias("licensed_content"),
        i.getField("snippet").getField("categoryId").try_cast("int").alias("category_id"),
        i.getField("snippet").getField("defaultLanguage").alias("default_language"),
        i.getField("snippet").getField("defaultAudioLanguage").alias("default_audio_language"),
        tags_text(i.getField("snippet").getField("tags")).alias("tags"),
        snapshot_time.alias("snapshot_time"))
    if trending_ids is not None:
        from ..operators.dedup import membership_flag
        out = membership_flag(out, "video_id", trending_ids, name="is_trending")
    return out


def flatten_videos(items: DataFrame, source: str, discover_time: Column, keyword: Column | None = None,
                   topic: Column | None = None) -> DataFrame:
    """API video items -> raw_video rows (S6); missing fields are NULL."""
    i = F.col("item")
    sn = i.getField("snippet")
    return items.select(
        i.getField("id").alias("video_id"),
        sn.getField("title").alias("title"),
        sn.getField("description").alias("description"),
        sn.getField("channelId").alias("channel_id"),
        sn.getField("channelTitle").alias("channel_title"),
        sn.getField("publishedAt").alias("publish_time"),
        F.try_element_at(sn.getField("thumbnails"), F.lit("default")).getField("url").alias("thumbnail"),
        (keyword if keyword is not None else F.lit(None).cast("string")).alias("keyword"),
        (topic if topic is not None else F.lit("trending")).alias("topic"),
        F.lit(source).alias("source"),
        discover_time.alias("discover_time"))


def flatten_channels(items: DataFrame) -> DataFrame:
    """API channel items -> raw_channel rows; counts default 0, hidden flag False."""
    i = F.col("item")
    sn, st = i.getField("snippet"), i.getField("statistics")
    return items.select(
        i.getField("id").alias("channel_id"), sn.getField("title").alias("channel_title"),
        sn.getField("customUrl").alias("custom_url"), sn.getField("description").alias("channel_description"),
        sn.getField("publishedAt").alias("published_at"), sn.getField("country").alias("country"),
        to_count(st.getField("subscriberCount")).alias("subscriber_count"),
        to_count(st.getField("viewCount")).alias("view_count"),
        to_count(st.getField("videoCount")).alias("video_count"),
        F.coalesce(st.getField("hiddenSubscriberCount"), F.lit(False)).alias("hidden_subscriber_count"))


def flatten_comments(items: DataFrame, video_id: Column | None = None) -> DataFrame:
    """API comment-thread items -> raw_comment rows (top-level comment;
    like_count default 0; times parsed, bad -> NULL)."""
    i = F.col("item").getField("snippet")
    c = i.getField("topLevelComment")
    cs = c.getField("snippet")

    def ts(x):
        return ntz_to_instant(parse_timestamp(x))

    return items.select(
        c.getField("id").alias("comment_id"),
        (video_id if video_id is not None else i.getField("videoId")).alias("video_id"),
        cs.getField("authorDisplayName").alias("author_name"), cs.getField("textDisplay").alias("comment_text"),
        F.coalesce(cs.getField("likeCount"), F.lit(0)).alias("like_count"),
        ts(cs.getField("publishedAt")).alias("published_at"), ts(cs.getField("updatedAt")).alias("updated_at"))


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row fails (a NULL rule result is a failure)."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]),
                    lambda x: x.isNotNull())


def quarantine_split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Row-level quarantine (K6): rows passing every rule, and the others with
    the list of failed rule names. Replaces the batch rollback: good rows
    load, bad rows are kept aside (write both from the same tagged frame)."""
    tagged = df.withColumn("failed_rules", failed_rules(rules))
    ok = tagged.where(F.size("failed_rules") == 0).drop("failed_rules")
    bad = tagged.where(F.size("failed_rules") > 0)
    return ok, bad


def with_loaded_at(df: DataFrame, name: str = "loaded_at") -> DataFrame:
    """The ``loaded_at DEFAULT now()`` column of the typed comment table."""
    return df.withColumn(name, F.current_timestamp())
