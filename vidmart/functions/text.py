"""String scalars (T1-T12, C5, C6): built-in expressions; only the ``score_text`` model hook
is a pandas UDF."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .lookups import literal_map


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Fixed values (must equal the source project's texts and patterns).
# ---------------------------------------------------------------------------
VIDEO_ID_RE = r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([A-Za-z0-9_-]{11})"
WEEKDAY_ORDER = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
WEEKDAY_SPELLINGS = {
    "monday": "Mon", "mon": "Mon", "tuesday": "Tue", "tue": "Tue",
    "wednesday": "Wed", "wed": "Wed", "thursday": "Thu", "thu": "Thu",
    "friday": "Fri", "fri": "Fri", "saturday": "Sat", "sat": "Sat",
    "sunday": "Sun", "sun": "Sun",
}
THUMB_PREFERENCE = ["high", "maxres", "standard", "medium", "default"]
REASON_LOW_VIEWS = "Video còn ít lượt xem"
REASON_LIKE_LOW = "Tỉ lệ like thấp"
REASON_LIKE_HIGH = "Tỉ lệ like rất tốt"
REASON_LIKE_MID = "Tỉ lệ like ổn định"
REASON_COMMENT_NO_DATA = "chưa đủ dữ liệu tương tác"
REASON_COMMENT_LOW = "bình luận thấp"
REASON_COMMENT_HIGH = "tương tác bình luận tốt"
REASON_COMMENT_MID = "bình luận ở mức trung bình"
REASON_CHANNEL_SMALL = "Kênh nhỏ (dưới 1K subscribers)"
REASON_CHANNEL_MID = "Kênh vừa (~%dK subscribers)"
REASON_CHANNEL_BIG = "Kênh lớn (~%dK subscribers)"
REASON_TOPIC = " | Topic: "
REASON_REGION = " | Vùng: "
RECOMMENDATIONS = {
    "like_rate": "Increase audience engagement through stronger thumbnails, titles, and calls-to-action.",
    "comment_rate": "Encourage viewers to leave comments by asking questions or creating discussion-driven content.",
    "publish_hour": "Test different publishing times to reach more viewers",
    "duration_seconds": "Adjust video length to better match successful trending content.",
    "video_count": "Upload content consistently to strengthen channel performance.",
    "subscriber_count": "Increase subscriber growth through consistent content and audience retention.",
    "view_count": "Increase video exposure through SEO optimization and cross-platform promotion.",
    "country_region": "Consider tailoring content for regions with stronger trending potential.",
    "topic": "Explore content topics that historically perform better with your audience.",
}
RECOMMENDATION_DEFAULT = ("All major features are contributing positively. "
                          "Continue maintaining the current content strategy.")


def clean_label(x: Column | str) -> Column:
    """trim + lower; empty result -> NULL."""
    return F.nullif(F.lower(F.trim(_c(x))), F.lit(""))


def extract_video_id(url: Column | str, pattern: str = VIDEO_ID_RE, group: int = 1) -> Column:
    """First id captured by ``pattern``; no match -> NULL (callers quarantine NULLs)."""
    return F.nullif(F.regexp_extract(_c(url), pattern, group), F.lit(""))


def short_weekday(x: Column | str) -> Column:
    """Normalise weekday text: known spellings -> Mon..Sun, else the first
    three letters title-cased."""
    t = F.lower(F.trim(_c(x)))
    return F.coalesce(F.try_element_at(literal_map(WEEKDAY_SPELLINGS), t), F.initcap(F.substring(t, 1, 3)))


def weekday_ordinal(short: Column | str) -> Column:
    return (F.array_position(F.array(*[F.lit(d) for d in WEEKDAY_ORDER]), _c(short)) - 1).cast("int")


def _one_decimal(x: Column) -> Column:
    # format_number rounds the exact binary value (HALF_EVEN); drop its grouping commas
    return F.regexp_replace(F.format_number(x, 1), ",", "")


def human_number(x: Column | str, with_billions: bool = True) -> Column:
    """Whole number (truncated) -> "1.2B" / "3.4M" / "5.6K" / "789"."""
    n = F.coalesce(_c(x).try_cast("double").try_cast("bigint"), F.lit(0))
    out = F.when(n >= 1_000_000, F.concat(_one_decimal(n / 1e6), F.lit("M"))) \
        .when(n >= 1_000, F.concat(_one_decimal(n / 1e3), F.lit("K"))) \
        .otherwise(n.cast("string"))
    if with_billions:
        out = F.when(n >= 1_000_000_000, F.concat(_one_decimal(n / 1e9), F.lit("B"))).otherwise(out)
    return out


def thousands(x: Column | str) -> Column:
    """Comma-grouped whole number text."""
    return F.format_number(_c(x).cast("double"), 0)


def percent_text(x: Column | str) -> Column:
    """A percentage with one decimal: "12.3%"; NULL stays NULL."""
    return F.concat(_one_decimal(_c(x).cast("double")), F.lit("%"))


def duration_label(seconds: Column | str) -> Column:
    """Seconds -> "H hour M mins" / "M mins S sec" / "S sec"."""
    s = F.coalesce(_c(seconds).try_cast("bigint"), F.lit(0))
    h, m, sec = F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, 3600) / 60).cast("bigint"), F.pmod(s, 60)
    return (F.when(h > 0, F.format_string("%d hour %d mins", h, m))
            .when(m > 0, F.format_string("%d mins %d sec", m, sec))
            .otherwise(F.format_string("%d sec", sec)))


def initials(name: Column | str, default: str = "CH") -> Column:
    """First letters of the first two words, upper-cased; none -> default."""
    words = F.filter(F.split(F.trim(_c(name)), r"\s+"), lambda w: w != "")
    first2 = F.slice(words, 1, 2)
    s = F.array_join(F.transform(first2, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def first_present(m: Column | str, keys: Sequence[str] = THUMB_PREFERENCE, field: str = "url") -> Column:
    """First non-empty ``m[k].field`` in preference order; none -> ""."""
    mc = _c(m)
    return F.coalesce(*[F.nullif(F.try_element_at(mc, F.lit(k)).getField(field), F.lit("")) for k in keys],
                      F.lit(""))


def tags_text(tags: Column | str) -> Column:
    return F.array_join(F.coalesce(_c(tags), F.array().cast("array<string>")), ",")


def score_band(prob: Column | str, high: float = 0.60, medium: float = 0.35) -> Column:
    p = _c(prob)
    return F.when(p >= high, "HIGH").when(p >= medium, "MEDIUM").otherwise("LOW")


def reason_text(like_rate: Column | str, comment_rate: Column | str, views: Column | str,
                subscribers: Column | str, like_low: float = 0.01, like_high: float = 0.05,
                comment_low: float = 0.0005, comment_high: float = 0.002, min_views: int = 1000,
                small_channel: int = 1000, big_channel: int = 100_000, topic: Column | str | None = None,
                region: Column | str | None = None) -> Column:
    """Rule-based explanation text: like part, comment part, channel-size part, and the
    topic and region where they are given (NULL reads as empty)."""
    lr, cr, v = _c(like_rate), _c(comment_rate), _c(views)
    subs = _c(subscribers).cast("bigint")
    r1 = (F.when(v < min_views, REASON_LOW_VIEWS).when(lr < like_low, REASON_LIKE_LOW)
          .when(lr > like_high, REASON_LIKE_HIGH).otherwise(REASON_LIKE_MID))
    r2 = (F.when(v < min_views, REASON_COMMENT_NO_DATA).when(cr < comment_low, REASON_COMMENT_LOW)
          .when(cr > comment_high, REASON_COMMENT_HIGH).otherwise(REASON_COMMENT_MID))
    k = F.floor(subs / 1000).cast("bigint")
    r3 = (F.when(subs < small_channel, REASON_CHANNEL_SMALL)
          .when(subs < big_channel, F.format_string(REASON_CHANNEL_MID, k))
          .otherwise(F.format_string(REASON_CHANNEL_BIG, k)))
    more = [x for label, c in ((REASON_TOPIC, topic), (REASON_REGION, region)) if c is not None
            for x in (F.lit(label), F.coalesce(_c(c).cast("string"), F.lit("")))]
    return F.concat(r1, F.lit(", "), r2, F.lit(" | "), r3, *more)


#: The characters that Windows-1252 puts at the bytes 80 to 9F, and those bytes as code points.
_HIGH = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
CP1252_CHARS = "".join(c for _, c in _HIGH)
CP1252_BYTES = "".join(b for b, c in _HIGH if c)
#: How the first two bytes of a UTF-8 character beyond ASCII look when they were read as Windows-1252.
GARBLED = f"[\\xC2-\\xF4][\\xA0-\\xBF{CP1252_CHARS}]"


def repair_text(text: Column | str) -> Column:
    """Mojibake repair: UTF-8 that was read as Windows-1252 is read again; text that does not
    go into that code page, or whose bytes are not UTF-8, stays; NULL gives "". Text without
    two characters that could be one garbled one is only searched for them."""
    t = _c(text)
    again = F.encode(F.translate(t, CP1252_CHARS, CP1252_BYTES), "ISO-8859-1").cast("string")
    fits = t.rlike(f"^[\\x00-\\x7F\\xA0-\\xFF{CP1252_CHARS}]*$")
    return F.when(t.isNull(), F.lit("")).when(~t.rlike(GARBLED), t).when(~fits, t).when(F.is_valid_utf8(again), again).otherwise(t)


def score_text(df, col: str, scorer_factory, label: str = "sentiment_label", score: str = "sentiment_score"):
    """Hook for an external text classifier (the sentiment model is not part
    of this package). ``scorer_factory()`` is called once per task and must
    return a function ``pd.Series[str] -> pd.DataFrame[label, score]``; it is
    applied to Arrow batches through an iterator pandas UDF, so a heavy model
    loads once per task, never per row."""

    @pandas_udf("label string, score double")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = scorer_factory()
        for s in batches:
            out = fn(s.fillna(""))
            yield pd.DataFrame({"label": out.iloc[:, 0].astype(object), "score": out.iloc[:, 1].astype(float)})

    return df.withColumn("_vm_s", _score(F.col(col))) \
        .withColumn(label, F.col("_vm_s.label")).withColumn(score, F.col("_vm_s.score")).drop("_vm_s")
