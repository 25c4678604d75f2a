"""Date/time scalars (D1-D11). All are built-in Column expressions that stay
inside whole-stage codegen; bad text becomes NULL (``try_*``) because ANSI
mode raises on a failed parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


#: Date, or date and time with an optional fraction and zone, as the API delivers them.
ISO_PLAIN_RE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$"
ISO_ZONED_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def parse_timestamp(text: Column | str, fmt: str = ISO_SECONDS) -> Column:
    """``to_datetime(errors="coerce")``: NULL on bad text. The result has no zone: text
    with a zone becomes its UTC wall clock, whatever the session time zone."""
    t = _c(text)
    if fmt != ISO_SECONDS:
        return F.try_to_timestamp(t, F.lit(fmt)).cast("timestamp_ntz")
    return (F.when(t.rlike(ISO_ZONED_RE), instant_to_ntz(t.try_cast("timestamp")))
            .when(t.rlike(ISO_PLAIN_RE), t.try_cast("timestamp_ntz")))


def time_id(ts: Column | str) -> Column:
    """Hour key ``yyyyMMddHH``; NULL time stays NULL (never the text "nan")."""
    return F.date_format(_c(ts), "yyyyMMddHH")


def weekday0(ts: Column | str) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(ts)).cast("int")


def weekday_name(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "EEEE")


def time_parts(ts: Column | str) -> dict[str, Column]:
    """The dim_time columns of one timestamp (ISO week, weekday 0=Mon)."""
    t = _c(ts)
    return {
        "time_id": time_id(t),
        "date": F.to_date(t),
        "year": F.year(t).cast("int"),
        "quarter": F.quarter(t).cast("int"),
        "month": F.month(t).cast("int"),
        "week_of_year": F.weekofyear(t).cast("int"),
        "day": F.dayofmonth(t).cast("int"),
        "weekday": weekday0(t),
        "hour": F.hour(t).cast("int"),
    }


EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(ts: Column | str) -> Column:
    """Zone-less wall clock -> the instant with that wall clock in UTC, for
    event-time operators (watermarks need an instant). Independent of the
    session time zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), _c(ts)))


def instant_to_ntz(ts: Column | str) -> Column:
    """Inverse of ``ntz_to_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(ts)), F.expr(EPOCH_NTZ))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Signed hours from ``earlier`` to ``later`` at microsecond precision."""
    micros = F.timestamp_diff("MICROSECOND", _c(earlier), _c(later))
    return micros.cast("double") / F.lit(3.6e9)


# ISO-8601 duration (weeks, days, hours, minutes, seconds); a fraction of a second is cut off; anything else -> 0.
ISO_DURATION_RE = r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.\d+)?S)?)?$"


def iso_duration_seconds(text: Column | str) -> Column:
    t = _c(text)
    parts = [F.coalesce(F.nullif(F.regexp_extract(t, ISO_DURATION_RE, i), F.lit("")).try_cast("bigint"),
                        F.lit(0))
             for i in range(1, 6)]
    w, d, h, m, s = parts
    return F.coalesce(w * 604800 + d * 86400 + h * 3600 + m * 60 + s, F.lit(0)).cast("bigint")


def publish_parts(text: Column | str, default_hour: int = 12, default_weekday: int = 2) -> tuple[Column, Column]:
    """Hour and weekday of a publish time with the fallback chain
    ISO (first 19 chars) -> ``yyyyMMdd`` (first 8 chars, hour 12) -> defaults."""
    t = _c(text)
    iso = F.try_to_timestamp(F.substring(t, 1, 19), F.lit(ISO_SECONDS))
    ymd = F.try_to_timestamp(F.substring(t, 1, 8), F.lit("yyyyMMdd"))
    hour = F.coalesce(F.hour(iso), F.when(ymd.isNotNull(), F.lit(default_hour)), F.lit(default_hour))
    wday = F.coalesce(F.weekday(iso), F.weekday(ymd), F.lit(default_weekday))
    return hour.cast("int"), wday.cast("int")


def age_label(ts: Column | str, now: str, just_now: str = "vừa xong", hours_fmt: str = "%d giờ trước",
              days_fmt: str = "%d ngày trước") -> Column:
    """Relative age against a fixed ``now`` literal (repeatable runs):
    under 1 h -> ``just_now``; under 24 h -> hours; else whole days."""
    h = F.floor(hours_between(F.lit(now).cast("timestamp_ntz"), _c(ts))).cast("bigint")
    return (F.when(_c(ts).isNull(), F.lit(""))
            .when(h < 1, F.lit(just_now))
            .when(h < 24, F.format_string(hours_fmt, h))
            .otherwise(F.format_string(days_fmt, F.floor(h / 24).cast("bigint"))))


def date_label(ts: Column | str) -> Column:
    """Day-first date text; missing -> "-"."""
    return F.coalesce(F.date_format(_c(ts), "dd/MM/yyyy"), F.lit("-"))
