"""Driver queries: text and date scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as TX
from ...functions.lookups import COUNTRY_TO_REGION_SERVING, serving_region
from ...functions.timefn import age_label as age_label_fn, date_label, publish_parts as publish_parts_fn
from .registry import query, r6, sql_case, table

_PUB_TEXT_SQL = """CASE event_type WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
                    WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                    WHEN 'click' THEN strftime(ts, '%Y%m%d')
                    WHEN 'view' THEN 'garbage' ELSE NULL END"""


@query("publish_parts", f"""
SELECT event_id, pub,
       CAST(coalesce(hour(iso), CASE WHEN ymd IS NOT NULL THEN 12 END, 12) AS INTEGER) AS publish_hour,
       CAST(coalesce(isodow(iso) - 1, isodow(ymd) - 1, 2) AS INTEGER) AS publish_weekday_num
FROM (SELECT event_id, pub, try_strptime(substr(pub, 1, 19), '%Y-%m-%dT%H:%M:%S') AS iso,
             try_strptime(substr(pub, 1, 8), '%Y%m%d') AS ymd
      FROM (SELECT event_id, {_PUB_TEXT_SQL} AS pub FROM events))
""")
def publish_parts(spark, sf):
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    pub = (F.when(et == "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(et == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
           .when(et == "click", F.date_format("ts", "yyyyMMdd"))
           .when(et == "view", F.lit("garbage")))
    d = ev.select("event_id", pub.alias("pub"))
    h, w = publish_parts_fn("pub")
    return d.select("event_id", "pub", h.alias("publish_hour"), w.alias("publish_weekday_num"))


NOW = "2024-01-15 12:00:00"


@query("age_label", f"""
SELECT event_id,
       CASE WHEN ts IS NULL THEN '' WHEN h < 1 THEN 'vừa xong'
            WHEN h < 24 THEN CAST(h AS VARCHAR) || ' giờ trước'
            ELSE CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || ' ngày trước' END AS age,
       coalesce(strftime(ts, '%d/%m/%Y'), '-') AS date_text
FROM (SELECT event_id, ts,
             CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9) AS BIGINT) AS h FROM events)
""")
def age_label(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", age_label_fn("ts", NOW).alias("age"), date_label("ts").alias("date_text"))


def _human_sql(x):
    n = f"CAST(trunc({x}) AS BIGINT)"
    return (f"CASE WHEN {n} >= 1000000000 THEN printf('%.1fB', {n} / 1e9) "
            f"WHEN {n} >= 1000000 THEN printf('%.1fM', {n} / 1e6) "
            f"WHEN {n} >= 1000 THEN printf('%.1fK', {n} / 1e3) ELSE CAST({n} AS VARCHAR) END")


@query("human_number", f"""
SELECT o_orderkey, {_human_sql('o_totalprice')} AS price_label,
       {_human_sql('o_totalprice * o_custkey')} AS reach_label,
       {_human_sql('o_custkey')} AS channel_label
FROM orders
""")
def human_number(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", TX.human_number("o_totalprice").alias("price_label"),
                    TX.human_number(F.col("o_totalprice") * F.col("o_custkey")).alias("reach_label"),
                    TX.human_number("o_custkey").alias("channel_label"))


@query("duration_label", """
SELECT l_orderkey, l_linenumber, s AS seconds,
       CASE WHEN s // 3600 > 0 THEN printf('%d hour %d mins', s // 3600, (s % 3600) // 60)
            WHEN (s % 3600) // 60 > 0 THEN printf('%d mins %d sec', (s % 3600) // 60, s % 60)
            ELSE printf('%d sec', s % 60) END AS label
FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 10) AS BIGINT) AS s FROM lineitem)
""")
def duration_label(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.floor(F.col("l_extendedprice") / 10).cast("bigint")
    d = li.select("l_orderkey", "l_linenumber", s.alias("seconds"))
    return d.withColumn("label", TX.duration_label("seconds"))


_HOST_RE = r"^https?://([^/?#]+)"
_LANG_RE = r"^https?://[^/]+/([a-z]{2})/"
_PAGE_RE = r"/(\d+)(?:[?#]|$)"


@query("url_extract", f"""
SELECT page_id, nullif(regexp_extract(url, '{_HOST_RE}', 1), '') AS host,
       nullif(regexp_extract(url, '{_LANG_RE}', 1), '') AS lang,
       nullif(regexp_extract(url, '{_PAGE_RE}', 1), '') AS page_no,
       nullif(regexp_extract(url, '{TX.VIDEO_ID_RE}', 1), '') AS video_id
FROM pages
""")
def url_extract(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", TX.extract_video_id("url", _HOST_RE).alias("host"),
                    TX.extract_video_id("url", _LANG_RE).alias("lang"),
                    TX.extract_video_id("url", _PAGE_RE).alias("page_no"),
                    TX.extract_video_id("url").alias("video_id"))


@query("initials", """
SELECT p_partkey, coalesce(nullif(upper(left(split_part(trim(p_name), ' ', 1), 1))
                                  || upper(left(split_part(trim(p_name), ' ', 2), 1)), ''), 'CH') AS initials
FROM part
""")
def initials(spark, sf):
    return table(spark, sf, "part").select("p_partkey", TX.initials("p_name").alias("initials"))


@query("score_band", """
SELECT l_orderkey, l_linenumber, round(l_discount * 10, 6) AS prob,
       CASE WHEN l_discount * 10 >= 0.6 THEN 'HIGH' WHEN l_discount * 10 >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS band
FROM lineitem
""")
def score_band(spark, sf):
    li = table(spark, sf, "lineitem")
    p = F.col("l_discount") * 10
    return li.select("l_orderkey", "l_linenumber", r6(p).alias("prob"), TX.score_band(p).alias("band"))


def _reason_sql():
    t = TX
    return f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN views < 1000 THEN '{t.REASON_LOW_VIEWS}' WHEN lr < 0.01 THEN '{t.REASON_LIKE_LOW}'
       WHEN lr > 0.05 THEN '{t.REASON_LIKE_HIGH}' ELSE '{t.REASON_LIKE_MID}' END || ', ' ||
  CASE WHEN views < 1000 THEN '{t.REASON_COMMENT_NO_DATA}' WHEN cr < 0.0005 THEN '{t.REASON_COMMENT_LOW}'
       WHEN cr > 0.002 THEN '{t.REASON_COMMENT_HIGH}' ELSE '{t.REASON_COMMENT_MID}' END || ' | ' ||
  CASE WHEN subs < 1000 THEN '{t.REASON_CHANNEL_SMALL}'
       WHEN subs < 100000 THEN printf('{t.REASON_CHANNEL_MID}', subs // 1000)
       ELSE printf('{t.REASON_CHANNEL_BIG}', subs // 1000) END
  || ' | Topic: ' || topic || ' | Vùng: ' || region AS reason
FROM (SELECT l_orderkey, l_linenumber, l_discount AS lr, l_tax / 20 AS cr, l_extendedprice / 10 AS views,
             CAST((l_quantity - 1) * 3000 AS BIGINT) AS subs, l_linestatus AS topic, l_returnflag AS region FROM lineitem)
"""


@query("reason_text", _reason_sql())
def reason_text(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", TX.reason_text(
        F.col("l_discount"), F.col("l_tax") / 20, F.col("l_extendedprice") / 10,
        ((F.col("l_quantity") - 1) * 3000).cast("bigint"), topic="l_linestatus", region="l_returnflag").alias("reason"))


@query("video_id_forms", """
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN lpad(CAST(page_id AS VARCHAR), 11, 'a') END AS video_id FROM pages
""")
def video_id_forms(spark, sf):
    """The three url forms; an id that is too short does not match."""
    k = F.col("page_id")
    full = F.lpad(k.cast("string"), 11, "a")
    url = (F.when(k % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), full, F.lit("&t=5")))
           .when(k % 4 == 1, F.concat(F.lit("https://youtu.be/"), full))
           .when(k % 4 == 2, F.concat(F.lit("https://www.youtube.com/embed/"), full, F.lit("?rel=0")))
           .otherwise(F.concat(F.lit("https://youtu.be/"), F.substring(full, 2, 10))))
    return table(spark, sf, "pages").select("page_id", TX.extract_video_id(url).alias("video_id"))


@query("repair_text", """
SELECT doc_id, md5(coalesce(text, '')) AS repaired, md5(coalesce(text, '')) AS kept FROM documents
""")
def repair_text(spark, sf):
    """Whole texts, garbled (UTF-8 read as Windows-1252) and as they are. A text with one of the
    five bytes that this code page leaves open can't have been read so, and is not garbled."""
    t = F.col("text")
    wide = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    garbled = F.when(wide.rlike(r"[\x81\x8D\x8F\x90\x9D]"), t).otherwise(F.translate(wide, TX.CP1252_BYTES, TX.CP1252_CHARS))
    return table(spark, sf, "documents").select("doc_id", F.md5(TX.repair_text(garbled)).alias("repaired"),
                                                F.md5(TX.repair_text(t)).alias("kept"))


@query("thousands_label", """
SELECT o_orderkey, format('{:,}', o_custkey * 9973) AS label FROM orders
""")
def thousands_label(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", TX.thousands(F.col("o_custkey") * 9973).alias("label"))


@query("percent_label", """
SELECT o_orderkey, format('{:.1f}%', o_custkey * 100.0::DOUBLE / 7) AS label FROM orders
""")
def percent_label(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", TX.percent_text(F.col("o_custkey") * F.lit(100.0) / 7).alias("label"))


@query("first_present", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 <> 0 THEN 'h' || c_custkey
                       WHEN c_custkey % 5 <> 0 THEN 'm' || c_custkey ELSE '' END AS thumbnail FROM customer
""")
def first_present(spark, sf):
    """The first picture in the preferred order that has an address; some are missing or empty."""
    k = F.col("c_custkey")
    url = lambda c: F.struct(c.alias("url"))
    high = F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("h"), k.cast("string")))
    medium = F.when(k % 5 != 0, F.concat(F.lit("m"), k.cast("string")))
    pictures = F.when(k % 3 == 0, F.create_map(F.lit("high"), url(high), F.lit("medium"), url(medium))).otherwise(F.create_map(F.lit("medium"), url(medium)))
    return table(spark, sf, "customer").select("c_custkey", TX.first_present(pictures).alias("thumbnail"))


_CODES = [*COUNTRY_TO_REGION_SERVING][:20]


@query("serving_region", f"""
SELECT c_custkey, {sql_case("coalesce(nullif(upper(code), ''), 'US')", COUNTRY_TO_REGION_SERVING, "North America")} AS region
FROM (SELECT c_custkey, CASE WHEN c_nationkey < {len(_CODES)} THEN lower({_CODES!r}[c_nationkey + 1])
             WHEN c_nationkey % 3 = 0 THEN '' WHEN c_nationkey % 3 = 1 THEN 'zz' END AS code FROM customer)
""")
def serving_region_q(spark, sf):
    n = F.col("c_nationkey")
    code = (F.when(n < len(_CODES), F.lower(F.get(F.array(*map(F.lit, _CODES)), n)))
            .when(n % 3 == 0, "").when(n % 3 == 1, "zz"))
    return table(spark, sf, "customer").select("c_custkey", serving_region(code).alias("region"))
