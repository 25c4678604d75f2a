"""Driver queries: sources, ingest, dedup and upsert operators (S2, S6, K4,
K6, J6, J7, F3, W1-W4, W8, W9, U1-U3, T10, D1, D7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numeric import to_count
from ...functions.timefn import iso_duration_seconds, parse_timestamp
from ...operators.dedup import (cap_per_key, dedup, first_nonnull, first_snapshot, insert_ignore,
                                merge_keep_first, merge_keep_last, new_only, pack_batches)
from ...sources.ingest import failed_rules, json_fields
from ...sources.io import read_table
from .registry import LINEITEM_COLS, LINEITEM_REST, order_sql, query, table

LI_SELECT = ", ".join(LINEITEM_COLS)


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query("scan_pruned", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
""")
def scan_pruned(spark, sf):
    return read_table(spark, f"{sf}/orders.parquet", cols=["o_orderkey", "o_custkey", "o_orderdate"],
                      where=(F.col("o_orderdate") >= _ts("1996-01-01")) & (F.col("o_orderdate") < _ts("1997-01-01")))


@query("json_flatten", """
SELECT event_id, user_id, event_type,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k
FROM events
""")
def json_flatten(spark, sf):
    return json_fields(table(spark, sf, "events"), "props", "k BIGINT", {"k": 0},
                       keep=("event_id", "user_id", "event_type"))


@query("quarantine_split", """
SELECT event_type,
       count(*) FILTER (WHERE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) < 50, false)) AS n_valid,
       count(*) FILTER (WHERE NOT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) < 50, false)) AS n_quarantined
FROM events GROUP BY event_type
""")
def quarantine_split_q(spark, sf):
    ev = table(spark, sf, "events").withColumn("k_text", F.get_json_object("props", "$.k"))
    fails = failed_rules({"k_numeric": F.col("k_text").try_cast("bigint").isNotNull(),
                          "k_below_50": F.col("k_text").try_cast("bigint") < 50})
    tagged = ev.withColumn("failed_rules", fails)
    # both sides of the split counted in one aggregate over the tagged frame
    return tagged.groupBy("event_type").agg(F.count_if(F.size("failed_rules") == 0).alias("n_valid"),
                                            F.count_if(F.size("failed_rules") > 0).alias("n_quarantined"))


INSERT_IGNORE_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, 'target' AS src FROM orders
WHERE o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice, 'batch' AS src FROM orders b
WHERE o_orderdate >= TIMESTAMP '1997-01-01'
  AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderdate < TIMESTAMP '1998-01-01'
                  AND t.o_orderkey = b.o_orderkey)
"""


def insert_ignore_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    target = o.where(F.col("o_orderdate") < _ts("1998-01-01")).drop("o_orderdate")
    batch = o.where(F.col("o_orderdate") >= _ts("1997-01-01")).drop("o_orderdate")
    return target, batch


@query("insert_ignore", INSERT_IGNORE_SQL)
def insert_ignore_q(spark, sf):
    target, batch = insert_ignore_parts(spark, sf)
    added = insert_ignore(target, batch, ["o_orderkey"])
    return target.withColumn("src", F.lit("target")).unionByName(added.withColumn("src", F.lit("batch")))


@query("new_only", """
SELECT DISTINCT user_id FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
                  AND p.ts < TIMESTAMP '2024-01-03' AND p.user_id = e.user_id)
""")
def new_only_q(spark, sf):
    ev = table(spark, sf, "events")
    seen = ev.where((F.col("event_type") == "purchase") & (F.col("ts") < _ts("2024-01-03")))
    return new_only(ev.select("user_id").distinct(), seen, ["user_id"])


@query("missing_videos", """
SELECT p_partkey, p_name FROM part
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 45 AND l_partkey = p_partkey)
""")
def missing_videos(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("p_partkey"))
    return new_only(table(spark, sf, "part").select("p_partkey", "p_name"), li, ["p_partkey"])


@query("active_keywords", """
SELECT p_name AS keyword, p_brand AS topic FROM part WHERE p_size > 25
""")
def active_keywords(spark, sf):
    seed = table(spark, sf, "part").select(F.col("p_name").alias("keyword"), F.col("p_brand").alias("topic"),
                                           (F.col("p_size") > 25).cast("int").alias("active"))
    return seed.where(F.col("active") == 1).drop("active")


def _dedup_sql(keep_last: bool) -> str:
    rest = [c for c in LINEITEM_COLS if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]
    order = order_sql(["l_shipdate", *rest], desc=keep_last)
    return f"""
SELECT {LI_SELECT} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem
) WHERE rn = 1
"""


@query("dedup_keep_last", _dedup_sql(True))
def dedup_keep_last(spark, sf):
    return dedup(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"], keep="last")


@query("dedup_keep_first", _dedup_sql(False))
def dedup_keep_first(spark, sf):
    return dedup(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"], keep="first")


FIRST_SNAPSHOT_SQL = f"""
SELECT {LI_SELECT} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order_sql(["l_shipdate", *LINEITEM_REST])}) AS rn
  FROM lineitem
) WHERE rn = 1
"""


@query("first_snapshot", FIRST_SNAPSHOT_SQL)
def first_snapshot_q(spark, sf):
    return first_snapshot(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


_FNN_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_FNN_COLS = ["l_shipdate", "l_quantity", "l_returnflag", "l_linestatus"]


def _fnn_sql():
    o = ", ".join(_FNN_ORDER)
    cols = ",\n  ".join(f"first({c} ORDER BY {o}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _FNN_COLS)
    return f"""
SELECT l_orderkey,
  {cols}
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
             nullif(l_returnflag, 'N') AS l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus, l_shipdate
      FROM lineitem)
GROUP BY l_orderkey
"""


@query("first_nonnull", _fnn_sql())
def first_nonnull_q(spark, sf):
    li = (table(spark, sf, "lineitem")
          .withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
          .withColumn("l_linestatus", F.nullif("l_linestatus", F.lit("O"))))
    return first_nonnull(li, ["l_orderkey"], _FNN_ORDER[:8], _FNN_COLS)


MERGE_SQL = """
WITH u AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority, 0 AS src
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority, 1 AS src
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
)
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY src DESC, o_orderdate DESC NULLS LAST,
         o_orderkey DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderpriority DESC NULLS LAST) AS rn
  FROM u
) WHERE rn = 1
"""


def merge_parts(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where(F.col("o_orderdate") < _ts("1998-01-01")).select("o_orderkey", "o_custkey", "o_orderdate",
                                                                     "o_totalprice")
    new = o.where(F.col("o_orderdate") >= _ts("1998-01-01")).select("o_orderkey", "o_custkey", "o_orderdate",
                                                                      "o_totalprice", "o_orderpriority")
    return old, new


@query("merge_keep_last", MERGE_SQL)
def merge_keep_last_q(spark, sf):
    old, new = merge_parts(spark, sf)
    return merge_keep_last(old, new, ["o_custkey"], ["o_orderdate"]).select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")


@query("cap_per_user", """
SELECT event_id, user_id, value, CAST(rn AS INTEGER) AS rank FROM (
  SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
  FROM events
) WHERE rn <= 3
""")
def cap_per_user(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return cap_per_key(ev, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3, rank_col="rank")


@query("pack_batches", """
WITH d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS rn FROM d)
SELECT CAST((rn - 1) // 50 AS BIGINT) AS batch_no, count(*) AS batch_size,
       string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_custkey) AS ids
FROM r GROUP BY 1
""")
def pack_batches_q(spark, sf):
    return pack_batches(table(spark, sf, "orders"), "o_custkey", 50)


_RAW_COUNT_SQL = """CASE event_type WHEN 'error' THEN 'abc'
         WHEN 'click' THEN json_extract_string(props, '$.k') || '.0'
         WHEN 'view' THEN printf('%.2f', value)
         WHEN 'signup' THEN NULL
         ELSE json_extract_string(props, '$.k') END"""


@query("to_count", f"""
SELECT event_id, raw, coalesce(CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT), 0) AS n
FROM (SELECT event_id, {_RAW_COUNT_SQL} AS raw FROM events)
""")
def to_count_q(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    raw = (F.when(F.col("event_type") == "error", F.lit("abc"))
           .when(F.col("event_type") == "click", F.concat(k, F.lit(".0")))
           .when(F.col("event_type") == "view", F.format_string("%.2f", F.col("value")))
           .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
           .otherwise(k))
    return ev.select("event_id", raw.alias("raw")).withColumn("n", to_count("raw"))


_ISO_RE = r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def _iso_sql():
    parts = [f"coalesce(TRY_CAST(nullif(regexp_extract(duration_text, '{_ISO_RE}', {i}), '') AS BIGINT), 0)"
             for i in range(1, 6)]
    return f"""
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, duration_text,
       CAST({parts[0]} * 604800 + {parts[1]} * 86400 + {parts[2]} * 3600 + {parts[3]} * 60 + {parts[4]} AS BIGINT)
         AS duration_seconds
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
        CASE WHEN l_returnflag = 'N' THEN 'PT' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'M'
                                           || CAST(l_linenumber AS VARCHAR) || 'S'
             WHEN l_returnflag = 'R' THEN 'P' || CAST(l_linenumber AS VARCHAR) || 'DT'
                                           || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'H'
             WHEN l_linestatus = 'F' THEN 'bad'
             ELSE 'P' || CAST(l_linenumber AS VARCHAR) || 'W' END AS duration_text
      FROM lineitem)
"""


@query("iso_duration", _iso_sql())
def iso_duration(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber").cast("string")
    text = (F.when(F.col("l_returnflag") == "N", F.concat(F.lit("PT"), q, F.lit("M"), n, F.lit("S")))
            .when(F.col("l_returnflag") == "R", F.concat(F.lit("P"), n, F.lit("DT"), q, F.lit("H")))
            .when(F.col("l_linestatus") == "F", F.lit("bad"))
            .otherwise(F.concat(F.lit("P"), n, F.lit("W"))))
    d = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", text.alias("duration_text"))
    return d.withColumn("duration_seconds", iso_duration_seconds("duration_text"))


@query("parse_timestamps", """
SELECT event_id, ts_text, try_strptime(ts_text, '%Y-%m-%dT%H:%M:%S') AS parsed
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' ELSE '' END
                       || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_text FROM events)
""")
def parse_timestamps(spark, sf):
    ev = table(spark, sf, "events")
    text = F.concat(F.when(F.col("event_type") == "error", F.lit("x")).otherwise(F.lit("")),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return ev.select("event_id", text.alias("ts_text")).withColumn("parsed", parse_timestamp("ts_text"))


@query("merge_keep_first", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL
SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
""")
def merge_keep_first_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    old = o.where(F.col("o_orderdate") < _ts("1998-01-01")).drop("o_orderdate")
    new = o.where(F.col("o_orderdate") >= _ts("1997-01-01")).select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    return merge_keep_first(old, new, ["o_orderkey"])
