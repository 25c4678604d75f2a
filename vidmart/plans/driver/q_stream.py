"""Driver queries: streaming ingest (R1-R5). Each stream reads files that
Spark lands from the driver tables (sliced by time, one slice per trigger),
runs to completion with ``availableNow`` and returns the sink table; the
oracle is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...session import scratch_path
from ...streaming import late as LT
from ...streaming import parts as PT
from ...streaming import stream as ST
from .q_ingest import INSERT_IGNORE_SQL, MERGE_SQL, insert_ignore_parts, merge_parts
from .registry import query, r6, table


def time_slices(df, ts: str, n: int):
    """Slice number 0..n-1 by equal time ranges (two scalars from one aggregate)."""
    day = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = df.agg(F.min(day), F.max(day)).first()
    width = max(hi - lo + 1, 1)
    return F.least(F.floor((day - F.lit(lo)) * n / F.lit(width)), F.lit(n - 1)).cast("int")


@query("stream_snapshot_dedup", "SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem")
def stream_snapshot_dedup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_extendedprice")
    src, tgt = scratch_path(spark, "land-snapshots"), scratch_path(spark, "sink-snapshots")
    per = ST.land_in_slices(li, src, time_slices(li, "l_shipdate", 4), 4)
    out = ST.stream_insert_ignore(spark, src, li.schema, tgt, ["l_orderkey", "l_shipdate"],
                                  order=["l_linenumber", "l_extendedprice"], files_per_trigger=per,
                                  partition=("snapshot_year", F.year("l_shipdate")))
    return out.select("l_orderkey", "l_shipdate")


@query("stream_insert_ignore", INSERT_IGNORE_SQL)
def stream_insert_ignore(spark, sf):
    """The target is the first commit; each batch asks the key filters of the parts before it reads any."""
    target, batch = insert_ignore_parts(spark, sf)
    root, src = scratch_path(spark, "sink-orders"), scratch_path(spark, "land-orders")
    PT.insert_new_sink(root, ["o_orderkey"], stream="load")(target.withColumn("src", F.lit("target")), 0)
    b = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate") \
        .where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    b = b.withColumn("src", F.lit("batch"))
    per = ST.land_in_slices(b, src, time_slices(b, "o_orderdate", 3), 3, drop=["o_orderdate"])
    schema = b.drop("o_orderdate").schema
    ST.run_available(ST.file_stream(spark, src, schema, per), PT.insert_new_sink(root, ["o_orderkey"]), scratch_path(spark, "ckpt-insert"))
    return PT.read_parts(spark, root, PT.ROWS, schema).select("o_orderkey", "o_custkey", "o_totalprice", "src")


@query("stream_latest", MERGE_SQL)
def stream_latest(spark, sf):
    old, new = merge_parts(spark, sf)
    root, src = scratch_path(spark, "sink-channels"), scratch_path(spark, "land-channels")
    old = old.withColumn("o_orderpriority", F.lit(None).cast("string")).select(*new.columns)
    PT.upsert_levels_sink(root, ["o_custkey"], ["o_orderdate"], stream="load")(old, 0)
    per = ST.land_in_slices(new, src, time_slices(new, "o_orderdate", 3), 3)
    ST.run_available(ST.file_stream(spark, src, new.schema, per), PT.upsert_levels_sink(root, ["o_custkey"], ["o_orderdate"]), scratch_path(spark, "ckpt-upsert"))
    out = PT.read_levels(spark, root, new.schema, ["o_custkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")


@query("stream_quarantine", """
SELECT event_id, CASE WHEN value IS NULL OR NOT value > 5 THEN 'low_value' END AS low_value,
       CASE WHEN event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase') THEN 'other_type' END AS other_type
FROM events
""")
def stream_quarantine(spark, sf):
    """K6 on a stream: events that fail a rule are set aside with the rules' names, in the commit of the good ones."""
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    src, root = scratch_path(spark, "land-events"), scratch_path(spark, "quarantine")
    per = ST.land_in_slices(ev, src, time_slices(ev, "ts", 3), 3)
    rules = {"low_value": F.col("value") > 5, "other_type": F.col("event_type").isin("click", "view", "purchase")}
    ST.run_available(ST.file_stream(spark, src, ev.schema, per), PT.quarantine_sink(root, rules), scratch_path(spark, "ckpt-quarantine"))
    good = PT.read_parts(spark, root, PT.GOOD, ev.schema).select("event_id", F.array().cast("array<string>").alias(PT.FAILED))
    both = good.unionByName(PT.read_rejects(spark, root, ev.schema).select("event_id", PT.FAILED))
    return both.select("event_id", *[F.when(F.array_contains(PT.FAILED, r), r).alias(r) for r in rules])


# Events arrive in three batches by event_id mod 3, every seventh once more in the last; Spark holds late what lies
# at or before the watermark of the previous batch: the greatest time (in milliseconds) before that one, less the delay.
LATE_SQL = """
WITH a AS (SELECT event_id, ts, event_id % 3 AS b FROM events WHERE ts IS NOT NULL
           UNION ALL SELECT event_id, ts, 2 FROM events WHERE ts IS NOT NULL AND event_id % 7 = 0),
top AS (SELECT b, date_trunc('millisecond', max(ts)) AS mx FROM a GROUP BY b),
w AS (SELECT b.b, (SELECT max(mx) FROM top t WHERE t.b < b.b - 1) - INTERVAL 5 DAY AS mark FROM (SELECT DISTINCT b FROM a) b),
r AS (SELECT a.b, event_id, coalesce(ts <= mark, FALSE) AS late FROM a JOIN w ON w.b = a.b),
k AS (SELECT event_id, min(b) AS b FROM r WHERE NOT late GROUP BY 1)
SELECT r.b AS batch_id, count(*) AS n_arrived, count(*) FILTER (WHERE late) AS n_late,
       (SELECT count(*) FROM k WHERE k.b = r.b) AS n_kept,
       count(*) FILTER (WHERE NOT late) - (SELECT count(*) FROM k WHERE k.b = r.b) AS n_duplicates
FROM r GROUP BY r.b
"""


@query("stream_late_audit", LATE_SQL)
def stream_late_audit(spark, sf):
    """R1 with bounded state: rows that the watermark discards are counted, batch by batch."""
    ev = table(spark, sf, "events").where(F.col("ts").isNotNull()).select("event_id", "ts")
    first, last = (F.col("event_id") % 3).cast("int"), F.lit(2)
    src, root = scratch_path(spark, "land-events"), scratch_path(spark, "sink-late")
    landed = ev.withColumn("_b", F.explode(F.when(F.col("event_id") % 7 == 0, F.array(first, last)).otherwise(F.array(first))))
    per = ST.land_in_slices(landed, src, F.col("_b"), 3, drop=["_b"])
    _, audit = LT.stream_within_watermark(spark, src, landed.drop("_b").schema, root, ["event_id"], "ts", "5 days",
                                          files_per_trigger=per)
    return audit.select("batch_id", "n_arrived", "n_late", "n_duplicates", "n_kept")


@query("stream_stable_keys", """
WITH first AS (SELECT o_custkey, min(CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0
                                          WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END) AS b
               FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
SELECT o_custkey, row_number() OVER (ORDER BY b, o_custkey) AS channel_key FROM first
""")
def stream_stable_keys(spark, sf):
    """W6 kept current: a batch's unseen values get the next keys, those of earlier ones stay as they are."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    root = scratch_path(spark, "channel-keys")
    sink = PT.key_sink(root, "o_custkey", "channel_key")
    d = F.col("o_orderdate")
    first, second = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1997-01-01"))
    batch = F.when(d < first, 0).when(d < second, 1).otherwise(2)
    for i in range(3):
        sink(o.where(batch == i), i)
    return PT.read_keys(spark, root, "o_custkey", o.schema["o_custkey"].dataType, "channel_key")


HOURLY_SQL = """
SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n_events, round(sum(value), 6) AS total_value
FROM events WHERE ts IS NOT NULL GROUP BY 1
"""


@query("hourly_activity", HOURLY_SQL)
def hourly_activity(spark, sf):
    ev = table(spark, sf, "events").where(F.col("ts").isNotNull())
    return ST.hourly_window_counts(ev, "ts", "value").withColumn("total_value", r6("total_value"))


@query("stream_hourly", HOURLY_SQL)
def stream_hourly(spark, sf):
    ev = table(spark, sf, "events").where(F.col("ts").isNotNull()).select("event_id", "ts", "value")
    src, root = scratch_path(spark, "land-events"), scratch_path(spark, "sink-hourly")
    per = ST.land_in_slices(ev, src, time_slices(ev, "ts", 4), 4)
    out = ST.stream_hourly(spark, src, ev.schema, root, "ts", "value", files_per_trigger=per)
    return out.withColumn("total_value", r6("total_value"))


@query("stream_hourly_unordered", HOURLY_SQL)
def stream_hourly_unordered(spark, sf):
    """Files dealt by hash, so every one holds events of all hours."""
    ev = table(spark, sf, "events").where(F.col("ts").isNotNull()).select("event_id", "ts", "value")
    src, root = scratch_path(spark, "land-events"), scratch_path(spark, "sink-hourly")
    per = ST.land_in_slices(ev, src, F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int"), 4)
    out = ST.stream_hourly(spark, src, ev.schema, root, "ts", "value", files_per_trigger=per)
    return out.withColumn("total_value", r6("total_value"))


@query("hourly_growth", f"""
WITH h AS ({HOURLY_SQL})
SELECT a.hour_start, a.n_events, CAST(b.n_events AS DOUBLE) AS prev_n_events,
       round((a.n_events - b.n_events) * 100.0 / b.n_events, 6) AS growth_pct
FROM h a LEFT JOIN h b ON b.hour_start = a.hour_start - INTERVAL 1 HOUR
""")
def hourly_growth(spark, sf):
    ev = table(spark, sf, "events").where(F.col("ts").isNotNull())
    g = ST.growth_vs_previous(ST.hourly_window_counts(ev, "ts", "value"))
    return g.select("hour_start", "n_events", "prev_n_events", r6("growth_pct").alias("growth_pct"))
