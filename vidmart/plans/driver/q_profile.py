"""Driver queries: profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.insight import top_k
from ...operators.profile import (box_stats, corr_matrix, describe_numeric, duplicate_count, histogram,
                                  minmax_profile, null_profile, value_counts, with_share)
from ...operators.ranking import quantile_columns
from .registry import LINEITEM_COLS, query, r6, table, trend


@query("value_counts_topic", """
SELECT o_orderpriority AS topic, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def value_counts_topic(spark, sf):
    return value_counts(table(spark, sf, "orders"), "o_orderpriority").withColumnRenamed("o_orderpriority", "topic")


@query("class_share", """
SELECT CAST(l_returnflag = 'R' AS INTEGER) AS is_trending, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM lineitem GROUP BY 1
""")
def class_share(spark, sf):
    g = value_counts(table(spark, sf, "lineitem").select(trend().alias("is_trending")), "is_trending", name="n")
    return with_share(g, "n").withColumn("pct", r6("pct"))


@query("topic_top10", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10
""")
def topic_top10(spark, sf):
    g = value_counts(table(spark, sf, "orders"), "o_custkey", name="n")
    return top_k(g, [F.col("n").desc(), F.col("o_custkey")], 10)


@query("topic_nunique_top10", """
SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_topics FROM orders GROUP BY 1
ORDER BY n_topics DESC, o_custkey LIMIT 10
""")
def topic_nunique_top10(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_topics"))
    return top_k(g, [F.col("n_topics").desc(), F.col("o_custkey")], 10)


@query("region_dist_top15", """
SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1
ORDER BY n DESC, l_suppkey LIMIT 15
""")
def region_dist_top15(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return top_k(value_counts(pairs, "l_suppkey", name="n"), [F.col("n").desc(), F.col("l_suppkey")], 15)


@query("dataset_overview", """
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_videos, count(DISTINCT l_partkey) AS n_parts,
       count(DISTINCT l_suppkey) AS n_suppliers, min(l_shipdate) AS first_snapshot, max(l_shipdate) AS last_snapshot
FROM lineitem
""")
def dataset_overview(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_videos"),
        F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"),
        F.min("l_shipdate").alias("first_snapshot"), F.max("l_shipdate").alias("last_snapshot"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _minmax_sql():
    parts = [f"SELECT '{c}' AS column, CAST(min({c}) AS DOUBLE) + 0.0 AS min, CAST(max({c}) AS DOUBLE) + 0.0 AS max "
             f"FROM lineitem" for c in _NUM]
    parts.append("SELECT 'l_shipdate_day' AS column, "
                 "CAST(min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS min, "
                 "CAST(max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS max "
                 "FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@query("minmax_profile", _minmax_sql())
def minmax_profile_q(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = {c: F.col(c) for c in _NUM}
    cols["l_shipdate_day"] = F.unix_date(F.to_date("l_shipdate"))
    p = minmax_profile(li, cols)
    return p.select("column", (F.col("min") + F.lit(0.0)).alias("min"), (F.col("max") + F.lit(0.0)).alias("max"))


_NULLED = {"l_orderkey": "l_orderkey", "l_quantity": "l_quantity", "l_discount": "nullif(l_discount, 0.0)",
           "l_returnflag": "nullif(l_returnflag, 'N')", "l_linestatus": "nullif(l_linestatus, 'O')",
           "l_shipdate": "l_shipdate"}


def _null_sql():
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS column, count(*) FILTER (WHERE {e} IS NULL) AS null_count FROM lineitem"
                                for c, e in _NULLED.items())


@query("null_profile", _null_sql())
def null_profile_q(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"), "l_shipdate")
    return null_profile(li)


_SUBSETS = {"full_row": LINEITEM_COLS, "snapshot_key": ["l_orderkey", "l_linenumber"], "video": ["l_orderkey"]}


def _dup_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS subset, (SELECT count(*) FROM lineitem) AS n_rows, "
        f"(SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM lineitem)) "
        f"AS n_duplicates" for n, c in _SUBSETS.items())


@query("duplicate_counts", _dup_sql())
def duplicate_counts(spark, sf):
    return duplicate_count(table(spark, sf, "lineitem"), _SUBSETS)


_DESC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(cols, by=None, src="lineitem"):
    sel_by = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return "\nUNION ALL\n".join(f"""SELECT {sel_by}'{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) + 0.0 AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) + 0.0 AS max,
  count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) FILTER (WHERE {c} = 0) AS n_zero FROM {src}{grp}"""
                                for c in cols)


def _round_describe(d):
    out = d
    for c in ("mean", "std", "p25", "p50", "p75"):
        out = out.withColumn(c, r6(c))
    for c in ("min", "max"):
        out = out.withColumn(c, r6(c) + F.lit(0.0))
    return out


@query("describe_global", _describe_sql(_DESC))
def describe_global(spark, sf):
    return _round_describe(describe_numeric(table(spark, sf, "lineitem"), _DESC))


@query("describe_by_trending", _describe_sql(["l_extendedprice", "l_quantity"], "is_trending",
                                             "(SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS is_trending "
                                             "FROM lineitem)"))
def describe_by_trending(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("is_trending", trend())
    return _round_describe(describe_numeric(li, ["l_extendedprice", "l_quantity"], by=["is_trending"]))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "is_trending", "constant"]


def _corr_sql():
    src = "(SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS is_trending, l_quantity * 0 AS constant FROM lineitem)"
    parts = []
    for a in _CORR:
        for b in _CORR:
            c = f"corr({a}, {b})"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL "
                         f"ELSE greatest(-1.0, least(1.0, {c})) END, 6) AS corr FROM {src}")
    return "\nUNION ALL\n".join(parts)


@query("corr_matrix", _corr_sql())
def corr_matrix_q(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("is_trending", trend()) \
        .withColumn("constant", F.col("l_quantity") * 0)
    return corr_matrix(li, _CORR).withColumn("corr", r6("corr"))


@query("histogram_value", """
WITH r AS (SELECT min(value) AS mn, max(value) AS mx FROM events WHERE value IS NOT NULL),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 1 ELSE least(floor((value - mn) / (mx - mn) * 50) + 1, 50) END AS INTEGER)
             AS bin, mn, mx FROM events, r WHERE value IS NOT NULL)
SELECT bin, round(mn + (bin - 1) * ((mx - mn) / 50), 6) AS lo, round(mn + bin * ((mx - mn) / 50), 6) AS hi,
       count(*) AS count
FROM b GROUP BY bin, mn, mx
""")
def histogram_value(spark, sf):
    h = histogram(table(spark, sf, "events"), "value", bins=50)
    return h.withColumn("lo", r6("lo")).withColumn("hi", r6("hi"))


def _box_sql(expr, where):
    return f"""
WITH e AS (SELECT event_type, {expr} AS v FROM events WHERE {where}),
q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3
      FROM e GROUP BY 1)
SELECT e.event_type, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
       round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_lo,
       round(max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
       count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM e JOIN q ON e.event_type = q.event_type
GROUP BY e.event_type, q1, med, q3
"""


def _round_box(b):
    for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi"):
        b = b.withColumn(c, r6(c))
    return b


@query("box_stats", _box_sql("value", "value IS NOT NULL AND event_type IS NOT NULL"))
def box_stats_q(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type").isNotNull())
    return _round_box(box_stats(ev, "value", by=["event_type"]))


@query("log_boxplot", _box_sql("log10(value)", "value > 0 AND event_type IS NOT NULL"))
def log_boxplot(spark, sf):
    ev = table(spark, sf, "events").where((F.col("value") > 0) & F.col("event_type").isNotNull())
    return _round_box(box_stats(ev, F.log10("value"), by=["event_type"]))


@query("trim_p99", """
SELECT event_id, event_type, value FROM events
WHERE value <= (SELECT quantile_cont(value, 0.99) FROM events)
""")
def trim_p99(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    thr = quantile_columns(ev, "value", {"p99": 0.99}).select("p99").scalar()
    return ev.where(F.col("value") <= thr)
