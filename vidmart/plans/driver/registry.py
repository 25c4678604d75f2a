"""Query catalogue: every key maps a driver-table role onto a
library operator; most keys carry an independent DuckDB SQL twin."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


# lineitem as the snapshot table: (l_orderkey, l_linenumber) is not unique,
# so every keep-first/last ends with all remaining columns.
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_REST = [c for c in LINEITEM_COLS if c not in ("l_orderkey", "l_shipdate")]


def order_sql(cols, desc=False):
    d = " DESC NULLS LAST" if desc else " ASC NULLS LAST"
    return ", ".join(c + d for c in cols)


def trend() -> Column:
    """Trending label role: a returned line."""
    return (F.col("l_returnflag") == "R").cast("int")


def r6(c: Column | str) -> Column:
    """Round to 6 decimals (float sums differ in the last bits between engines)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def sql_case(expr: str, mapping, default=None) -> str:
    """CASE expression for the DuckDB twin, built from the same fixed map."""
    whens = " ".join(f"WHEN {sql_lit(k)} THEN {sql_lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {sql_lit(default)} END)"


def half_even_sql(num: str, den: str, digits: int) -> str:
    """Exact half-even rounding of an integer ratio, as in numeric.round_ratio_half_even."""
    s = 10 ** digits
    n = f"(CAST({num} AS BIGINT) * {s})"
    d = f"CAST({den} AS BIGINT)"
    q = f"CAST(floor({n}::DOUBLE / {d}) AS BIGINT)"
    r = f"({n} - {q} * {d})"
    return (f"(CASE WHEN {d} > 0 THEN ({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 <> 0) "
            f"THEN 1 ELSE 0 END) / {float(s)} END)")
