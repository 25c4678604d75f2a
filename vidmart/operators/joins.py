"""Equi-join helpers (J3, J5, J9). The strategy is left to Catalyst/AQE:
a dimension whose scan statistics are under
``spark.sql.autoBroadcastJoinThreshold`` is broadcast, anything larger is a
shuffle join — the size check is Spark's own, never a hint on an unbounded
side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(df: DataFrame, key: str, dim: DataFrame, dim_key: str, values: Mapping[str, str],
                default: object = None) -> DataFrame:
    """``Series.map(dim)`` with a default: left join on the (distinct) dimension
    key, renaming ``values`` {dim column: output name}."""
    d = dim.select(F.col(dim_key).alias("_vm_dk"), *[F.col(c).alias(f"_vm_{n}") for c, n in values.items()])
    j = df.join(d, df[key] == d["_vm_dk"], "left").drop("_vm_dk")
    for n in values.values():
        c = F.col(f"_vm_{n}")
        j = j.withColumn(n, c if default is None else F.coalesce(c, F.lit(default))).drop(f"_vm_{n}")
    return j


def left_chain(base: DataFrame, steps: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """base ⟕ d1 ⟕ d2 ... on shared column names; each right side should be
    unique on its key (dedup it first), so no row is multiplied."""
    out = base
    for dim, key in steps:
        out = out.join(dim, key, "left")
    return out


def inner_complete(df: DataFrame, other: DataFrame, key: str | Sequence[str], required: Sequence[str]) -> DataFrame:
    """Join, then drop rows missing any of ``required`` (merge + dropna, J5)."""
    return df.join(other, key, "inner").dropna(subset=list(required))
