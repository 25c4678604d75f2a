"""Keep-first/last, first-non-null, upsert and insert-or-ignore operators
(W1-W9, U1-U3, K4, J6-J8).

File order has no meaning in Spark, so every keep-first/last takes an
explicit order and completes it with all remaining columns: the result does
not depend on partitioning. ``row_number() <= n`` is planned as a
WindowGroupLimit, which trims each partition before the shuffle-sorted
window runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_rank


def _ord(c):
    return F.col(c) if isinstance(c, str) else c


def total_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                descending: bool = False) -> list[Column]:
    """``order`` followed by every other column, so ties cannot fall to chance."""
    used = set(keys) | {o for o in order if isinstance(o, str)}
    rest = [c for c in df.columns if c not in used]
    cols = [_ord(o) for o in order] + [F.col(c) for c in rest]
    if descending:
        return [c.desc_nulls_last() for c in cols]
    return [c.asc_nulls_last() for c in cols]


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order`` (W8); ``order`` must be total."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_vm_rn", rn).where(F.col("_vm_rn") <= n)
    return out.withColumnRenamed("_vm_rn", rank_col) if rank_col else out.drop("_vm_rn")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = (), keep: str = "first") -> DataFrame:
    """One row per key: the first (``keep="first"``) or last row in ``order``,
    ties broken by all remaining columns (W1, W2)."""
    o = total_order(df, keys, order, descending=(keep == "last"))
    return cap_per_key(df, keys, o, 1)


def first_snapshot(df: DataFrame, key: str, time_col: str) -> DataFrame:
    """First snapshot row per entity (W3): earliest ``time_col``, NULL times last."""
    return dedup(df, [key], [time_col], keep="first")


def first_nonnull(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``sort_values(order).groupby(keys).first()`` (W4): per column the first
    non-NULL value in ``order``; one aggregate, no window. The ordering
    struct is built once; ``min_by`` with a FILTER skips NULL values."""
    rest = [c for c in df.columns if c not in set(keys) | set(order)]
    ords = [*order, *rest]
    d = df.withColumn("_vm_ord", F.struct(*[F.col(c) for c in ords]))
    aggs = [F.expr(f"min_by(`{c}`, _vm_ord) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in cols]
    return d.groupBy(*keys).agg(*aggs)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct."""
    return df.distinct()


def surrogate_key(values: DataFrame, col: str, key_name: str) -> DataFrame:
    """Dense 1..n key over the sorted distinct non-NULL values."""
    d = values.select(col).where(F.col(col).isNotNull()).distinct()
    return global_rank(d, [col], name=key_name).select(F.col(key_name).cast("int"), col)


def extend_keys(known: DataFrame, values: DataFrame, col: str, key_name: str) -> DataFrame:
    """Keys for the values that ``known`` (key_name, col) does not hold yet (W6): numbered in sorted
    order above the greatest key given so far, so no key that was given out ever changes. Only the
    distinct unseen values are ranked; the greatest key is a scalar subquery."""
    new = new_only(values.select(col).where(F.col(col).isNotNull()).distinct(), known, [col])
    top = F.coalesce(known.agg(F.max(key_name).cast("bigint")).scalar(), F.lit(0))
    return global_rank(new, [col], name="_vm_rank").select((F.col("_vm_rank") + top).alias(key_name), col)


def pack_batches(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Distinct sorted ids packed into request batches of ``size`` (W9, U3):
    batch_no, batch_size, ids (comma-joined in id order). Each batch holds at
    most ``size`` ids, so the collect per group is bounded."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = global_rank(ids, [key], name="_vm_rank")
    b = ranked.withColumn("batch_no", F.floor((F.col("_vm_rank") - 1) / size).cast("bigint"))
    return b.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("ids"))


def append_union(*dfs: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side becomes NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def merge_keep_last(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Upsert: union, then per key the row from the newest source wins, then
    the latest in ``order`` (U2)."""
    u = append_union(old.withColumn("_vm_src", F.lit(0)), new.withColumn("_vm_src", F.lit(1)))
    return dedup(u, keys, ["_vm_src", *order], keep="last").drop("_vm_src")


def merge_keep_first(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Union, then per key the existing row wins (first discovery kept)."""
    u = append_union(old.withColumn("_vm_src", F.lit(0)), new.withColumn("_vm_src", F.lit(1)))
    return dedup(u, keys, ["_vm_src", *order], keep="first").drop("_vm_src")


def new_only(batch: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``existing``."""
    return batch.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order: Sequence[Column | str] = ()) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING (K4): the rows to append — the batch
    deduplicated on the key (first wins), minus keys already in ``target``.
    ``target`` must be a fixed snapshot so re-running the batch adds 0 rows."""
    return new_only(dedup(batch, keys, order, keep="first"), target, keys)


def membership_flag(df: DataFrame, key: str, members: DataFrame, member_key: str | None = None,
                    name: str = "is_member") -> DataFrame:
    """``key in set`` as 0/1 (J8): left join on the distinct member keys."""
    mk = member_key or key
    m = members.select(F.col(mk).alias("_vm_k")).where(F.col("_vm_k").isNotNull()).distinct() \
        .withColumn("_vm_hit", F.lit(1))
    return (df.join(m, df[key] == m["_vm_k"], "left")
            .withColumn(name, F.coalesce(F.col("_vm_hit"), F.lit(0)).cast("int"))
            .drop("_vm_k", "_vm_hit"))
