"""Dashboard and notebook insight operators.

Grand totals are scalar subqueries (computed once, inlined as a value);
windows without a partition key only ever run over frames that are already
grouped or limited to a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Contingency counts with a fixed column domain; absent cells are 0
    (``pd.crosstab``). NULL row/column keys are dropped, as pandas does.
    One aggregate with a conditional count per column value (a ``pivot``
    would aggregate twice, with two shuffles)."""
    d = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return d.groupBy(row).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values])


def crosstab_pct(df: DataFrame, row: str, col: str, values: Sequence, names: Sequence[str] | None = None,
                 scale: float = 100.0) -> DataFrame:
    """Row-normalised contingency (``normalize="index"`` * 100)."""
    names = list(names or [str(v) for v in values])
    d = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    aggs = [F.count_if(F.col(col) == F.lit(v)).alias(f"_vm_c{i}") for i, v in enumerate(values)]
    g = d.groupBy(row).agg(F.count(F.lit(1)).alias("_vm_n"), *aggs)
    return g.select(row, *[(F.col(f"_vm_c{i}") * F.lit(scale) / F.col("_vm_n")).alias(n)
                           for i, n in enumerate(names)])


def label_impact(df: DataFrame, by: str | Column, label: str | Column, name: str | None = None) -> DataFrame:
    """Per group: sum, count and mean of a 0/1 label (NULL groups dropped)."""
    b = F.col(by) if isinstance(by, str) else by
    y = (F.col(label) if isinstance(label, str) else label).cast("int")
    key = name or (by if isinstance(by, str) else "group")
    d = df.select(b.alias(key), y.alias("_vm_y")).where(F.col(key).isNotNull())
    return d.groupBy(key).agg(F.sum("_vm_y").cast("bigint").alias("n_positive"),
                              F.count("_vm_y").alias("n"), F.avg("_vm_y").alias("rate"))


def group_mean(df: DataFrame, by: str, value: str | Column, name: str = "mean", scale: float = 1.0) -> DataFrame:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.where(F.col(by).isNotNull()).groupBy(by).agg((F.avg(v) * F.lit(scale)).alias(name))


def rate_vs_mean(grouped: DataFrame, rate_col: str, name: str = "above_mean") -> DataFrame:
    """Flag each group against the UNWEIGHTED mean of the group rates."""
    m = grouped.agg(F.avg(rate_col)).scalar()
    return grouped.withColumn("mean_rate", m).withColumn(name, (F.col(rate_col) > F.col("mean_rate")).cast("int"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``sort(...).head(k)``: planned as TakeOrderedAndProject (per-partition
    top-k, then a k-row merge). ``order`` must be total."""
    return df.orderBy(*order).limit(k)


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number a frame that is already limited to a few rows (top-N feed)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def complete_domain(spark: SparkSession, counts: DataFrame, key: str, domain: Sequence, fill=0,
                    value_cols: Sequence[str] = ("count",), ordinal: str = "ordinal") -> DataFrame:
    """Every value of a fixed domain in fixed order (``reindex(...).fillna(0)``);
    the domain is a literal frame, the counts join onto it."""
    values = F.array(*[F.lit(v) for v in domain])
    dom = spark.range(len(domain)).select(F.col("id").cast("int").alias(ordinal),
                                          values[F.col("id").cast("int")].alias(key))
    j = dom.join(counts, key, "left")
    return j.select(ordinal, key, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in value_cols])


def topn_totals(feed: DataFrame, rank_col: str, ns: Sequence[int], views: str, likes: str, comments: str) -> DataFrame:
    """Totals over the first N rows of a ranked feed, for several N at once:
    sums, engagement (likes+comments)/views (0 without views) and the growth
    estimate clamp(1000*engagement, 1, 99)."""
    nmax = max(ns)
    top = feed.where(F.col(rank_col) <= nmax)
    arr = F.array(*[F.lit(n) for n in ns])
    x = top.select("*", F.explode(arr).alias("top_n")).where(F.col(rank_col) <= F.col("top_n"))
    g = x.groupBy("top_n").agg(F.count(F.lit(1)).alias("n_videos"),
                               F.sum(views).alias("total_views"), F.sum(likes).alias("total_likes"),
                               F.sum(comments).alias("total_comments"))
    eng = F.coalesce(F.try_divide(F.col("total_likes") + F.col("total_comments"), F.col("total_views")), F.lit(0.0))
    eng = F.when(F.col("total_views") == 0, F.lit(0.0)).otherwise(eng)
    return g.withColumn("engagement", eng) \
        .withColumn("growth_est", F.least(F.lit(99.0), F.greatest(F.lit(1.0), F.col("engagement") * 1000)))
