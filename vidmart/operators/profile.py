"""Data-profile operators (A12-A24). Each profile is ONE aggregate over all
requested columns (never a job per column); multi-column profiles unpivot
first so a single distributed sort serves every quantile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import quantile_columns, quantiles_with


def value_counts(df: DataFrame, col: str, dropna: bool = True, name: str = "count") -> DataFrame:
    """Rows per value, largest first, ties by value; NULL dropped unless asked."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    return d.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def with_share(grouped: DataFrame, count_col: str, name: str = "pct", scale: float = 100.0) -> DataFrame:
    """count / total * scale. The total is a scalar subquery over the grouped
    frame (evaluated once, no join, no single-partition window)."""
    total = grouped.agg(F.sum(count_col)).scalar()
    return grouped.withColumn(name, F.col(count_col).cast("double") * F.lit(scale) / total)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column, long form (column, null_count)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count")


def minmax_profile(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """(column, min, max) for numeric columns, time columns given as numbers."""
    aggs = []
    for k, c in cols.items():
        aggs += [F.min(c).cast("double").alias(f"{k}__min"), F.max(c).cast("double").alias(f"{k}__max")]
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("column"), F.col(f"{k}__min").alias("min"), F.col(f"{k}__max").alias("max"))
        for k in cols])).alias("s"))
    return long.select("s.*")


def duplicate_count(df: DataFrame, subsets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows minus distinct rows, per key subset; ``count(DISTINCT struct)``
    keeps NULL-bearing keys (plain multi-column DISTINCT would skip them)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for name, cols in subsets.items():
        aggs.append(F.count_distinct(F.struct(*[F.col(c) for c in cols])).alias(name))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("subset"), F.col("_n").alias("n_rows"),
                 (F.col("_n") - F.col(name)).alias("n_duplicates")) for name in subsets])).alias("s")).select("s.*")


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(list(by), list(cols), "column", "value")


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), method: str = "select") -> DataFrame:
    """pandas ``describe()`` per column (and per group): count, mean, sample
    std, min, quartiles (linear), max, plus missing and zero counts.

    ``method="select"``: moments and quantile sketches of all columns come from one wide
    aggregate, the quartiles from exact counts in narrow brackets; no value is moved but those
    in a bracket. ``method="sort"`` unpivots and sorts all values."""
    keys = [*by, "column"]
    names = ("count", "mean", "std", "min", "max", "n_missing", "n_zero")

    def moments_of(c: str) -> list[Column]:
        v = F.col(c).cast("double")
        return [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v), F.count_if(v.isNull()), F.count_if(v == 0)]

    if method == "sort":
        long = _long(df, cols, by)
        moments = long.groupBy(*keys).agg(*[x.alias(k) for k, x in zip(names, moments_of("value"), strict=True)])
        qs = quantile_columns(long, "value", QUARTILES, keys, method=method)
    else:
        aggs = [x.alias(f"{k}__{i}") for i, c in enumerate(cols) for k, x in zip(names, moments_of(c), strict=True)]
        wide, long = quantiles_with(df, {c: F.col(c) for c in cols}, list(QUARTILES.values()), by, aggs)
        rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}__{i}").alias(k) for k in names]) for i, c in enumerate(cols)])
        moments = wide.select(*by, F.explode(rows).alias("_vm_x")).select(*by, "_vm_x.*")
        qs = long.groupBy(*by, F.col("_vm_c").alias("column")).agg(
            *[F.max(F.when(F.col("_vm_p") == F.lit(p), F.col("value"))).alias(k) for k, p in QUARTILES.items()])
    return moments.join(qs, [moments[k].eqNullSafe(qs[k]) for k in keys], "left") \
        .select(*[moments[k] for k in keys], "count", "mean", "std", "min", *QUARTILES, "max", "n_missing", "n_zero")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair over pairwise-complete
    rows, long form (col_a, col_b, corr). One scan: each row is exploded into
    its n(n+1)/2 (pair, x, y) triples, masked to the rows where both values
    exist, and a grouped covar_pop/var_pop aggregate (partial aggregation,
    one tiny shuffle) serves all pairs; this keeps the generated aggregate
    small instead of 3 aggregates per pair in one wide row. Zero variance
    gives NULL (``corr`` would raise under ANSI)."""
    triples, pairs = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            triples.append(F.struct(F.lit(len(pairs)).alias("p"), F.when(both, x).alias("x"),
                                    F.when(both, y).alias("y")))
            pairs.append((a, b))
    t = df.select(F.explode(F.array(*triples)).alias("t")).select("t.*")
    g = t.groupBy("p").agg(F.covar_pop("x", "y").alias("cv"), F.var_pop("x").alias("vx"),
                           F.var_pop("y").alias("vy"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    g = g.withColumn("a", names[F.col("p")]["a"]).withColumn("b", names[F.col("p")]["b"])
    den = F.sqrt("vx") * F.sqrt("vy")
    r = F.when(den > 0, F.col("cv") / den)
    # greatest/least skip NULLs, so clamp only a defined value
    g = g.withColumn("corr", F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))))
    both_ways = F.array(F.struct(F.col("a").alias("col_a"), F.col("b").alias("col_b")),
                        F.struct(F.col("b").alias("col_a"), F.col("a").alias("col_b")))
    out = g.select(F.explode(F.array_distinct(both_ways)).alias("k"), "corr")
    return out.select("k.col_a", "k.col_b", "corr")


def histogram(df: DataFrame, col: str | Column, bins: int = 50, log10: bool = False,
              by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width histogram between the (per-group) min and max; the last
    bin is closed on the right. Output (by..., bin, lo, hi, count)."""
    v = F.col(col) if isinstance(col, str) else col
    v = v.cast("double")
    if log10:
        v = F.log10(v + F.lit(1.0))
    d = df.select(*by, v.alias("_vm_v")).where(F.col("_vm_v").isNotNull())
    if by:
        rng = d.groupBy(*by).agg(F.min("_vm_v").alias("_vm_mn"), F.max("_vm_v").alias("_vm_mx"))
        j = d.join(rng, list(by))
    else:  # global range as scalar subqueries: no join at all
        j = d.withColumn("_vm_mn", d.agg(F.min("_vm_v")).scalar()) \
             .withColumn("_vm_mx", d.agg(F.max("_vm_v")).scalar())
    width = F.col("_vm_mx") - F.col("_vm_mn")
    raw = F.floor((F.col("_vm_v") - F.col("_vm_mn")) / width * F.lit(bins)) + 1
    b = F.when(width == 0, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")
    h = j.withColumn("bin", b).groupBy(*by, "bin", "_vm_mn", "_vm_mx").agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("_vm_mx") - F.col("_vm_mn")) / F.lit(bins)
    return h.select(*by, "bin", (F.col("_vm_mn") + (F.col("bin") - 1) * w).alias("lo"),
                    (F.col("_vm_mn") + F.col("bin") * w).alias("hi"), "count")


def box_stats(df: DataFrame, col: str | Column, by: Sequence[str] = (), whisker: float = 1.5,
              method: str = "select") -> DataFrame:
    """Box-plot numbers per group: n, q1, median, q3, whiskers at
    ``whisker``*IQR clipped to the data, and the outlier count.
    First exact quartiles, then the per-group bounds are joined back (one
    small row per group) for conditional min/max."""
    v = F.col(col) if isinstance(col, str) else col
    d = df.select(*by, v.cast("double").alias("_vm_v")).where(F.col("_vm_v").isNotNull())
    q = quantile_columns(d, "_vm_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, method=method)
    q = q.withColumn("_vm_lo", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))) \
         .withColumn("_vm_hi", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    if by:
        j = d.join(q, list(by))
    else:
        j = d
        for c in ("q1", "median", "q3", "_vm_lo", "_vm_hi"):
            j = j.withColumn(c, q.select(c).scalar())
    inside = (F.col("_vm_v") >= F.col("_vm_lo")) & (F.col("_vm_v") <= F.col("_vm_hi"))
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_vm_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_vm_v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))
