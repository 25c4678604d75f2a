"""Global numbering, running totals and exact quantiles without a
single-partition window.

A window with an ORDER BY but no PARTITION BY moves every row into one
task. Here the data is range-partitioned on the order key (plus a salt so a
hot key still spreads over many tasks), sorted inside each partition and
checkpointed to the shared checkpoint folder, which fixes partition
contents for the two passes that follow:

1. per-partition counts / sums (one small row per partition), turned into
   partition offsets on the driver-free small frame;
2. per-row position = offset + position inside the partition.

Checkpointing (not ``localCheckpoint``) keeps the result valid when an
executor is lost between the passes.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path

_PID, _MID, _SALT = "_vm_pid", "_vm_mid", "_vm_salt"


def _cols(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _ranged(df: DataFrame, order: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_root(spark)
    order = _cols(order)
    salted = df.withColumn(_SALT, F.monotonically_increasing_id())
    keys = [*order, F.col(_SALT)]
    # without an explicit count AQE may merge neighbouring ranges (it only
    # coalesces contiguous partitions, so range order is kept)
    ranged = (salted.repartitionByRange(num_partitions, *keys) if num_partitions
              else salted.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    fixed = ranged.checkpoint(eager=True)
    # the checkpoint keeps the source's attribute ids; fresh aliases let the
    # result be joined back to frames of the same lineage (e.g. box_stats)
    fixed = fixed.select(*[F.col(c).alias(c) for c in fixed.columns])
    return (fixed.withColumn(_PID, F.spark_partition_id().cast("bigint"))
            .withColumn(_MID, F.monotonically_increasing_id()))


def _offsets(tagged: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Exclusive prefix sums per partition id over a frame of one row per
    partition (bounded by the partition count, so an ordered window is fine)."""
    per = tagged.groupBy(_PID).agg(*[F.sum(c).alias(f"_vm_tot_{k}") for k, c in sums.items()])
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(_PID, *[F.coalesce(F.sum(f"_vm_tot_{k}").over(w), F.lit(0)).alias(f"_vm_off_{k}")
                              for k in sums])


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based, gap-free row number following ``order`` (ties broken by
    input position). Distributed: no task sees more than one range."""
    tagged = _ranged(df, order, num_partitions)
    # monotonically_increasing_id = (partition index << 33) + position in partition
    idx = F.col(_MID) - F.shiftleft(F.col(_PID), 33)
    offs = _offsets(tagged, {"n": F.lit(1)})
    return (tagged.join(F.broadcast(offs), _PID)
            .withColumn(name, (F.col("_vm_off_n") + idx + 1).cast("bigint"))
            .drop(_PID, _MID, _SALT, "_vm_off_n"))


def running_totals(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column | str],
                   num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` in the total order ``order``."""
    sums = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    tagged = _ranged(df, order, num_partitions)
    for k, c in sums.items():
        tagged = tagged.withColumn(f"_vm_val_{k}", c)
    offs = _offsets(tagged, {k: F.col(f"_vm_val_{k}") for k in sums})
    w = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(F.broadcast(offs), _PID)
    for k in sums:
        out = out.withColumn(k, F.col(f"_vm_off_{k}") + F.sum(f"_vm_val_{k}").over(w))
    return out.drop(_PID, _MID, _SALT, *[f"_vm_off_{k}" for k in sums], *[f"_vm_val_{k}" for k in sums])


#: Sketch size (rank error about 0.15 %) and the first half width of a bracket, as a share of the rows.
SKETCH_K, MARGIN = 2048, 0.005
#: Ranks at which a sketch is read.
GRID = 512
#: Brackets that hold more rows than this are narrowed by another pass before their values are looked at.
BAND_ROWS = 1_000_000
#: Targets (value columns x probabilities) of one pass: each has a bit of a long.
MAX_TARGETS = 60


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str] = (),
                    name: str = "q", method: str = "select") -> DataFrame:
    """Exact linear-interpolation quantiles per ``by`` group, long form
    (by..., ``name``, value); NULL values ignored, NaN the greatest.

    ``method="select"`` (default) moves no values but those in narrow brackets (see
    ``quantiles_with``); ``method="sort"`` ranks all values with one distributed sort."""
    if method == "sort":
        return _sort_quantiles(df, value, probs, by, name)
    v = F.col(value) if isinstance(value, str) else value
    _, out = quantiles_with(df, {"value": v}, probs, by)
    return out.select(*by, F.col("_vm_p").alias(name), "value")


def _kll(v: Column) -> Column:
    return F.kll_sketch_agg_double(F.nanvl(v, F.lit(float("inf"))), SKETCH_K)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Through the shared folder: computed once, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantiles_with(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], by: Sequence[str] = (),
                   aggs: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(by..., ``aggs``) and, from the same first pass, exact quantiles (by..., _vm_c, _vm_p, value)
    of the columns ``values``, without an exchange of the values.

    1. One aggregate: ``aggs``, and for each column count, least, greatest and a mergeable KLL sketch.
    2. The sketch brackets the two ranks of every probability. In groups so large that the brackets
       would hold more than ``BAND_ROWS`` rows, a pass that counts around them and sketches what is
       inside narrows them, as often as needed (each time to about 1 %).
    3. One aggregate counts the rows below each bracket and the rows at each value inside it.
    Ranks are read off the exact counts; a bracket that turns out not to hold its ranks is widened
    and counted again, so the result never depends on the sketch. Equal values are one row of the
    counts, so a value on most rows is no burden."""
    names, probs = list(values), list(dict.fromkeys(map(float, probs)))
    step = max(1, MAX_TARGETS // len(probs))
    if len(names) > step:
        first, out = quantiles_with(df, {c: values[c] for c in names[:step]}, probs, by, aggs)
        for i in range(step, len(names), step):
            out = out.unionByName(quantiles_with(df, {c: values[c] for c in names[i:i + step]}, probs, by)[1])
        return first, out
    d = df.select(*by, *[values[c].cast("double").alias(f"_vm_v{j}") for j, c in enumerate(names)])
    per = [f(f"_vm_v{j}").alias(f"_vm_{k}{j}") for j in range(len(names))
           for k, f in (("n", F.count), ("mn", F.min), ("mx", F.max), ("s", lambda c: _kll(F.col(c))))]
    extra = df.select("*", *[values[c].cast("double").alias(f"_vm_v{j}") for j, c in enumerate(names)])
    state = _written(extra.groupBy(*by).agg(*aggs, *per) if by else extra.agg(*aggs, *per), "sketches")
    own = [c for c in state.columns if c not in by and not c.startswith("_vm_")]
    targets = [(j, float(q)) for j in range(len(names)) for q in probs]
    margin = MARGIN
    while True:
        brackets = _brackets(state.drop(*own), by, targets, margin)
        brackets = _narrowed(d, brackets, by, targets) if margin < 1 else brackets
        picked = _written(_picked(d, brackets, by, targets), "quantiles")
        if margin >= 1 or picked.where(~F.col("_vm_ok")).isEmpty():  # at 1 a bracket is the whole group
            break
        margin *= 8
    found = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(names[j]).alias("c"), F.lit(q).alias("p")) for i, (j, q) in enumerate(targets)])
    out = picked.withColumn("_vm_x", found[F.col("_vm_t")])
    return state.select(*by, *own), out.select(*by, F.col("_vm_x.c").alias("_vm_c"), F.col("_vm_x.p").alias("_vm_p"), "value")


def _brackets(state: DataFrame, by: Sequence[str], targets: Sequence[tuple[int, float]], margin: float) -> DataFrame:
    """Per group and target: a and b, the ranks wanted, with pos between them; lo and hi, values
    that should enclose theirs; in, about how many rows that may take in."""
    cols = []
    for i, (j, q) in enumerate(targets):
        n = F.col(f"_vm_n{j}")
        pos = F.when(n > 0, (n - 1).cast("double") * F.lit(q))
        a, b = F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint")
        lo, hi = _enclosing(f"_vm_s{j}", n, a, b, F.col(f"_vm_mn{j}"), F.col(f"_vm_mx{j}"), margin)
        cols += [a.alias(f"_vm_a{i}"), b.alias(f"_vm_b{i}"), pos.alias(f"_vm_pos{i}"), lo.alias(f"_vm_lo{i}"), hi.alias(f"_vm_hi{i}"),
                 F.when(n > 0, F.least(n, F.ceil(n * F.lit(2 * margin)).cast("bigint"))).otherwise(0).alias(f"_vm_in{i}")]
    return _written(_grids(state, {f"_vm_s{j}": f"_vm_n{j}" for j, _ in targets}).select(*by, *cols), "brackets")


def _grids(df: DataFrame, sketches: Mapping[str, str]) -> DataFrame:
    """Each sketch, given with its count, as its values at ``GRID`` + 1 ranks: it can be asked at constant ranks only."""
    ranks = F.from_json(F.lit(json.dumps([i / GRID for i in range(GRID + 1)])), "array<double>")
    return df.withColumns({c: F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(F.col(c), ranks)) for c, n in sketches.items()})


def _enclosing(grid: str, n: Column, a: Column, b: Column, least: Column, most: Column, margin: float) -> tuple[Column, Column]:
    """Bounds of the values at ranks a to b of the n sketched ones; the ends are exact."""
    low, high = F.floor((a / n - F.lit(margin)) * GRID), F.ceil(((b + 1) / n + F.lit(margin)) * GRID)
    lo = F.when(n == 0, F.lit(None)).when(low <= 0, least).otherwise(F.get(F.col(grid), low.cast("int")))
    hi = F.when(n == 0, F.lit(None)).when(high >= GRID, most).otherwise(F.get(F.col(grid), high.cast("int")))
    return lo, F.when(hi == F.lit(float("inf")), F.lit(float("nan"))).otherwise(hi)


def _with_brackets(d: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with its group's brackets; without groups they are one row, which becomes constants."""
    if by:
        return _join_on(d, brackets, by)
    row, kinds = brackets.first(), {f.name: f.dataType for f in brackets.schema}
    return d.withColumns({c: F.lit(row[c]).cast(kinds[c]) for c in kinds})


def _narrowed(d: DataFrame, brackets: DataFrame, by: Sequence[str], targets: Sequence[tuple[int, float]]) -> DataFrame:
    """Brackets of at most ``BAND_ROWS`` rows besides those equal to an end, where they can be had."""
    held = None
    while True:
        most = brackets.agg(F.max(F.greatest(F.lit(0), *[F.col(f"_vm_in{i}") for i in range(len(targets))]))).first()[0] or 0
        if most <= BAND_ROWS or (held is not None and most > held // 2):
            return brackets
        held = most
        aggs = []
        j = _with_brackets(d, brackets, by)
        for i, (c, _) in enumerate(targets):
            v, lo, hi = F.col(f"_vm_v{c}"), F.col(f"_vm_lo{i}"), F.col(f"_vm_hi{i}")
            inside = F.when((v > lo) & (v < hi), v)
            aggs += [F.count_if(v <= lo).alias(f"_vm_le{i}"), F.count(inside).alias(f"_vm_m{i}"), _kll(inside).alias(f"_vm_k{i}")]
        counts = j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)
        cols = []
        for i in range(len(targets)):
            n, a, b = F.col(f"_vm_m{i}"), F.col(f"_vm_a{i}") - F.col(f"_vm_le{i}"), F.col(f"_vm_b{i}") - F.col(f"_vm_le{i}")
            lo, hi = _enclosing(f"_vm_k{i}", n, a, b, F.col(f"_vm_lo{i}"), F.col(f"_vm_hi{i}"), MARGIN)
            cols += [*[F.col(f"_vm_{k}{i}") for k in ("a", "b", "pos")], F.coalesce(F.when(a >= 0, lo), F.col(f"_vm_lo{i}")).alias(f"_vm_lo{i}"),
                     F.coalesce(F.when(b < n, hi), F.col(f"_vm_hi{i}")).alias(f"_vm_hi{i}"),
                     F.when((a >= 0) & (b < n), F.ceil(n * F.lit(2 * MARGIN)).cast("bigint")).otherwise(F.ceil(n * F.lit(MARGIN)).cast("bigint")).alias(f"_vm_in{i}")]
        counts = _written(_grids(counts, {f"_vm_k{i}": f"_vm_m{i}" for i in range(len(targets))}), "counts")
        brackets = _written(_join_on(brackets, counts, by).select(*by, *cols), "brackets")


def _picked(d: DataFrame, brackets: DataFrame, by: Sequence[str], targets: Sequence[tuple[int, float]]) -> DataFrame:
    """(by..., _vm_t, _vm_ok, value): the quantiles read off exact counts in and below the brackets."""
    j = _with_brackets(d, brackets, by)
    below, inside = F.lit(0).cast("bigint"), []
    for i, (c, _) in enumerate(targets):
        v, lo, hi = F.col(f"_vm_v{c}"), F.col(f"_vm_lo{i}"), F.col(f"_vm_hi{i}")
        below = below + F.when(v < lo, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        inside.append(F.when((v >= lo) & (v <= hi), F.struct(F.lit(i).alias("t"), v.alias("v"), F.lit(0).cast("bigint").alias("m"))))
    # each row gives one row that says which brackets it is below, and one for each bracket it is in
    mark = F.struct(F.lit(-1).alias("t"), F.lit(None).cast("double").alias("v"), below.alias("m"))
    rows = j.select(*by, F.explode(F.array_compact(F.array(mark, *inside))).alias("_vm_x"))
    counts = _written(rows.groupBy(*by, F.col("_vm_x.t").alias("_vm_t"), F.col("_vm_x.v").alias("_vm_v"), F.col("_vm_x.m").alias("_vm_m"))
                      .agg(F.count(F.lit(1)).alias("_vm_c")), "bands")
    bit = lambda i: F.shiftright("_vm_m", i).bitwiseAND(F.lit(1)) == 1
    under = F.array(*[F.struct(F.lit(i).alias("t"), F.when(bit(i), F.col("_vm_c")).otherwise(0).alias("c")) for i in range(len(targets))])
    under = (counts.where("_vm_t = -1").select(*by, F.explode(under).alias("_vm_x"))
             .groupBy(*by, F.col("_vm_x.t").alias("_vm_t")).agg(F.sum("_vm_x.c").alias("_vm_under")))
    upto = F.sum("_vm_c").over(Window.partitionBy(*by, "_vm_t").orderBy("_vm_v"))
    band = counts.where("_vm_t >= 0").select(*by, "_vm_t", "_vm_v", upto.alias("_vm_upto"))
    wanted = F.array(*[F.struct(F.lit(i).alias("t"), *[F.col(f"_vm_{k}{i}").alias(k) for k in ("a", "b", "pos")]) for i in range(len(targets))])
    wanted = brackets.select(*by, F.explode(wanted).alias("_vm_x")).select(*by, F.col("_vm_x.t").alias("_vm_t"), "_vm_x.a", "_vm_x.b", "_vm_x.pos").where("a is not null")
    both = _join_on(wanted, under, [*by, "_vm_t"])
    first = lambda r: F.min(F.when(F.col("_vm_under") + F.col("_vm_upto") > F.col(r), F.col("_vm_v")))
    found = _join_on(both, band, [*by, "_vm_t"], "left").groupBy(*by, "_vm_t").agg(
        first("a").alias("_vm_x"), first("b").alias("_vm_y"), F.first("pos").alias("_vm_pos"),
        (F.first("_vm_under") <= F.first("a")).alias("_vm_low"), (F.max(F.col("_vm_under") + F.coalesce("_vm_upto", F.lit(0))) > F.first("b")).alias("_vm_high"))
    frac = F.col("_vm_pos") - F.floor("_vm_pos")
    return found.select(*by, "_vm_t", (F.col("_vm_low") & F.col("_vm_high")).alias("_vm_ok"), (F.col("_vm_x") + (F.col("_vm_y") - F.col("_vm_x")) * frac).alias("value"))


def _join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL group keys (groupBy keeps them)."""
    if not keys:
        return _with_group_scalars(a, b)
    r = b.select(*[F.col(c).alias(f"_vm_k_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = [a[c].eqNullSafe(r[f"_vm_k_{c}"]) for c in keys]
    return a.join(r, cond, how).drop(*[f"_vm_k_{c}" for c in keys])


def _with_group_scalars(d: DataFrame, g: DataFrame) -> DataFrame:
    """Attach the columns of a one-row (ungrouped) frame as scalar subqueries."""
    out = d
    for c in g.columns:
        out = out.withColumn(c, g.select(c).scalar())
    return out


def _sort_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str],
                    name: str) -> DataFrame:
    """Sort method: one distributed sort of all values instead of a per-group
    value->count map, so a hot group (a third of all rows) is spread over
    many tasks."""
    v = F.col(value) if isinstance(value, str) else value
    d = df.select(*by, v.cast("double").alias("_vm_v")).where(F.col("_vm_v").isNotNull())
    ranked = global_rank(d, [*by, "_vm_v"], name="_vm_r")
    stats = ranked.groupBy(*by).agg(F.min("_vm_r").alias("_vm_start"), F.count(F.lit(1)).alias("_vm_n"))
    qs = F.array(*[F.lit(float(p)) for p in probs])
    t = (stats.select(*by, "_vm_start", "_vm_n", F.explode(qs).alias(name))
         .withColumn("_vm_pos", (F.col("_vm_n") - 1).cast("double") * F.col(name))
         .withColumn("_vm_lo", F.floor("_vm_pos").cast("bigint"))
         .withColumn("_vm_hi", F.ceil("_vm_pos").cast("bigint"))
         .withColumn("_vm_frac", F.col("_vm_pos") - F.col("_vm_lo")))
    need = t.select(*by, name, "_vm_frac", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), (F.col("_vm_start") + F.col("_vm_lo")).alias("r")),
        F.struct(F.lit("hi").alias("side"), (F.col("_vm_start") + F.col("_vm_hi")).alias("r")))).alias("_vm_x"))
    need = need.select(*by, name, "_vm_frac", F.col("_vm_x.side").alias("_vm_side"),
                       F.col("_vm_x.r").alias("_vm_r"))
    vals = need.join(ranked.select("_vm_r", "_vm_v"), "_vm_r")
    picked = vals.groupBy(*by, name, "_vm_frac").agg(
        F.max(F.when(F.col("_vm_side") == "lo", F.col("_vm_v"))).alias("_vm_vlo"),
        F.max(F.when(F.col("_vm_side") == "hi", F.col("_vm_v"))).alias("_vm_vhi"))
    return picked.select(*by, name, (F.col("_vm_vlo") + (F.col("_vm_vhi") - F.col("_vm_vlo")) * F.col("_vm_frac"))
                         .alias("value"))


def quantile_columns(df: DataFrame, value: str | Column, probs: Mapping[str, float],
                     by: Sequence[str] = (), method: str = "select", accuracy: int = 10_000) -> DataFrame:
    """Wide form of ``exact_quantiles``: one column per named probability.
    Groups whose values are all NULL do not appear.

    ``method`` is "select" or "sort" (both exact, see ``exact_quantiles``) or
    "approx", which trades exactness for one pass: ``percentile_approx``
    keeps a bounded sketch per group (relative rank error 1/accuracy)."""
    if method == "approx":
        v = (F.col(value) if isinstance(value, str) else value).cast("double")
        arr = F.percentile_approx(v, list(map(float, probs.values())), accuracy)
        g = df.groupBy(*by).agg(arr.alias("_vm_q")) if by else df.agg(arr.alias("_vm_q"))
        return g.select(*by, *[F.col("_vm_q")[i].alias(k) for i, k in enumerate(probs)])
    long = exact_quantiles(df, value, list(probs.values()), by, method=method)
    aggs = [F.max(F.when(F.col("q") == F.lit(float(p)), F.col("value"))).alias(k) for k, p in probs.items()]
    return long.groupBy(*by).agg(*aggs) if by else long.agg(*aggs)
