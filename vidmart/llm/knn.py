"""Exact top-k inner products by a Voronoi join.

With one more component, sqrt(M**2 - |x|**2) for a candidate (M: the greatest norm) and
0 for a query scaled to length M, the greatest inner products are the nearest points.
Queries are grouped by their nearest pivot. Summaries of the groups (radius of each
query group, the least pivot distances of candidates with distinct vec_ids) bound the distance within
which a group's k nearest must lie; a candidate is sent to a group only if its distance
to the group's pivot, less the radius, is within that bound. Groups are cut into blocks
of bounded size, solved where they meet with whole-number products, and the blocks'
answers are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidmart.llm.common import saved

SCALE = 1024
TOP = 10
MAX_PIVOTS = 64
QUERIES_PER_PIVOT = 64
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024


def scaled(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole-number vectors of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (rows.where("vec_id is not null and embedding is not null").where(F.forall("embedding", finite))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("v")))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector's missing components are 0."""
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; by floating point where that is exact."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def distinct(ids: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n least distances of distinct ids, in order."""
    order = np.argsort(d, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:n]
    return ids[order][first], d[order][first]


def top_k(queries: DataFrame, rows: DataFrame, k: int = TOP, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries against rows, both (vec_id, v).

    A row with the query's own vec_id is no candidate. Ties go to the smaller vec_id; of rows
    that repeat a vec_id the best scored counts once, and queries that repeat one are answered
    as one, by their best scores. No queries or no candidates give no rows."""
    rows = saved(rows, "vectors")
    queries = saved(queries, "queries")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm2).alias("m2")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = max(about["dim"] or 0, asked["dim"] or 0)
    big = float(about["m2"] or 0.0)
    n_pivots = max(1, min(max_pivots, asked["n"] // QUERIES_PER_PIVOT))
    pivots = matrix([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()], dim).astype(float)
    lift = np.sqrt(np.maximum(0, big - (pivots**2).sum(1)))
    slack = 1e-9 * max(1.0, big)

    def from_rows(v: np.ndarray) -> np.ndarray:
        """Distances of candidates to the pivots."""
        v = v.astype(float)
        own = np.sqrt(np.maximum(0, big - (v**2).sum(1)))
        return np.sqrt(np.maximum(0, 2 * big - 2 * (v @ pivots.T + own[:, None] * lift)))

    def from_queries(v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        length = np.sqrt((v**2).sum(1))
        v = v * np.where(length > 0, np.sqrt(big) / np.maximum(length, 1e-300), 0)[:, None]
        return np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] + big - 2 * v @ pivots.T))

    def near_query(batches):
        for batch in batches:
            d = from_queries(matrix(batch.column("v").to_pylist(), dim))
            g = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32)), pa.array(d[np.arange(len(g)), g])], ["vec_id", "v", "g", "d"])

    def least(batches):
        """For each pivot the k + 1 least distances of distinct vec_ids in this part of the table."""
        ids, best = np.zeros((len(pivots), 0), np.int64), np.zeros((len(pivots), 0))
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            d = from_rows(matrix(batch.column("v").to_pylist(), dim)).T
            near = [distinct(np.append(i, own), np.append(old, new), k + 1) for i, old, new in zip(ids, best, d, strict=True)]
            ids, best = np.stack([i for i, _ in near]), np.stack([x for _, x in near])
        g, _ = np.indices(best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(g.ravel().astype(np.int32)), pa.array(ids.ravel()), pa.array(best.ravel())], ["g", "vec_id", "d"])

    if not len(pivots) or not asked["n"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = saved(queries.mapInArrow(near_query, "vec_id long, v array<long>, g int, d double"), "placed")
    radius = np.full(len(pivots), -np.inf)
    size = np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("g").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():
        radius[r["g"]], size[r["g"]] = r["d"], r["n"]
    best = Window.partitionBy("g").orderBy("d")
    near = rows.mapInArrow(least, "g int, vec_id long, d double").groupBy("g", "vec_id").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(best)).where(F.col("r") == k + 1)
    bound = np.full(len(pivots), np.inf)  # d(q, s) <= d(q, pivot) + d(pivot, s) for k + 1 vec_ids s
    for r in near.collect():
        bound[r["g"]] = radius[r["g"]] + r["d"]
    reach = radius + bound + slack  # a candidate farther from the pivot than this is nobody's neighbour
    chunks = np.maximum(1, -(-size // BLOCK_QUERIES))
    blocks = max(1, -(-(about["n"] or 0) // BLOCK_ROWS))

    def send(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                d = from_rows(matrix(part.column("v").to_pylist(), dim))
                row, g = np.nonzero((d <= reach) & (size > 0))
                times = chunks[g]
                row, g = np.repeat(row, times), np.repeat(g, times)
                c = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                sent = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(g.astype(np.int32)), pa.array(c.astype(np.int32))], ["vec_id", "v", "g", "c"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b")
    right = rows.mapInArrow(send, "vec_id long, v array<long>, g int, c int").select("vec_id", "v", "g", "c", block)
    parts = F.element_at(F.lit([int(x) for x in chunks]), F.col("g") + 1)
    left = placed.select("vec_id", "v", "g", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x = x.sort_values("vec_id", kind="stable")
        ids = x["vec_id"].to_numpy()
        data = matrix(x["v"].to_list(), dim)
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # of each vec_id's rows
        ids = ids[start]
        out = []
        for lo in range(0, len(q), 256):
            own = q["vec_id"].to_numpy()[lo:lo + 256]
            score = np.maximum.reduceat(products(matrix(q["v"].to_list()[lo:lo + 256], dim), data), start, axis=1)
            for i, qid in enumerate(own):
                at = np.flatnonzero(ids != qid)
                if len(at) > k:
                    cut = np.partition(score[i, at], len(at) - k)[len(at) - k]
                    at = at[score[i, at] >= cut]
                order = at[np.argsort(-score[i, at], kind="stable")][:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[order], "score": score[i, order]}))
        return pd.concat(out)

    local = left.groupBy("g", "c", "b").cogroup(right.groupBy("g", "c", "b")).applyInPandas(solve, "query_id long, vec_id long, score long")
    once = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    rows = scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows.where(F.col("vec_id") % 100 == 0), rows)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
