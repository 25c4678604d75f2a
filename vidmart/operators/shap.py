"""Tree contributions (L12): path-dependent Shapley values of a fitted boosted-tree model.

A tree is the sum of its leaves, and a leaf is a product: its value, times 1 or 0 for each
feature on its path (the row meets that feature's splits or not). A feature that is not known
counts as the share of training rows that went the path's way, multiplied over its splits. The
Shapley values of a product are polynomials of these factors, so for a leaf with d features a
table of 2**d rows (which features the row meets) holds all of them; d is at most the depth.
A batch of rows then needs d comparisons and one look-up for each leaf, for all rows at once.

The values of a row and the base value add up to the model's margin. The node table has at most
trees * 2**(depth + 1) rows; it is what travels to the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


class Leaf:
    """Value and, for each feature on the path, its conditions and the share of rows that meet them."""

    def __init__(self, value: float, path: list[tuple[int, bool, object, float]]):
        self.value, self.features = value, sorted({f for f, *_ in path})
        self.splits = [[(goes_left, split) for f, goes_left, split, _ in path if f == g] for g in self.features]
        self.shares = [float(np.prod([share for f, *_, share in path if f == g])) for g in self.features]
        d = len(self.features)
        self.table = np.zeros((1 << d, d))
        for met in range(1 << d):
            factor = [(met >> j & 1) for j in range(d)]
            for i in range(d):
                others = [j for j in range(d) if j != i]
                total = sum(factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d)
                            * np.prod([factor[j] if j in s else self.shares[j] for j in others])
                            for n in range(d) for s in combinations(others, n))
                self.table[met, i] = value * (factor[i] - self.shares[i]) * total

    def add_to(self, x: np.ndarray, out: np.ndarray) -> None:
        met = np.zeros(len(x), np.int64)
        for j, (f, splits) in enumerate(zip(self.features, self.splits, strict=True)):
            ok = np.ones(len(x), bool)
            for goes_left, split in splits:
                left = np.isin(x[:, f], split) if isinstance(split, tuple) else x[:, f] <= split
                ok &= left == goes_left
            met |= ok.astype(np.int64) << j
        if self.features:
            out[:, self.features] += self.table[met]


def node_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(tree, id, prediction, rows, left, right, feature, threshold, categories, arity, weight) of
    every node of the model's last stage, as Spark ML stores it."""
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"), n["rawCount"].alias("rows"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        n["split"]["leftCategoriesOrThreshold"].alias("at"), n["split"]["numCategories"].alias("arity"))
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "weight").drop("about")
    return nodes.join(weights, "tree")


def leaves_of(nodes: list[dict]) -> tuple[list[Leaf], float]:
    """Leaves of all trees, weighted, and the base value: what the model says knowing no feature."""
    by = {(n["tree"], n["id"]): n for n in nodes}
    leaves, base = [], 0.0

    def walk(node: dict, path: list, reach: float) -> None:
        nonlocal base
        if node["left"] < 0:
            value = node["prediction"] * node["weight"]
            base += value * reach
            leaves.append(Leaf(value, path))
            return
        categories = node["arity"] >= 0
        split = tuple(node["at"]) if categories else node["at"][0]
        for side in ("left", "right"):
            child = by[node["tree"], node[side]]
            share = child["rows"] / node["rows"] if node["rows"] else 0.5
            walk(child, [*path, (node["feature"], side == "left", split, share)], reach * share)

    for tree in sorted({n["tree"] for n in nodes}):
        walk(by[tree, 0], [], 1.0)
    return leaves, base


def tree_contributions(model: PipelineModel, scored: DataFrame, names: Sequence[str], k: int = 5,
                       features: str = "features", name: str = "top_contributions") -> DataFrame:
    """Rows of ``scored`` (with the assembled ``features``) with ``base_value``, ``all_contributions``
    (feature, value) from the largest, by magnitude, to the smallest, and the first ``k`` as ``name``."""
    leaves, base = leaves_of([r.asDict() for r in node_table(model, scored.sparkSession).collect()])
    shared = scored.sparkSession.sparkContext.broadcast(leaves)
    width = len(names)

    def of(batches):
        for batch in batches:
            flat = batch.column("_vm_x").flatten().to_numpy(zero_copy_only=False)
            x, out = flat.reshape(-1, width), np.zeros((batch.num_rows, width))
            for leaf in shared.value:
                leaf.add_to(x, out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.reshape(-1)))
            keep = [c for c in batch.schema.names if c != "_vm_x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "_vm_phi"])

    plain = scored.select(*[c for c, t in scored.dtypes if t != "vector"], vector_to_array(features).alias("_vm_x"))
    kept = plain.drop("_vm_x")
    phi = plain.mapInArrow(of, kept.select("*", F.array(F.lit(0.0)).alias("_vm_phi")).schema)
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("_vm_phi")[i].alias("value")) for i, f in enumerate(names)])
    ranked = F.array_sort(items, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))
    return phi.select(*kept.columns, F.lit(base).alias("base_value"), ranked.alias("all_contributions")).withColumn(name, F.slice("all_contributions", 1, k))
