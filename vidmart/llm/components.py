"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmart.llm.common import in_files, release, saved


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    least = edges.groupBy(*by, "u").agg(F.min("v").alias("m"))
    inner = edges.join(least, [*by, "u"]).where("v != m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select(*by, "u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame, by: list[str]) -> bool:
    """Whether each node has one smaller neighbour that has none itself: then that is the smallest it reaches."""
    ends = edges.select(*by, F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top"))
    ends = ends.unionByName(edges.select(*by, F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return ends.groupBy(*by, "node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or up = 1 and top = 1").isEmpty()


def components(links: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """(by, node, component) for every node of links (by, u, v): the smallest node that it reaches.
    Links with other values of ``by`` are another graph; all graphs go through the same rounds.

    Each round joins the links with the least neighbour of each node, never gathering a
    node's neighbours, and is written to the shared folder. Self links and repeated links
    are harmless; no links give no rows. rows: about how many links there are, if that is known."""
    by = list(by)
    held = lambda edges: saved(edges if rows is None else in_files(edges, rows), "links")
    edges = held(links.where("u != v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges, by):
        done, edges = edges, held(_small_star(_large_star(edges, by), by))
        release(done)
    own = edges.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(*by, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
