"""Filter interaction audit by difference arrays over Lehmer ranks.

A document's mask is the set of filters that it fails. Under an order of the filters it is
removed at the first letter of its mask. All orders that begin with the same letters have
neighbouring ranks in lexicographic order (the Lehmer code of the beginning, times
factorials, is the first of them), so the orders under which a mask goes at step s are a
few intervals of ranks: those of the beginnings whose last letter is in the mask and whose
other letters are not. The documents are counted by mask, each count is added at the
beginning of an interval and taken off at its end, and running sums over the ranks give
what every step of every order removes. No document is looked at twice, and no order is
replayed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidmart.llm.common import documents, saved
from vidmart.llm.lines import words_of

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
LETTERS = "ABCDE"


def intervals(k: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, lo, hi): under the orders of k filters with rank in [lo, hi) a document of
    that mask is removed at that step."""
    def walk(before: int, rest: tuple[int, ...], lo: int) -> Iterator[tuple[int, int, int, int]]:
        size = factorial(len(rest) - 1) if rest else 0
        for i, letter in enumerate(rest):
            others = rest[:i] + rest[i + 1:]
            for mask in range(1, 1 << k):
                if mask >> letter & 1 and not mask & before:
                    yield mask, k - len(others), lo + i * size, lo + (i + 1) * size
            yield from walk(before | 1 << letter, others, lo + i * size)

    return walk(0, tuple(range(k)), 0)


def interactions(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    masks: (part, mask, good, toxic), one row for each document; bit i of mask: it fails
    letters[i]. One row for each part, order and step, zeros included; without documents none.
    Null masks and flags count as 0, a null part as ''. The orders grow as a factorial: meant
    for up to 7 filters. Only counts, 2**k for each part, go past the first aggregate."""
    spark, k = masks.sparkSession, len(letters)
    n_orders = factorial(k)
    counts = saved(masks.groupBy(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask"))
                   .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")), "masks")
    # both tables have a size that k fixes, whatever the input is
    spans = F.broadcast(spark.createDataFrame(list(intervals(k)), "mask int, step int, lo int, hi int"))
    orders = F.broadcast(spark.createDataFrame(
        [(rank, s + 1, letters[x], "".join(letters[y] for y in p)) for rank, p in enumerate(permutations(range(k))) for s, x in enumerate(p)],
        "rank int, step int, letter string, filter_order string"))

    values = ("n", "good", "toxic")
    end = lambda at, sign: F.struct(F.col(at).alias("rank"), *((sign * F.col(c)).alias(c) for c in values))
    ends = (counts.join(spans, "mask").select("part", "step", F.explode(F.array(end("lo", 1), end("hi", -1))).alias("e"))
            .groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*(F.sum(f"e.{c}").alias(c) for c in values)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    grid = (parts.select("part", "total", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1))).alias("rank"))
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).join(ends, ["part", "rank", "step"], "left"))
    upto = Window.partitionBy("part", "step").orderBy("rank")
    grid = grid.select("part", "total", "rank", "step", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in values)).join(orders, ["rank", "step"])

    bit = lambda i: F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1
    each = counts.select("part", "n", "mask", F.explode(F.array(*(F.when(bit(i), F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("alone")))
                                                              for i, c in enumerate(letters)))).alias("f")).where("f is not null")
    fails = each.groupBy("part", F.col("f.letter").alias("letter")).agg(F.sum("n").alias("fails"), F.sum(F.when(F.col("mask") == F.col("f.alone"), F.col("n"))).alias("alone"))
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))
    return (grid.join(fails, ["part", "letter"], "left").withColumn("kept", F.col("total") - gone)
            .withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "letter")))
            .select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", F.col("n").alias("removed"),
                    (F.coalesce("fails", F.lit(0)) - F.col("n")).alias("redundant"), F.coalesce("alone", F.lit(0)).alias("unique_fails"),
                    F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley"))


def text_failures(text: Column) -> list[Column]:
    """Whether a text, not null, fails the filters A to D."""
    words = words_of(text)
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < LEAST_WORDS, 100 * kinds < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike("[#$%&*|]")]


def document_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) for every row of docs (doc_id, text, part).

    Null text is empty. E: the text is that of a smaller doc_id; texts are told by SHA-256. A
    null doc_id is neither smaller nor larger, so it never fails E, and has no label; rows that
    repeat a doc_id are documents of their own and no copies of each other. A doc_id labelled
    more than once is good (toxic) if one of its labels is. Other columns are not looked at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(part).cast("string").alias("part"), text.alias("text"))
    rows = saved(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), bits.alias("mask")), "filters")
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
             .groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    # both joins go by doc_id, which copies of one text do not share
    known = rows.join(marks, "doc_id", "left").join(firsts, ["doc_id", "sha"], "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return known.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"),
                        F.coalesce("toxic", F.lit(False)).alias("toxic"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of every order, by language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions(document_masks(documents(spark, sf_dir, "doc_id", "text", "lang"), labels))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > least, false) AS e, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic
      FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
                || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS mask,
             count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM x p JOIN x q ON q.c <> p.c JOIN x r ON r.c NOT IN (p.c, q.c)
      JOIN x s ON s.c NOT IN (p.c, q.c, r.c) JOIN x t ON t.c NOT IN (p.c, q.c, r.c, s.c)),
st AS (SELECT filter_order, step::INTEGER AS step, filter_order[step:step] AS c, filter_order[1:step - 1] AS before
       FROM o JOIN (SELECT unnest(range(1, 6)) AS step) ON true),
g AS (SELECT part, filter_order, step, c,
             sum(CASE WHEN NOT regexp_matches(mask, '[' || before || c || ']') THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN contains(mask, c) AND (step = 1 OR NOT regexp_matches(mask, '[' || before || '0]')) THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN contains(mask, c) AND step > 1 AND regexp_matches(mask, '[' || before || '0]') THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = c THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN contains(mask, c) AND (step = 1 OR NOT regexp_matches(mask, '[' || before || '0]')) THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN contains(mask, c) AND (step = 1 OR NOT regexp_matches(mask, '[' || before || '0]')) THEN toxic ELSE 0 END) AS toxic_lost
      FROM m JOIN st ON true GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM g
"""
