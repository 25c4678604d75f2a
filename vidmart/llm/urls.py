"""URL filters by cascades of Bloom filters; DataFrame functions only.

A rule is an action, a host and a path. It fits a url whose host is the rule's or a
subdomain of it and whose path starts with the rule's; the longest fitting rule decides.
So a url asks, for every pair of lengths that some rule has (host, path), whether the
string of its host's end and its path's beginning is listed: its keys.

Membership is answered without a join. Level 0 of a cascade is a Bloom filter of the
listed keys. The keys of the whole corpus that pass it without being listed are the false
positives; level 1 encodes them, level 2 the listed keys that pass level 1, level 3 the
false positives that pass level 2, and so on until nothing passes. A key of the corpus is
listed exactly if the first level that it does not pass is an odd one. Each action has its
cascade, and both are read as constants inside one projection of the pages.

A filter is an array of 64-bit words made by one bit_or aggregate. Its size follows the
list, not the corpus: 10 bits for each listed key, later levels less. Lists whose filters
would pass ``MAX_FILTER_BYTES`` are joined instead, with the same result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmart.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits and hash functions for each listed key at level 0, and at the levels after it.
FIRST, LATER = (10, 5), (3, 2)
#: Filters beyond this are not shipped to the executors: about 25 million listed keys.
MAX_FILTER_BYTES = 32 << 20
#: The verdict on a url that no rule fits: it is not listed, so it stays.
DEFAULT = "allow"
#: The rules of the registered query as (action, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://" or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    """One Bloom filter: its words, its number of bits, hash functions and first seed."""

    words: list[int]
    bits: int
    hashes: int
    seed: int

    def places(self, key: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(F.lit(self.seed + i), key), F.lit(self.bits)) for i in range(self.hashes)))

    def passes(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        return F.forall(self.places(key), lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)


def bloom(keys: DataFrame, count: int, bits_per_key: float, hashes: int, seed: int) -> Level:
    """The filter of a column ``key``; its words meet as one row for each word."""
    level = Level([], 64 * max(1, -(-int(bits_per_key * count) // 64)), hashes, seed)
    places = keys.select(F.explode(level.places(F.col("key"))).alias("p"))
    words = (places.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    held = dict((r["word"], r["bits"]) for r in words)
    level.words = [held.get(i, 0) for i in range(level.bits // 64)]
    return level


def holds(levels: list[Level], key: Column) -> Column:
    """Whether the cascade lists the key: the first level that it does not pass is odd."""
    listed = F.lit(False)
    for level in reversed(levels):
        listed = level.passes(key) & ~listed
    return listed


def cascade(listed: DataFrame, first: Level, outside: DataFrame, later: tuple[float, int] = LATER) -> list[Level]:
    """The levels after ``first``, the filter of ``listed``, for the false positives ``outside``."""
    levels, sides = [first], [outside, listed]
    while count := sides[0].count():
        levels.append(bloom(sides[0], count, *later, seed=1000 * len(levels)))
        sides = [saved(sides[1].where(levels[-1].passes(F.col("key"))), "passing"), sides[0]]
    return levels


def _lengths(rules: DataFrame) -> Column:
    """The (host, path) lengths of the rules, the longest rule first, as a constant."""
    found = rules.select(F.length("host").alias("n"), F.length("path").alias("m")).distinct().collect()
    return F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in sorted(map(tuple, found), key=lambda x: (-sum(x), -x[0]))])),
                       "array<struct<n: int, m: int>>")


def _keys(lengths: Column) -> Column:
    """The keys of a row (host, path), the longest first; between equal lengths the longer host."""
    n = F.length("host")
    fits = lambda p: ((p["m"] <= F.length("path"))
                      & ((p["n"] == n) | ((p["n"] < n) & (F.substr(F.col("host"), n - p["n"], F.lit(1)) == "."))))
    return F.transform(F.filter(lengths, fits),
                       lambda p: F.concat(F.substr(F.col("host"), n - p["n"] + 1, p["n"]), F.substr(F.col("path"), F.lit(1), p["m"])))


def _joined(rows: DataFrame, lengths: Column, listed: DataFrame) -> DataFrame:
    """The same verdicts by joins, for lists beyond the size bound."""
    rows = saved(rows.withColumn("_rid", F.monotonically_increasing_id()), "urls")
    each = rows.select("_rid", F.posexplode(_keys(lengths)).alias("_place", "key"))
    best = (each.join(listed, "key").groupBy("_rid").agg(F.min(F.struct("_place", F.col("action") != "block", "key")).alias("best"))
            .select("_rid", F.col("best.key").alias("rule"), F.when(F.col("best.col2"), "allow").otherwise("block").alias("verdict")))
    return rows.join(best, "_rid", "left").drop("_rid")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, first: tuple[float, int] = FIRST,
                later: tuple[float, int] = LATER, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for every row of pages (page_id, url).

    rules: (action, host, path), action allow or block. ``rule`` is the longest fitting one as
    host + path, else null, then the verdict is ``default``. A rule listed for both actions
    blocks. Rules without a host, with another action, or with a path that does not begin with
    "/" (and is not empty) can fit nothing and are left out; repeated rules count once. A null
    url has an empty host and path and fits no rule; page_id is only carried along, so repeated
    and null ids each keep their row. Other columns of pages are not looked at. However long a
    url is, it has at most as many keys as the rules have pairs of lengths."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rules = saved(rules.select("action", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
                  .where("host <> '' and (path = '' or startswith(path, '/')) and action in ('allow', 'block')").distinct(), "rules")
    listed = rules.select("action", F.concat("host", "path").alias("key"))
    lengths = _lengths(rules)
    counts = {r["action"]: r["count"] for r in listed.groupBy("action").count().collect()}
    if sum(counts.values()) * first[0] / 8 > max_bytes:
        out = _joined(rows, lengths, listed)
        return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

    of = {a: listed.where(F.col("action") == a).select("key") for a in counts}
    firsts = {a: bloom(of[a], counts[a], *first, seed=0) for a in counts}
    passes = lambda k: F.array(*(level.passes(k) for level in firsts.values()))
    # the corpus's keys that pass a first level, and which list they are in: every other key is outside at once
    near = rows.select(F.explode(F.array_distinct(F.filter(_keys(lengths), lambda k: F.exists(passes(k), lambda x: x)))).alias("key"),
                       F.lit("").alias("action")).distinct() if counts else listed.select("key", "action")
    known = saved(near.unionByName(listed).groupBy("key").agg(F.collect_set("action").alias("actions")), "universe")
    levels = {a: cascade(of[a], firsts[a], saved(known.where(~F.array_contains("actions", a) & firsts[a].passes(F.col("key"))).select("key"), "outside"), later)
              for a in counts}
    any_of = lambda k: F.exists(F.array(F.lit(False), *(holds(x, k) for x in levels.values())), lambda x: x)
    out = rows.withColumn("rule", F.get(F.filter(_keys(lengths), any_of), 0) if counts else F.lit(None).cast("string"))
    verdict = F.when(F.col("rule").isNull(), default).when(holds(levels.get("block", []), F.col("rule")), "block").otherwise("allow")
    return out.withColumn("verdict", verdict)


def op13_urls(spark, sf_dir: str) -> DataFrame:
    """Verdicts on every page of the corpus."""
    rules = spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as t(action, host, path)")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT rid, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC) AS k
        FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (rid)
"""
