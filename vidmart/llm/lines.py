"""Quality rules on a document and on its lines across documents; DataFrame functions only.

A line is normalised (lower case, white space runs as one space, ends trimmed) and
hashed together with its host. A line found in more distinct documents of a host than
the limit is boilerplate: it is taken out of the count of a document's words, and a
document that loses too many is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmart.llm.common import documents, saved

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is over the limit in more documents than both of these: a number, and a percentage of the host's.
LINE_DOCS, LINE_PERCENT = 20, 2
#: A document is depleted when more than this percentage of its words stood in such lines, or too few are left.
MAX_LOST_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeat_words(words: Column) -> Column:
    """Words in windows that are found twice or more, the first included."""
    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.transform(
            F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])
        return let(marked, lambda s: let(F.sort_array(same(s)), covered))

    def windows(own: Column) -> Column:
        many = F.greatest(F.size(own) - (WINDOW - 1), F.lit(0))
        return F.transform(F.slice(own, F.lit(1), many), lambda h, i: F.xxhash64(h, *(F.get(own, i + k) for k in range(1, WINDOW))))

    each = F.transform(words, lambda w: F.xxhash64(w))
    return let(each, lambda own: let(windows(own), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(h))))


def base_rules(docs: DataFrame, host: str) -> DataFrame:
    """The document's own counts, and its lines with a word as (hash, words)."""
    has_word = "[^\\x20\\x09-\\x0D]"
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word))
    line = lambda x: F.struct(F.xxhash64(F.lower(F.trim(F.regexp_replace(x, BLANKS, " ")))).alias("h"),
                              F.size(words_of(x)).alias("n"))
    out = step.select(
        "rid", "doc_id", "host",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("text", BLANKS, "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.transform(x, line).alias("lines"))).alias("l"))
    n, again = F.col("w.n_words").cast("long"), F.col("w.n_repeat_words").cast("long")
    return out.select("rid", "doc_id", "host", n.alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
                      F.col("n_symbols").cast("long").alias("n_symbols"), F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
                      again.alias("n_repeat_words"),
                      ((n < LEAST_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)).alias("base_failed"), F.col("l.lines").alias("lines"))


def line_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, kept).

    One row for every row of docs (doc_id, text, host). Null text is empty, with no words, so it
    fails; a null host is a host of its own; rows that repeat a doc_id count as documents of their
    own; other columns are not looked at."""
    known = saved(base_rules(docs, host), "lines")
    hosts = known.groupBy("host").agg(F.count("*").alias("docs"))
    each = known.select("host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    over = (each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > LINE_DOCS).join(hosts, "host")
            .where(100 * F.col("n") > LINE_PERCENT * F.col("docs")).select("host", "h"))
    lost = (known.select("rid", "host", F.explode("lines").alias("line")).select("rid", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
            .join(over, ["host", "h"], "left_semi").groupBy("rid").agg(F.sum("n").alias("n_lost_words")))
    out = known.drop("lines", "host").join(lost, "rid", "left").withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)).cast("long"))
    depleted = (100 * F.col("n_lost_words") > MAX_LOST_PERCENT * F.col("n_words")) | (F.col("n_words") - F.col("n_lost_words") < LEAST_WORDS)
    return out.drop("rid").withColumn("kept", ~(F.col("base_failed") | depleted))


def op8_line_rules(spark, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir, "doc_id", "text", "source"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
wins AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p:p + 4]) AS n FROM win),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - p, 5))) AS n
        FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM wins WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT rid, host, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS norm,
              len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
       FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY rid),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
over_limit AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT rid) AS n FROM lw GROUP BY host, norm) JOIN hosts USING (host)
               WHERE n > 20 AND 100 * n > 2 * docs),
lost AS (SELECT rid, sum(n) AS n FROM lw SEMI JOIN over_limit USING (host, norm) GROUP BY rid),
r AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
      FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_lost_words > 50 * n_words OR n_words - n_lost_words < 10) AS kept
FROM r
"""
