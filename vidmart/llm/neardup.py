"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``tables`` short keys (``rows`` minhashes each) are computed for a
document; a table of the index is a pair of one key from either. So 2 * tables * rows
minhashes serve tables**2 tables of 2 * rows minhashes. A pair with similarity s shares a
table when it shares a key of both collections: (1 - (1 - s**rows)**tables)**2, which is
0.99996 at s = 0.8 with 15 tables of 3 rows.

1. Documents with the same words in the same order (told by a 128-bit digest of them) are
   one class, its smallest doc_id stands for it. Equal sets of other documents are links as
   any others: found through their tables and confirmed on the words.
2. A table's key can only meet others if both its halves do; halves that occur once are
   dropped before the pairs are formed. A document's weight counts the documents that
   share its halves: the original of many copies has the greatest.
3. In each table the weightiest document is the leader; each document is confirmed, on
   the words, against the leaders that it shares most tables with.
4. Components of the confirmed links. What is still apart is compared too: within the
   neighbourhood of a leader block against block, where only documents outside its main
   component look for links and only links are put out; across neighbourhoods as pairs
   that share a table. Links inside a component can add nothing, so no group is expanded
   into all its pairs.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidmart.llm.arrays import LOWER, U, mix, prefix, runs, span, word_hashes
from vidmart.llm.common import WORK_ROWS, documents, in_buckets, in_files, mostly_in, release, saved, slices, text_arrays
from vidmart.llm.components import components

TABLES = 15
ROWS = 3
#: Leaders that a document is confirmed against before components are first formed.
LEADERS = 2
#: Tables shared with its best leader from which a document is of the leader's neighbourhood.
NEAR_TABLES = 2
#: Documents of one side of a comparison of blocks.
BLOCK_DOCS = 1_000
SIMILAR = 80


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**64, n, dtype=U), rng.integers(0, 2**64, n, dtype=U) | U(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, shingle hash), in order; a shorter text is one shingle."""
    words, text, _, _ = word_hashes(LOWER[raw], offsets)
    hashes = prefix(words)
    n = len(words)
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    count = np.diff(np.append(first, n))
    at = np.arange(max(0, n - size + 1))
    at = at[text[at] == text[at + size - 1]]
    short = np.flatnonzero((count > 0) & (count < size))
    of = np.concatenate([text[at], short])
    value = np.concatenate([span(hashes, at, at + size), span(hashes, first[short], first[short] + count[short])])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])])[:len(of)]
    return of[new], value[new]


def sketch(docs: DataFrame, size: int, tables: int = TABLES, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, fp1, fp2, a, b): set size, digest of the words in order, keys of both collections;
    a key's lowest bit names its collection."""
    names = ["doc_id", "n", "fp1", "fp2", "a", "b"]
    salt, factor = _functions(2 * tables * rows)

    def of(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_arrays(batch.column("text"))
            text, value = shingles(raw, offsets, size)
            n = np.bincount(text, minlength=batch.num_rows)
            full = np.flatnonzero(n)
            at = runs(text)
            low, ends = LOWER[raw].tobytes(), offsets.tolist()
            words = (b" ".join(low[ends[i]:ends[i + 1]].split()) for i in range(batch.num_rows))
            fp = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words), "<i8").reshape(-1, 2).T
            keys = np.zeros((batch.num_rows, 2, tables), U)
            if len(at):
                for i in range(2):
                    for k in range(tables):
                        key = np.full(len(full), i * tables + k + 1, U)
                        for r in range(rows):
                            f = (i * tables + k) * rows + r
                            h = (value ^ salt[f]) * factor[f]
                            key = mix(key ^ np.minimum.reduceat(h ^ (h >> U(29)), at))
                        keys[full, i, k] = key & ~U(1) | U(i)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * tables, tables, dtype=np.int32)),
                                              pa.array(np.ascontiguousarray(keys[:, i]).reshape(-1).view(np.int64))) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in fp), *lists], names)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(of, "doc_id long, n long, fp1 long, fp2 long, a array<long>, b array<long>"))


def table_rows(lists: DataFrame, *carry: str) -> DataFrame:
    """(key, doc, carry) for every pair of a key of both collections; carry are long columns."""
    names = ["key", "doc", *carry]

    def of(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                na, nb = (part.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in ("a", "b"))
                a, b = (part.column(c).flatten().to_numpy(zero_copy_only=False).view(U) for c in ("a", "b"))
                count = na * nb
                row = np.repeat(np.arange(part.num_rows), count)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                i = (np.cumsum(na) - na)[row] + inner // nb[row]
                j = (np.cumsum(nb) - nb)[row] + inner % nb[row]
                key = mix(a[i] * U(3) + mix(b[j]))
                cols = [part.column(c).to_numpy()[row] for c in names[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, cols)], names)

    return lists.mapInArrow(of, ", ".join(f"{c} long" for c in names))


def leader_pairs(rows: DataFrame) -> DataFrame:
    """(u, v, n): document v shares n tables with u, the weightiest document there."""
    def of(batches):
        last = leader = None
        for batch in batches:
            key, doc = (batch.column(c).to_numpy() for c in ("key", "doc"))
            if not len(key):
                continue
            at = runs(key)
            head = doc[at].copy()
            if last is not None and key[0] == last:
                head[0] = leader
            lead = np.repeat(head, np.diff(np.append(at, len(key))))
            last, leader = key[-1], lead[-1]
            use = lead != doc
            pairs, n = np.unique(np.stack([lead[use], doc[use]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["u", "v", "n"])

    near = rows.select("key", "doc", "weight").repartition("key").sortWithinPartitions("key", F.desc("weight"), "doc").select("key", "doc")
    return near.mapInArrow(of, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def open_pairs(rows: DataFrame, similar: int) -> DataFrame:
    """Distinct pairs of documents of different components and neighbourhoods that share a
    table and whose set sizes allow the similarity."""
    names = ("key", "doc", "component", "g", "n")

    def pairs_of(doc, component, g, n):
        order = np.argsort(component, kind="stable")
        doc, component, g, n = doc[order], component[order], g[order], n[order]
        after = np.searchsorted(component, component, "right")
        for i in np.flatnonzero(after < len(doc)):
            j = np.arange(after[i], len(doc))
            j = j[(g[j] != g[i]) & (100 * np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j]))]
            if len(j):
                yield np.full(len(j), doc[i]), doc[j]

    def flush(out):
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def of(batches):
        held = [np.zeros(0, np.int64)] * len(names)
        out, size = [], 0
        for batch in [*batches, None]:
            if batch is None:
                cols, end = held, len(held[0])
            else:
                cols = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
                if not len(cols[0]):
                    continue
                end = int(runs(cols[0])[-1])  # the last key may go on in the next batch
            held = [c[end:] for c in cols]
            key, doc, component, g, n = (c[:end] for c in cols)
            at = np.append(runs(key), len(key))
            if len(key):
                apart = np.minimum.reduceat(g, at[:-1]) != np.maximum.reduceat(g, at[:-1])
                for t in np.flatnonzero(apart):
                    s = slice(at[t], at[t + 1])
                    for u, v in pairs_of(doc[s], component[s], g[s], n[s]):
                        out.append(np.stack([u, v], 1))
                        size += len(u)
                        if size > 50_000:
                            yield flush(out)
                            out, size = [], 0
        if out:
            yield flush(out)

    near = rows.repartition("key").sortWithinPartitions("key")
    return near.mapInArrow(of, "u long, v long").distinct()


def shingle_set(text: str, size: int) -> set:
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def links_within(placed: DataFrame, texts: DataFrame, size: int, similar: int) -> DataFrame:
    """Links (u, v) between components of one neighbourhood; placed: (doc, component, g).

    Documents outside the neighbourhood's main component (the largest) look for links among
    all its documents. Both sides are dealt into blocks; a task holds one block of either."""
    sizes = placed.groupBy("g", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("g").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("total"))
    main = main.where(F.col("total") > F.col("m.c")).select("g", F.col("m.component").alias("main"), "total", (F.col("total") - F.col("m.c")).alias("minor"))
    both = placed.join(main, "g").withColumn("is_minor", F.col("component") != F.col("main"))
    blocks, chunks = F.ceil(F.col("total") / BLOCK_DOCS), F.ceil(F.col("minor") / BLOCK_DOCS)
    spread = lambda count: F.explode(F.sequence(F.lit(0), count.cast("int") - 1))
    place = lambda count: F.pmod(F.xxhash64("doc"), count).cast("int")
    all_rows = both.select("g", place(blocks).alias("block"), spread(chunks).alias("chunk"), "doc", "component", F.lit(False).alias("looks"))
    minors = both.where("is_minor").select("g", spread(blocks).alias("block"), place(chunks).alias("chunk"), "doc", "component", F.lit(True).alias("looks"))
    rows = all_rows.unionByName(minors).join(texts.withColumnRenamed("doc_id", "doc"), "doc")

    def compare(table: pa.Table) -> pa.Table:
        doc, component, looks = (table.column(c).to_numpy() for c in ("doc", "component", "looks"))
        sets = [shingle_set(x, size) for x in table.column("text").to_pylist()]
        number: dict = {}
        ids = [np.array([number.setdefault(x, len(number)) for x in s], np.int64) for s in sets]
        n = np.array([len(s) for s in ids])
        among = np.flatnonzero(~looks)
        shingle = np.concatenate([ids[i] for i in among]) if len(among) else np.zeros(0, np.int64)
        owner = np.repeat(among, n[among])
        order = np.argsort(shingle, kind="stable")
        owner, start = owner[order], np.searchsorted(shingle[order], np.arange(len(number) + 1))
        u, v = [], []
        for i in np.flatnonzero(looks):
            hits = np.concatenate([owner[start[s]:start[s + 1]] for s in ids[i]]) if n[i] else owner[:0]
            common = np.bincount(hits, minlength=len(doc))
            found = np.flatnonzero((common > 0) & (100 * common >= similar * (n + n[i] - common)) & (component != component[i]))
            u.append(doc[found])
            v.append(np.full(len(found), doc[i]))
        pairs = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v)]
        return pa.table({"u": pa.array(pairs[0], pa.int64()), "v": pa.array(pairs[1], pa.int64())})

    return rows.groupBy("g", "block", "chunk").applyInArrow(compare, "u long, v long").distinct()


def docs_of(pairs: DataFrame, *sides: str) -> DataFrame:
    """The distinct documents (doc_id) on these sides of the pairs."""
    return functools.reduce(DataFrame.unionByName, (pairs.select(F.col(s).alias("doc_id")) for s in sides)).distinct()


def confirmed(pairs: DataFrame, texts_u: DataFrame, texts_v: DataFrame, size: int, similar: int) -> DataFrame:
    """The pairs (u, v) whose sets of shingles, made of the words themselves, are similar enough.

    A side on which one document may be in very many pairs is given as plain files, whose
    skewed joins Spark splits; one in buckets of doc_id stays where it is."""
    def of(batches):
        last, mine = None, None
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v")), strict=True):
                if a != last:
                    last, mine = a, shingle_set(x, size)
                other = shingle_set(y, size)
                both = len(mine & other)
                if both and 100 * both >= similar * (len(mine) + len(other) - both):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    left = texts_u.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    right = texts_v.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    return pairs.select("u", "v").join(right, "v").join(left, "u").mapInArrow(of, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, similar: int = SIMILAR, tables: int = TABLES, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    A-Z are lower-cased; words are split at ASCII white space; a document's set is its distinct
    ``size``-word shingles, of a shorter one the whole sequence. Links: 100 * intersection >=
    similar * union. component_id is the smallest doc_id reachable. Null, empty and blank texts
    have no shingles and no links. Rows that repeat a doc_id share its component; a null doc_id
    has no component and is kept. Other columns are not looked at."""
    known = saved(sketch(docs, size, tables, rows), "sketch")
    total = known.count()  # bounds the rows of most tables below
    some = known.where("n > 0 and doc_id is not null")
    classes = some.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"))
    stands = classes.withColumnRenamed("rep", "doc_id")
    reps = some.join(stands, ["doc_id", "fp1", "fp2", "n"], "left_semi")

    keys = reps.select(F.col("doc_id").alias("doc"), F.explode(F.concat("a", "b")).alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    side = lambda i: F.collect_list(F.when(F.col("key").bitwiseAND(1) == i, F.col("key")))
    shared = keys.join(often, "key").groupBy("doc").agg(side(0).alias("a"), side(1).alias("b"), F.sum("c").alias("weight"))
    sizes = reps.groupBy("doc_id").agg(F.max("n").alias("n")).withColumnRenamed("doc_id", "doc")
    held = []  # what is deleted once its last reader has been written

    def hold(df: DataFrame, *name: str) -> DataFrame:
        held.append(saved(df, *name))
        return held[-1]

    lists = hold(in_files(shared.where("size(a) > 0 and size(b) > 0").join(sizes, "doc"), total), "lists")
    pairs = hold(in_files(leader_pairs(table_rows(lists, "weight")), tables * tables * total), "pairs")
    involved = hold(in_files(docs_of(pairs, "u", "v"), total), "involved")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    # an inner join, as a semi-join would be pushed down to all texts, before the bitmap
    texts = hold(in_buckets(mostly_in(texts, involved, "doc_id"), "doc_id").join(involved, "doc_id"), "texts", "doc_id")

    def texts_of(pairs: DataFrame, count: int, *sides: str) -> DataFrame:
        return hold(in_files(texts.join(docs_of(pairs, *sides), "doc_id", "left_semi"), min(total, count), WORK_ROWS), "texts")

    best = Window.partitionBy("v").orderBy(F.desc("n"), "u")
    chosen = hold(in_files(pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LEADERS), LEADERS * total), "chosen")
    release(pairs)
    leaders = texts_of(chosen, LEADERS * total, "u")
    links = hold(in_files(confirmed(chosen, leaders, texts, size, similar), LEADERS * total, WORK_ROWS), "confirmed")
    release(leaders)
    around = chosen.where((F.col("r") == 1) & (F.col("n") >= NEAR_TABLES)).select(F.lit("g").alias("of"), "u", "v")
    both = components(links.select(F.lit("component").alias("of"), "u", "v").unionByName(around), "of", rows=(LEADERS + 1) * total)
    of = lambda name: F.max(F.when(F.col("of") == name, F.col("component"))).alias(name)
    both = both.groupBy(F.col("node").alias("doc")).agg(of("component"), of("g"))
    labelled = (lists.join(both, "doc", "left")
                .withColumn("component", F.coalesce("component", "doc")).withColumn("g", F.coalesce("g", "doc")))
    labelled = hold(in_files(labelled, total), "labelled")
    within = hold(links_within(labelled.select("doc", "component", "g"), texts, size, similar), "within")
    apart = hold(open_pairs(table_rows(labelled, "component", "g", "n"), similar), "apart")
    count = apart.count()
    few = texts_of(apart, 2 * count, "u", "v")
    across = hold(in_files(confirmed(apart, few, few, size, similar), count, WORK_ROWS), "across")
    linked = labelled.where("doc != component").select(F.col("component").alias("u"), F.col("doc").alias("v"))
    every = linked.unionByName(within).unionByName(across)
    found = saved(in_files(components(every, rows=every.count()), total), "components")
    release(*held)

    placed = (known.select("doc_id", "n", "fp1", "fp2").join(classes, ["fp1", "fp2", "n"], "left")
              .join(found.withColumnRenamed("node", "rep"), "rep", "left"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), size=2)
