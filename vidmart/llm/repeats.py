"""Finding windows of fixed length that occur at two places, over any number of documents.

Both substring operators go the same way; they differ in how a window picks its
anchor, in which places lose their text, and in how unequal surroundings are settled.

1. Every window picks one anchor by its own content alone, so equal windows pick
   equal anchors. Neighbouring windows with the same anchor form a segment. A
   segment is (key, seg): hashes of the anchor and of all text that its windows cover.
2. Keys are counted, with their least document and least and greatest seg (combined
   before the shuffle); segments of keys that occur once are dropped: none of their
   windows can repeat.
3. Of equal segments one, the first, stands for all; the others are settled at once.
   So a group of copies, however large, goes on as one segment.
4. Keys with several distinct segments are settled on the text itself: their first
   segments are cut from the documents and compared shard by shard.

The text is moved once, to meet its segments; it is then written in buckets of rid, so
what (4) finds comes to it without moving it again. No step gathers a key: joins on
keys may be split by Spark where a key is hot.

Order: a place is earlier than another at a smaller ord (the doc_id), or earlier in the
same row. Rows that repeat a doc_id stand side by side: none is earlier than another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmart.llm.arrays import U, merged, span
from vidmart.llm.common import saved, slices, text_arrays

ANCHORS = "rid long, ord long, key long, seg long, lo int, hi int, again boolean"
COUNTED = "ord long, key long, seg long"
SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
REPS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()),
                                 T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
REP = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("n", pa.int64())]))


def segments(choice: np.ndarray, place: Callable[[np.ndarray], np.ndarray], text: np.ndarray, starts: np.ndarray,
             hashes: np.ndarray, width: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """Group neighbouring windows of a text that chose the same anchor.

    starts: window starts in rising order; choice: the anchor chosen by each, below 0 where the
    window has none (it then is its own anchor); place(anchors) is where they stand and
    keys(anchors, first starts) what they are. Returns text number, key, seg, first and last start."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none.astype(U), none, none
    new = np.ones(len(starts), bool)  # where a text ends, the next start is ``width`` further on
    new[1:] = (choice[1:] != choice[:-1]) | (choice[1:] < 0) | (starts[1:] - starts[:-1] != 1) | (width == 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, anchor = starts[first], starts[last], choice[first]
    ahead = np.zeros(len(lo), np.int64)
    own = anchor >= 0
    ahead[own] = place(anchor[own]) - lo[own]
    seg = span(hashes, lo, hi + width) ^ (ahead.astype(U) * U(0x9FB21C651E98DF25))
    return text[first], keys(anchor, lo), seg, lo, hi


def windows(first: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and start of every window of texts that begin at ``first`` and have ``size`` symbols."""
    room = np.maximum(size - width + 1, 0)
    text = np.repeat(np.arange(len(size)), room)
    return text, np.arange(room.sum()) + np.repeat(first - np.cumsum(room) + room, room)


def repeats_in_text(text: np.ndarray, key: np.ndarray, seg: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether an equal segment stands earlier in the same text."""
    order = np.lexsort((lo, seg, key, text))
    out = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    out[a] = (text[a] == text[b]) & (key[a] == key[b]) & (seg[a] == seg[b])
    return out


def anchor_rows(docs: DataFrame, find: Callable, columns: str = ANCHORS) -> DataFrame:
    """Segments of every text of docs (rid, doc_id, text); find works on (bytes, offsets)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def rows(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_arrays(batch.column("text"))
            text, key, seg, lo, hi = find(raw, offsets)
            make = {"rid": lambda: batch.column("rid").to_numpy()[text], "ord": lambda: batch.column("ord").to_numpy()[text],
                    "key": lambda: key.view(np.int64), "seg": lambda: seg.view(np.int64), "lo": lambda: lo.astype(np.int32),
                    "hi": lambda: hi.astype(np.int32), "again": lambda: repeats_in_text(text, key, seg, lo)}
            yield pa.RecordBatch.from_arrays([pa.array(make[c]()) for c in names], names)

    return docs.select("rid", "ord", "text").mapInArrow(rows, columns)


def repeated(docs: DataFrame, find: Callable, width: int, keep_first: bool, cut: Callable, solve: Callable,
             finish: Callable, out: T.StructType) -> DataFrame:
    """docs (rid, ord, text, ...) to ``out`` rows, one per document.

    keep_first: the earliest of equal windows stays; else all go. cut(texts, reps) gives the
    segments of step 4 as an Arrow batch of solve's input rows; solve(rows) gives (rid, lo, hi)
    spans; finish(batch, spans) makes the result columns."""
    found = anchor_rows(docs, find)
    counted = anchor_rows(docs, find, COUNTED)
    keys = counted.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("least"), F.min("seg").alias("seg_a"),
                                    F.max("seg").alias("seg_b")).where("n > 1")
    mixed = F.col("seg_a") != F.col("seg_b")
    later = F.col("again") | (F.col("ord") > F.col("least"))
    gone = later if keep_first else F.lit(True)
    # hashed, not sorted: the keys of a partition that occur twice are few beside its segments
    known = saved(found.join(keys.hint("shuffle_hash"), "key").where(mixed | gone)
                  .select("rid", "ord", "key", "seg", "lo", "hi", "again", "n", mixed.alias("mixed")), "segments")
    plain = known.where(~F.col("mixed")).select("rid", "lo", "hi", "key", "n", F.lit(True).alias("gone"), F.lit(False).alias("rep"))
    several = known.where("mixed")
    firsts = several.groupBy("key", "seg").agg(F.min("ord").alias("least"), F.count("*").alias("same"))
    several = several.join(firsts, ["key", "seg"]).select(
        "rid", "lo", "hi", "key", "n", (later if keep_first else F.col("same") > 1).alias("gone"), (~later).alias("rep"))
    per_doc = plain.unionByName(several).groupBy("rid").agg(
        F.collect_list(F.when(F.col("gone"), F.struct("lo", (F.col("hi") + width).alias("hi")))).alias("gone"),
        F.collect_list(F.when(F.col("rep"), F.struct("lo", "hi", "key", "n"))).alias("reps"))

    base = [f for f in docs.schema if f.name != "rid"]
    names = ["rid", *(f.name for f in base)]
    fields = T.StructType([*(T.StructField("o_" + f.name, f.dataType) for f in out),
                           T.StructField("rid", T.LongType()),
                           *(T.StructField(f.name, f.dataType) for f in base),
                           T.StructField("gone", SPANS), T.StructField("reps", REPS)])

    def settle(batches):
        for batch in batches:
            spans = spans_of(batch.column("gone"))
            reps = batch.column("reps")
            open_ = np.array([bool(n) for n in _lengths(reps)], bool)
            results = finish(batch, spans)
            mask = pa.array(open_)
            # a settled document goes on as its result alone, an open one as its text
            cols = [_null_where(c, mask) for c in results]
            cols.append(batch.column("rid"))
            cols += [_null_where(batch.column(f.name), pa.array(~open_)) for f in base]
            cols += [_null_where(_spans_column(spans), pa.array(~open_)), _null_where(reps.cast(REP), pa.array(~open_))]
            yield pa.RecordBatch.from_arrays(cols, names=fields.names)

    met = saved(docs.join(per_doc, "rid", "left").select(*names, "gone", "reps").mapInArrow(settle, fields), "settled", bucket="rid")
    done = met.where(F.col("reps").isNull()).select(*(F.col("o_" + f.name).alias(f.name) for f in out))
    open_docs = met.where(F.col("reps").isNotNull()).select(*names, "gone", "reps")
    marks = solve(open_docs.select("rid", "ord", "text", "reps").mapInArrow(cut, cut.schema))
    marks = marks.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))

    def close(batches):
        for batch in batches:
            spans = [np.concatenate(x) for x in zip(spans_of(batch.column("gone")), spans_of(batch.column("more")), strict=True)]
            yield pa.RecordBatch.from_arrays(finish(batch, spans), names=out.names)

    last = (open_docs.drop("reps").join(marks, "rid", "left").select(*names, "gone", "more")
            .mapInArrow(close, out))
    return done.unionByName(last)


CUT = "key long, sub long, ord long, rid long, lo int, n int, bytes binary"
CUT_NAMES = ["key", "sub", "ord", "rid", "lo", "n", "bytes"]
CUT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def cutter(pieces: Callable, hot: int):
    """Cut the segments of step 4 out of their texts; a hot key's go window by window, by content.

    pieces(raw, offsets) gives a function (row, first window, last window) -> bytes."""
    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), CUT_KINDS, strict=True)], CUT_NAMES)

    def cut(batches):
        for batch in slices(batches, "text"):
            piece = pieces(*text_arrays(batch.column("text")))
            rows = []
            for i, (ord_, rid, reps) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ord", "rid", "reps")), strict=True)):
                for r in reps:
                    lo, hi = r["lo"], r["hi"]
                    if r["n"] <= hot:
                        rows.append((r["key"], 0, ord_, rid, lo, hi - lo + 1, piece(i, lo, hi)))
                        continue
                    for at in range(lo, hi + 1):
                        window = piece(i, at, at)
                        sub = int.from_bytes(hashlib.blake2b(b" ".join(window.split()), digest_size=7).digest(), "little") + 1
                        rows.append((r["key"], sub, ord_, rid, at, 1, window))
                if len(rows) > 5000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    cut.schema = CUT
    return cut


def sharded(local: Callable, width: int, shard_bytes: int):
    """local(parts, places, windows) -> (part numbers, window numbers) to spans, shard by shard.

    Segments meet by (key, sub), in order; a shard takes whole groups until it is full. Only a
    group of a hot key's equal windows can be longer: its first window stands for those before."""
    def solve(rows: DataFrame) -> DataFrame:
        met = rows.repartition(F.col("key"), F.col("sub")).sortWithinPartitions("key", "sub", "ord", "rid", "lo")

        def spans(held):
            places = np.array([r[:3] for r in held], np.int64)
            part, at = local([r[4] for r in held], places, np.array([r[3] for r in held], np.int64))
            if len(part):
                lo = places[part, 2] + at
                yield pa.RecordBatch.from_arrays([pa.array(places[part, 1]), pa.array(lo.astype(np.int32)),
                                                  pa.array((lo + width).astype(np.int32))], ["rid", "lo", "hi"])

        def shards(batches):
            held, size, last, first = [], 0, None, None
            for batch in batches:
                for key, sub, *row in zip(*(batch.column(c).to_pylist() for c in CUT_NAMES), strict=True):
                    if (key, sub) != last:
                        if size >= shard_bytes:
                            yield from spans(held)
                            held, size = [], 0
                        last, first = (key, sub), row
                    elif sub and size >= shard_bytes:
                        yield from spans(held)
                        held, size = [first], len(first[4])
                    held.append(row)
                    size += len(row[4]) + 1
            if held:
                yield from spans(held)

        return met.mapInArrow(shards, "rid long, lo int, hi int")

    return solve


def _lengths(lists: pa.Array) -> list[int]:
    return [0 if n is None else n for n in lists.value_lengths().to_pylist()]


def spans_of(lists: pa.Array) -> list[np.ndarray]:
    """A column of interval lists as one (n, 2) array for each row; null: none."""
    flat = lists.flatten()
    both = np.stack([flat.field("lo").to_numpy(zero_copy_only=False), flat.field("hi").to_numpy(zero_copy_only=False)], 1).astype(np.int64) \
        if len(flat) else np.zeros((0, 2), np.int64)
    return np.split(both, np.cumsum(_lengths(lists))[:-1]) if len(lists) else []


def _spans_column(spans: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(spans).astype(np.int32) if spans else np.zeros((0, 2), np.int32)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(SPAN.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), both, type=SPAN)


def _null_where(column: pa.Array, mask: pa.Array) -> pa.Array:
    import pyarrow.compute as pc
    return pc.take(column, pa.array(np.where(np.asarray(mask), -1, np.arange(len(column))), pa.int64(),
                                    mask=np.asarray(mask)))


def union(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return merged(spans[:, 0], spans[:, 1])
