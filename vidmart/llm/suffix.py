"""Exact removal of long byte strings that occurred before, by suffix arrays.

Suffixes are classified as smaller (S) or larger (L) than the one after them; a
leftmost S suffix stands at a local minimum of the bytes. Of the leftmost S places
inside a window, with the 32 bytes after them, the one with the least hash of its first
16 bytes is the window's anchor: it depends on the window alone. Windows that share an anchor go to
the same shard (see repeats.py); a window without any (a run of one byte, say) is
its own anchor.

In a shard the suffix array of its segments is built by induced sorting: the
leftmost S substrings are sorted by one induction and named, the string of names is
sorted by the same procedure, recursively, as long as it has at most ``NAMES`` different
names (beyond that an induction in numpy, one step for each symbol, is slower than ranks
of doubled prefixes, which then sort it instead), and a second induction from the sorted
leftmost S suffixes places all others, bucket by bucket of first bytes. The permuted
common prefix (in text order, with the neighbour in the suffix array) tells which
neighbours share a whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmart.llm.arrays import TOP, U, byte_prefix, gram_hashes, prefix, runs, sliding_min, span
from vidmart.llm.common import documents, text_arrays
from vidmart.llm.repeats import cutter, repeated, segments, sharded, union, windows

WINDOW = 100
GRAM = 32
#: Places that one pass of the anchor search covers; the low bits of a priority hold a place.
BLOCK = 1 << 21
PLACE_BITS = U(22)
#: Bytes of segments in one suffix array.
SHARD_BYTES = 1 << 21
#: A key with more segments than this is dealt out window by window.
HOT_SEGMENTS = 4096
#: Alphabets up to this are sorted by induction, larger ones (of the recursion) by doubling; the order is the same.
NAMES = 2048


# ---- anchors

def local_minima(raw: np.ndarray, gram: int) -> np.ndarray:
    """Leftmost S places whose class the ``gram`` bytes from them, and the byte before, settle."""
    at = runs(raw)
    if len(at) < 3:
        return np.zeros(0, np.int64)
    value = raw[at]
    low = np.flatnonzero((value[:-2] > value[1:-1]) & (value[1:-1] < value[2:])) + 1
    return at[low[at[low + 1] - at[low] < gram]]


def window_anchors(width: int = WINDOW, gram: int = GRAM):
    def find(raw: np.ndarray, offsets: np.ndarray):
        hashes = byte_prefix(raw)
        n = len(raw)
        size = offsets[1:] - offsets[:-1]
        choice = np.full(n, -1, np.int64)
        for base in range(0, max(0, n - width + 1), BLOCK):
            part = raw[base:base + BLOCK + width]
            best = np.full(len(part), TOP, U)
            at = local_minima(part, gram)
            at = at[at + gram <= len(part)]
            rank = gram_hashes(part, at, gram // 2)
            best[at] = (rank >> PLACE_BITS << PLACE_BITS) | at.astype(U)
            least = sliding_min(best[1:], width - gram)[:BLOCK]
            chosen = (least & ((U(1) << PLACE_BITS) - U(1))).view(np.int64)
            chosen += base
            chosen[least == TOP] = -1
            choice[base:base + len(chosen)] = chosen
        text, starts = windows(offsets[:-1], size, width)

        def keys(place, lo):
            own = place < 0
            out = np.empty(len(lo), U)
            out[own], out[~own] = span(hashes, lo[own], lo[own] + width), gram_hashes(raw, place[~own], gram)
            return out

        text, key, seg, lo, hi = segments(choice[starts], lambda at: at, text, starts, hashes, width, keys)
        return text, key, seg, lo - offsets[text], hi - offsets[text]

    return find


# ---- suffix array of a shard

def classify(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; s ends in a unique least symbol."""
    at = runs(s)
    rises = np.concatenate([s[at[1:]] > s[at[:-1]], [True]])
    return np.repeat(rises, np.diff(np.concatenate([at, [len(s)]])))


def induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of s from its leftmost S suffixes in order, one bucket at a time."""
    n = len(s)
    size = np.bincount(s, minlength=alphabet)
    head = np.cumsum(size) - size
    order = np.argsort(s[leftmost], kind="stable")
    seeds = np.split(leftmost[order], np.cumsum(np.bincount(s[leftmost], minlength=alphabet))[:-1])
    n_large = np.bincount(s[~small], minlength=alphabet)
    present = np.flatnonzero(size)
    sa = np.empty(n, np.int64)

    def deal(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Append ``found`` in order to the buckets of their symbols."""
        if not len(found):
            return
        sym = s[found]
        order = np.argsort(sym, kind="stable")
        found, sym = found[order], sym[order]
        first = runs(sym)
        count = np.diff(np.concatenate([first, [len(sym)]]))
        within = np.arange(len(sym)) - np.repeat(first, count)
        sa[at[sym] + step * within] = found
        at[sym[first]] += step * count

    def closure(bucket: np.ndarray, c: int, want: np.ndarray) -> np.ndarray:
        """The bucket's suffixes and those before them, over and over, with the same symbol and class."""
        out, edge = [bucket], bucket
        while len(edge):
            edge = edge[edge > 0] - 1
            edge = edge[(s[edge] == c) & want[edge]]
            out.append(edge)
        return np.concatenate(out)

    large = ~small
    at = head.copy()
    for c in present:  # L suffixes, from the left
        own = closure(sa[head[c]:at[c]], c, large)
        sa[head[c]:head[c] + len(own)] = own
        at[c] = head[c] + len(own)
        scan = np.concatenate([own, seeds[c]])
        before = scan[scan > 0] - 1
        deal(before[large[before] & (s[before] > c)], at, 1)
    at = head + size - 1
    end = head + size
    for c in present[::-1]:  # S suffixes, from the right
        own = closure(sa[at[c] + 1:end[c]][::-1], c, small)
        if c == 0 and not len(own):
            own = np.array([n - 1])
        sa[end[c] - len(own):end[c]] = own[::-1]
        at[c] = end[c] - len(own) - 1
        scan = np.concatenate([own, sa[head[c]:head[c] + n_large[c]][::-1]])
        before = scan[scan > 0] - 1
        deal(before[small[before] & (s[before] < c)], at, -1)
    return sa


def suffix_array(s: np.ndarray, alphabet: int, depth: int | None = None) -> np.ndarray:
    """Suffix array of s, integers below ``alphabet``, of which 0 stands at the end alone.

    depth: suffixes need only be in order by so many symbols."""
    s = s.astype(np.uint16 if alphabet <= 1 << 16 else np.int64)  # short symbols are sorted by digits
    small = classify(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(leftmost) < 2:
        return induce(s, small, leftmost, alphabet)
    rough = induce(s, small, leftmost, alphabet)
    # name the leftmost S substrings in their order
    is_left = np.zeros(len(s), bool)
    is_left[leftmost] = True
    order = rough[is_left[rough]]
    number = np.empty(len(s), np.int64)
    number[leftmost] = np.arange(len(leftmost))
    ends = np.concatenate([leftmost[1:], [len(s) - 1]]) + 1
    hashes = (byte_prefix if alphabet < 1024 else prefix)(s.astype(U))
    content = span(hashes, leftmost, ends)[number[order]]
    length = (ends - leftmost)[number[order]]
    new = np.concatenate([[0], ((content[1:] != content[:-1]) | (length[1:] != length[:-1])).astype(np.int64)])
    names = np.empty(len(leftmost), np.int64)
    names[number[order]] = np.cumsum(new)
    kinds = int(new.sum()) + 1
    if kinds < len(leftmost):
        deep = None if depth is None else depth // 2 + 1  # a name is two symbols or more
        if kinds <= NAMES:
            sub = suffix_array(np.concatenate([names + 1, [0]]), kinds + 1, deep)[1:]
        else:
            sub = doubled(names, deep)
        sorted_left = leftmost[sub]
    else:
        sorted_left = order
    return induce(s, small, sorted_left, alphabet)


def doubled(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string over a large alphabet, by ranks of doubled prefixes."""
    half = (1 << 16) - 1
    rank, k = names + 1, 1
    while True:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-k] = rank[k:]
        # by digits of 16 bits, which are sorted in linear time
        order = np.lexsort([(x >> shift & half).astype(np.uint16) for x in (nxt, rank) for shift in range(0, max(1, len(rank).bit_length()), 16)])
        new = np.concatenate([[True], (rank[order[1:]] != rank[order[:-1]]) | (nxt[order[1:]] != nxt[order[:-1]])])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        k *= 2
        if rank[order[-1]] == len(rank) or k >= len(rank) or (depth and k >= depth):
            return order


def common_windows(raw: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """For each of these places, in order of their suffixes, whether it shares ``width`` bytes with the one before.

    The comparison runs in text order (permuted common prefixes, as far as the window)."""
    phi = np.full(len(raw), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([raw, np.zeros(width + 16, np.uint8)])
    same = np.flatnonzero(phi >= 0)
    done = 0
    while done < width and len(same):
        step = 8 if width - done >= 8 else 1
        view = np.ndarray((len(padded) - 8,), f"<u{step}", padded, strides=(1,))
        same = same[view[same + done] == view[phi[same] + done]]
        done += step
    out = np.zeros(len(raw), bool)
    out[same] = True
    return out[sa]


def earlier_windows(parts: list[bytes], places: np.ndarray, n_windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the parts that also start at an earlier place.

    places: (ord, rid, lo) of each part, by which places are ordered; n_windows: the
    windows that begin each part. Returns part numbers and window numbers."""
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    s = np.append(raw.astype(np.int64) + 2, 0)
    s[begin + sizes - 1] = 1
    sa = suffix_array(s, 258, width)
    part = np.repeat(np.arange(len(parts)), sizes)
    inner = np.arange(len(raw)) - begin[part]
    is_window = np.append(inner < n_windows[part], False)
    at = sa[is_window[sa]]
    group = np.cumsum(~common_windows(raw, at, width))
    several = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
    at, group = at[several], group[several]
    of, off = part[at], inner[at]
    order = np.lexsort((places[of, 2] + off, places[of, 1], places[of, 0], group))
    group, ord_, rid = group[order], places[of[order], 0], places[of[order], 1]
    first = runs(group)
    least = np.repeat(ord_[first], np.diff(np.append(first, len(group)))) if len(group) else ord_
    again = np.concatenate([[False], (group[1:] == group[:-1]) & (rid[1:] == rid[:-1])])[:len(group)]
    hit = order[again | (ord_ > least)]
    return of[hit], off[hit]


# ---- the operator

def pieces(width: int):
    def of(raw: np.ndarray, offsets: np.ndarray):
        data = raw.tobytes()
        return lambda i, lo, hi: data[offsets[i] + lo:offsets[i] + hi + width]
    return of


def removed_bytes(docs: DataFrame, finish, out: T.StructType, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Apply ``finish(batch, spans)`` to every document with the byte spans it loses.

    A byte goes when a ``width``-byte string that covers it also starts earlier: at a smaller
    doc_id (null first), or earlier in the same document; rows that repeat a doc_id take nothing
    from one another. docs: rid, ord (the doc_id as a long), text and any columns
    that finish reads. Null, empty and shorter texts lose nothing."""
    return repeated(docs, window_anchors(width, gram), width, True, cutter(pieces(width), HOT_SEGMENTS),
                    sharded(lambda parts, places, n: earlier_windows(parts, places, n, width), width, SHARD_BYTES), finish, out)


def order_of(doc_id) -> F.Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("ord")


def whole_characters(batch: pa.RecordBatch, spans: list[np.ndarray]) -> list[pa.Array]:
    """(row, text): the text without its spans, shrunk to whole characters; a null text stays null."""
    column = batch.column("text")
    raw, offsets = text_arrays(column)
    inner = (raw & 0xC0) == 0x80  # bytes that go on a character
    data, texts = raw.tobytes(), []
    for i, own in enumerate(spans):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        out, at = [], begin
        for a, b in zip(*(x.tolist() for x in union(own)), strict=True):
            a, b = begin + a, begin + b
            while a < b and inner[a]:
                a += 1
            while b > a and b < end and inner[b]:
                b -= 1
            out.append(data[at:a])
            at = b
        out.append(data[at:end])
        texts.append(b"".join(out).decode() if column[i].is_valid else None)
    return [batch.column("row"), pa.array(texts, pa.string())]


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, any others) with each text cut by removed_bytes(); all rows and columns stay."""
    others = [c for c in docs.columns if c != "text"]
    held = docs.select(F.monotonically_increasing_id().alias("rid"), order_of(F.col("doc_id")), "text", F.struct(*others).alias("row"))
    out = T.StructType().add("row", held.schema["row"].dataType).add("text", "string")
    cut = removed_bytes(held, whole_characters, out, width)
    return cut.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


DIGEST = (T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
          .add("kept_sha256", "string"))


def digest(batch: pa.RecordBatch, spans: list[np.ndarray]) -> list[pa.Array]:
    raw, offsets = text_arrays(batch.column("text"))
    data = raw.tobytes()
    rows = []
    for i, own in enumerate(spans):
        lo, hi = union(own)
        begin, end = int(offsets[i]), int(offsets[i + 1])
        sha, at = hashlib.sha256(), begin
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            sha.update(data[at:begin + a])
            at = begin + b
        sha.update(data[at:end])
        rows.append((end - begin, int((hi - lo).sum()), len(lo), sha.hexdigest()))
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, F.monotonically_increasing_id().alias("rid"), order_of(F.col("doc_id")),
                     F.col("doc_id").cast("long").alias("doc_id"), "text")
    return removed_bytes(docs, digest, DIGEST)
