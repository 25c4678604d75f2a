"""Finding repeated word windows by recompression.

Each round first replaces every maximal run of one symbol by a symbol of its own,
then every neighbouring pair whose first symbol is in the left half of the alphabet
and whose second is in the right half. A symbol's name is the hash of what it stands
for and its half one bit of the name, the same on every machine, so equal word
sequences get the same symbols but for a few at their ends, and naming needs no
exchange. With every symbol go the words that decided it: its own and those of the
neighbours that it was compared with. A symbol all of whose deciding words lie inside
a window is there in every equal window, wherever that stands.

After three rounds the window's anchor is the decided symbol with the least hash; its
key is the hash of the deciding words. A window without one is its own anchor.
Symbols that occur once end the matter for their windows; shared ones lead to the
comparison of their windows' words (repeats.py). Runs are why no word is too common:
a long run of one word is one symbol, and the windows inside it are their own anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmart.llm.arrays import TOP, U, mix, prefix, span, word_hashes, word_spans
from vidmart.llm.common import documents, text_arrays
from vidmart.llm.repeats import cutter, repeated, segments, sharded, union, windows
from vidmart.llm.suffix import order_of

WINDOW = 35
ROUNDS = 3
#: Low bits of a priority that number a symbol within a batch of texts.
NUMBER_BITS = U(24)
#: Bytes of segments compared at a time.
SHARD_BYTES = 1 << 21
#: A key with more segments than this is dealt out window by window.
HOT_SEGMENTS = 4096


def round_of(name, text, lo, hi, left, right, salt: int):
    """One round: runs, then pairs. Symbols are names over words [lo, hi), decided by [left, right)."""
    # runs; at the edge of a text nothing decides, so the symbol reaches beyond it
    n = len(name)
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    size = (last - first + 1).astype(U)
    run = np.where(size > 1, mix(name[first] ^ (size * U(0xA24BAED4963EE407))), name[first])
    name, text, lo, hi, left, right = (run, text[first], lo[first], hi[last], *beside(text, left, right, first, last))
    # pairs
    n = len(name)
    is_left = (mix(name ^ U(salt)) & U(1)).astype(bool)
    joins = np.concatenate([is_left[:-1] & ~is_left[1:] & (text[1:] == text[:-1]), [False]])
    second = np.concatenate([[False], joins[:-1]])
    first = np.flatnonzero(~second)
    last = first + joins[first]
    pair = np.where(joins[first], mix(name[first] * U(3) + mix(name[last] + U(salt))), name[first])
    return pair, text[first], lo[first], hi[last], *beside(text, left, right, first, last)


def beside(text, left, right, first, last):
    """Deciding words of symbols first..last: those of the neighbours too; none decide at an edge."""
    n = len(text)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    far = np.int64(1) << 60
    at_start = (first == 0) | (text[before] != text[first])
    at_end = (last == n - 1) | (text[after] != text[last])
    return np.where(at_start, -far, left[before]), np.where(at_end, far, right[after])


def symbols(words: np.ndarray, text: np.ndarray, rounds: int = ROUNDS):
    """Symbols after the rounds: names, and their deciding words [left, right)."""
    at = np.arange(len(words))
    state = (words, text, at, at + 1, at, at + 1)
    for k in range(rounds):
        if not len(state[0]):
            break
        state = round_of(*state, salt=0x51ED270B * (k + 1))
    return state


def window_anchors(width: int = WINDOW, rounds: int = ROUNDS):
    def find(raw: np.ndarray, offsets: np.ndarray):
        words, text, _, _ = word_hashes(raw, offsets)
        hashes = prefix(words)
        n = len(words)
        first_word = np.searchsorted(text, np.arange(len(offsets) - 1))
        size = np.diff(np.append(first_word, n))
        of, starts = windows(first_word, size, width)
        name, _, _, _, left, right = symbols(words, text, rounds)
        use = (left >= 0) & (right <= n) & (right - left <= width)
        left, right = left[use], right[use]
        content = span(hashes, left, right) ^ name[use]
        rank = (mix(content) >> NUMBER_BITS << NUMBER_BITS) | np.arange(len(left)).astype(U)
        best = np.full(n + 1, TOP, U)
        lo, hi = np.maximum(right - width, 0), left
        for k in range(int((hi - lo).max()) + 1 if len(lo) else 0):
            live = lo + k <= hi
            np.minimum.at(best, lo[live] + k, rank[live])
        chosen = (best & ((U(1) << NUMBER_BITS) - U(1))).astype(np.int64)
        chosen[best == TOP] = -1

        def keys(anchor, lo):
            out = span(hashes, lo, lo + width)
            out[anchor >= 0] = content[anchor[anchor >= 0]]
            return out

        text, key, seg, lo, hi = segments(chosen[starts], lambda at: left[at], of, starts, hashes, width, keys)
        return text, key, seg, lo - first_word[text], hi - first_word[text]

    return find


def pieces(width: int):
    def of(raw: np.ndarray, offsets: np.ndarray):
        data = raw.tobytes()
        starts, ends, text = word_spans(raw, offsets)
        first = np.searchsorted(text, np.arange(len(offsets) - 1))
        return lambda i, lo, hi: data[starts[first[i] + lo]:ends[first[i] + hi + width - 1]]
    return of


def equal_windows(parts: list[bytes], n_windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the parts whose words also begin another window; compared word by word.

    The first n_windows[i] windows of part i count. Returns part numbers and window numbers."""
    words = [p.split() for p in parts]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for part in words for w in part], np.int64)
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size) - size
    part, at = windows(begin, np.minimum(size, n_windows + width - 1), width)
    if len(at) < 2:
        return part[:0], at[:0]
    hashes = span(prefix(mix(ids.astype(U) + U(1))), at, at + width)
    order = np.argsort(hashes, kind="stable")
    view = np.lib.stride_tricks.sliding_window_view(ids, width)
    near = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    near = near[(view[at[order[near + 1]]] == view[at[order[near]]]).all(1)]
    hit = np.zeros(len(at), bool)
    hit[order[near]] = hit[order[near + 1]] = True
    return part[hit], at[hit] - begin[part[hit]]


def removed_words(docs: DataFrame, finish, out: T.StructType, width: int = WINDOW) -> DataFrame:
    """Apply ``finish(batch, spans)`` to every document with the word spans it loses.

    A word goes when a window of ``width`` words that covers it also starts anywhere else; all
    of the equal windows lose their words. Rows that repeat a doc_id are documents of their own.
    docs: rid, ord (the doc_id as a long), text and any columns that finish reads. Null, empty
    and shorter texts lose nothing."""
    return repeated(docs, window_anchors(width), width, False, cutter(pieces(width), HOT_SEGMENTS),
                    sharded(lambda parts, places, n: equal_windows(parts, n, width), width, SHARD_BYTES), finish, out)


DIGEST = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")


def digest(batch: pa.RecordBatch, spans: list[np.ndarray]) -> list[pa.Array]:
    raw, offsets = text_arrays(batch.column("text"))
    data = raw.tobytes()
    rows = []
    for i, own in enumerate(spans):
        words = data[offsets[i]:offsets[i + 1]].split()
        lo, hi = union(own)
        kept, at = [], 0
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            kept += words[at:a]
            at = b
        kept += words[at:]
        rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, F.monotonically_increasing_id().alias("rid"), order_of(F.col("doc_id")),
                     F.col("doc_id").cast("long").alias("doc_id"), "text")
    return removed_words(docs, digest, DIGEST)
