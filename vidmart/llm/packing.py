"""Packing documents into token sequences by bin completion with branch and bound.

Items are whole numbers of at most the capacity, so all that packing needs to know
is how many pieces there are of each length: at most ``capacity`` counts, however
many documents there are. The plan is made from these counts:

* A whole best-fit-decreasing packing is the first incumbent, and a lower bound
  (the best of Martello and Toth's L2 over all thresholds) tells when to stop.
* A node of the search is the largest remaining length; its branches are the
  fillings of the rest of that sequence, least waste first. A filling is
  dominated, and left out, if a remaining piece fits into its waste, or can
  stand in for one or two of its pieces that are together not longer.
* A branch is cut when its waste so far is more than a better packing may have.
  The first descent takes the least wasteful filling each time, as often as the
  counts allow; it replaces the incumbent if it is not worse. Then the search
  goes back, for ``BRANCHES`` more nodes at most; ``least_sequences`` tells how
  far the result can be from the best one.

Pieces get their place by their rank among the pieces of the same length,
counted in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidmart.llm.bpe import word_bpe
from vidmart.llm.common import documents, in_files, saved

CAPACITY = 4096
END_ID = 1
#: Nodes of the search for one sequence's fillings; those found so far stand when they are used up.
SEARCH_NODES = 4000
#: Nodes (sequences filled in another way) after the first descent; the incumbent stands when they are used up.
BRANCHES = 500
#: Pieces of one length that are ranked in one group.
RANK_BLOCK = 50_000


def best_fit(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Longest piece that fits, again and again."""
    out, used = [], {}
    while room > 0:
        i = bisect_right(lengths, room) - 1
        while i >= 0 and counts[lengths[i]] - used.get(lengths[i], 0) <= 0:
            i -= 1
        if i < 0:
            break
        x = lengths[i]
        out.append(x)
        used[x] = used.get(x, 0) + 1
        room -= x
    return out


def complete(room: int, lengths: list[int], counts: dict[int, int], nodes: int = SEARCH_NODES) -> list[int]:
    """The filling of ``room`` with the least waste that the search finds; longer pieces win ties."""
    best = best_fit(room, lengths, counts)
    waste = room - sum(best)
    left = nodes
    prefix = [0]
    for x in lengths:  # all that is left up to each length bounds a branch from below
        prefix.append(prefix[-1] + x * counts[x])

    def search(room: int, top: int, taken: list[int]) -> None:
        nonlocal best, waste, left
        if room < waste:
            best, waste = list(taken), room
        i = bisect_right(lengths, room, 0, top) - 1
        while i >= 0 and waste > 0 and left > 0:
            if room - prefix[i + 1] >= waste:
                return
            left -= 1
            x = lengths[i]
            for use in range(min(counts[x], room // x), 0, -1):
                taken.extend([x] * use)
                search(room - use * x, i, taken)
                del taken[-use:]
                if not waste or left <= 0:
                    return
            i -= 1

    if waste:
        search(room, len(lengths), [])
    return best


def dominated(fill: list[int], slack: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether a remaining piece fits beside ``fill``, or for one or two of its pieces in their place."""
    used = Counter(fill)
    kinds = sorted(used)
    sums = {0, *kinds, *(x + y for i, x in enumerate(kinds) for y in kinds[i:] if x != y or used[x] > 1)}
    for total in sums:
        # alike pieces change nothing, so a single piece gives way to a longer one alone
        i = bisect_right(lengths, total) if total in used else bisect_left(lengths, total)
        while i < len(lengths) and lengths[i] <= total + slack:
            if counts[lengths[i]] > used[lengths[i]]:
                return True
            i += 1
    return False


def fillings(room: int, lengths: list[int], counts: dict[int, int], waste: int, nodes: int = SEARCH_NODES) -> list[list[int]]:
    """Undominated fillings of ``room`` that waste ``waste`` at most, least waste first; longer pieces win ties."""
    out: list[tuple[int, list[int]]] = []
    prefix = [0]
    for x in lengths:
        prefix.append(prefix[-1] + x * counts[x])
    # what is still to try: (room, pieces up to this index, pieces taken)
    open_nodes = [(room, len(lengths), [])]
    while open_nodes and nodes > 0:
        nodes -= 1
        left, top, taken = open_nodes.pop()
        if left <= waste and not dominated(taken, left, lengths, counts):
            out.append((left, taken))
        more = []
        for i in range(bisect_right(lengths, left, 0, top) - 1, -1, -1):
            if left - prefix[i + 1] > waste:
                break
            x = lengths[i]
            more += [(left - use * x, i, [*taken, *[x] * use]) for use in range(min(counts[x], left // x), 0, -1)]
            if len(more) >= nodes:
                break
        open_nodes.extend(reversed(more))
    return [taken for _, taken in sorted(out, key=lambda f: (f[0], [-x for x in f[1]]))]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing needs fewer sequences: for each threshold, pieces that leave less than it are alone,
    and what the other large ones leave is filled up with pieces of at least the threshold."""
    n = np.zeros(capacity + 1, np.int64)
    for x, c in counts.items():
        n[x] = c
    many, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    large = many[capacity] - many[half]
    paired, paired_size = many[capacity - k] - many[half], size[capacity - k] - size[half]
    below = np.where(k > 0, size[np.maximum(k - 1, 0)], 0)
    over = size[half] - below - (paired * capacity - paired_size)
    return int((large + np.maximum(0, -(-over // capacity))).max())


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Each piece, longest first, into the fullest sequence that has room; sequences alike are held once."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}  # room left -> sequences, by pattern
    free: list[int] = []                                     # the rooms, sorted

    def put(pattern: dict[int, int], room: int, times: int) -> None:
        if times:
            if room not in rooms:
                insort(free, room)
            rooms.setdefault(room, []).append((pattern, times))

    for x in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        n = counts[x]
        while n:
            i = bisect_left(free, x)
            room = free[i] if i < len(free) else capacity
            pattern, times = rooms[room].pop() if i < len(free) else ({}, n)
            if i < len(free) and not rooms[room]:
                del rooms[room], free[i]
            each = room // x                                  # a sequence stays the fullest until x fits no more
            full = min(times, n // each)
            put({**pattern, x: each}, room - each * x, full)
            n -= full * each
            rest = times - full
            if rest and n and n < each:
                put({**pattern, x: n}, room - n * x, 1)
                rest, n = rest - 1, 0
            if pattern:
                put(pattern, room, rest)
    return [entry for held in rooms.values() for entry in held]


def sequences(plan: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in plan)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES,
              branches: int = BRANCHES) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each length, number of such sequences)] for pieces counted by length."""
    counts = {x: n for x, n in counts.items() if n > 0}
    best, least = best_fit_decreasing(counts, capacity), lower_bound(counts, capacity)
    size, total = sequences(best), sum(x * n for x, n in counts.items())
    lengths = sorted(counts)
    path: list[tuple[dict[int, int], int]] = []
    wasted, descending = 0, True
    others: list = []  # for each step of the path the branches not taken yet

    def take(fill: list[int], times: int) -> None:
        nonlocal wasted
        pattern = dict(Counter(fill))
        path.append((pattern, times))
        wasted += times * (capacity - sum(fill))
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                lengths.remove(x)

    def give_back() -> None:
        nonlocal wasted
        pattern, times = path.pop()
        wasted -= times * (capacity - sum(x * n for x, n in pattern.items()))
        for x, n in pattern.items():
            if not counts[x]:
                insort(lengths, x)
            counts[x] += n * times

    def often(fill: list[int]) -> int:
        return min(counts[x] // n for x, n in Counter(fill).items())

    def choices(first: list[int] | None):
        """(filling, times) at this node: each filling as often as it can be, then once; ``first`` was tried."""
        top = lengths[-1]
        counts[top] -= 1
        found = fillings(capacity - top, [x for x in lengths if counts[x]], counts, (size - 1) * capacity - total - wasted, nodes)
        counts[top] += 1
        for fill in ([top, *f] for f in found):
            if fill != first:
                yield fill, often(fill)
            if often(fill) > 1:
                yield fill, 1

    while True:
        allowed = (size if descending else size - 1) * capacity - total
        if not lengths and wasted <= allowed:
            best, size = list(path), sequences(path)
        if lengths and wasted <= allowed and (descending or branches > 0):
            if descending:
                top = lengths[-1]
                counts[top] -= 1
                fill = [top, *complete(capacity - top, [x for x in lengths if counts[x]], counts, nodes)]
                counts[top] += 1
                others.append(fill)  # its other choices are looked for when the search comes back
                take(fill, often(fill))
                continue
            others.append(choices(None))
        elif descending and not lengths:
            descending = False
        descending = False
        step = None
        while others and size > least and branches > 0:
            if len(path) == len(others):
                give_back()
            if isinstance(others[-1], list):
                others[-1] = choices(others[-1])
            step = next(others[-1], None)
            if step:
                break
            others.pop()
        if not step:
            return best
        branches -= 1
        take(*step)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids with ``end_id`` after them."""
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches):
        bpe = word_bpe(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = bpe.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                                             if rows else [pa.array([], k) for k in kinds], names)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES, branches: int = BRANCHES) -> DataFrame:
    """Give every piece (any columns, with ``length`` from 1 to ``capacity``) a sequence_id and offset;
    ``least_sequences``, the same in all rows, is the number that no packing of them can go below.

    No pieces: no rows. Ties in length go by place in the written pieces. The counts by
    length, at most ``capacity`` of them, are all that reaches the driver."""
    held = saved(pieces.withColumn("_pid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, capacity, nodes, branches)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, per sequence, first sequence, offset)
    used: dict[int, int] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for x, n in pattern.items():
            slots.setdefault(x, []).append((used.get(x, 0), n, first, offset))
            used[x] = used.get(x, 0) + n * times
            offset += n * x
        first += times
    tables = {x: np.array(v, np.int64) for x, v in slots.items()}

    blocks = max(1, sum(histogram.values()) // RANK_BLOCK)
    held = held.withColumn("_block", F.pmod(F.xxhash64("_pid"), F.lit(blocks)))
    sizes = held.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_block").orderBy("_pid")) - 1
    ranked = (held.withColumn("_rank", rank).join(sizes, ["length", "_block"])
              .withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_block", "_base", "_pid"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, table = np.flatnonzero(length == x), tables[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * x
            cols = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)],
                                             [*(c for c in batch.schema.names if c != "_rank"), "sequence_id", "offset"])

    fields = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    placed = in_files(ranked, sum(histogram.values())).mapInArrow(place, fields)
    return placed.withColumn("least_sequences", F.lit(lower_bound(histogram, capacity)).cast("bigint"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise every whole text (null: empty, so only the end id) and pack the pieces.

    Rows that repeat a doc_id are documents of their own; columns other than doc_id and
    text are not looked at; an empty table gives no rows."""
    out = pack(token_pieces(docs, path, capacity, end_id), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "least_sequences")


def op9_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))
