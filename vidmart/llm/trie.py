"""Trie of conversation prefixes, by node tables with minimal perfect hashes.

1. The turns are dealt out by family (conversations whose beginnings mix) and streamed in
   order. A prefix is named by a running 128-bit digest of its turns' SHA-256, so a task
   holds one digest, the few first turns of a family's base, and one output batch.
2. One aggregate by digest enumerates the nodes: smallest member, members, text bytes. It
   also checks that no digest stands for two prefixes, and stops if one does.
3. Sums over subtrees. A node with one member has one leaf below it and saves nothing, so
   only shared nodes are summed up. They are cut into pieces: layer j holds the nodes with
   more than PIECE**j and up to PIECE**(j+1) members, a piece is a part of one layer that
   hangs together, so it has at most PIECE nodes of each depth, however hot its first
   turns are. Pieces of a layer are dealt out by their top node. A task gives its digests
   slots by a minimal perfect hash (the digest in a slot is compared, which also tells a
   parent of another piece), scatters counts into flat arrays by slot, and adds them up
   through the array of parent slots, deepest first. The tops' sums go to their parents in
   the next layer; there are log(members) / log(PIECE) layers.
4. Conversations that end at a node: ids are put together in blocks of ``BLOCK_IDS`` first,
   then the blocks are hashed as a stream, so many copies of one conversation never meet
   as a list.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidmart.llm.arrays import U
from vidmart.llm.common import saved
from vidmart.llm.slots import Slots

FAMILY, MOST_SHARED = 5, 9
PIECE = 1024
#: Shared nodes of one task on average.
SHARD_NODES = 200_000
BLOCK_IDS = 4096
ROOT = bytes(16)
PREFIXES = "conv long, depth long, d1 long, d2 long, p1 long, p2 long, bytes long, ended boolean, turn long"


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class _Rebuild:
    """Streams turns in order of (family, base first, conv, turn) into the prefixes of rebuilt conversations."""

    def __init__(self):
        self.rows, self.family, self.base, self.conv = [], None, [], None

    def turn(self, family: int, conv: int, shared: int, digest: bytes, size: int) -> None:
        if family != self.family:
            self.finish()
            self.family, self.base = family, []
        if conv != self.conv:
            self.finish()
            self.conv, self.own, self.digest, self.depth = conv, 0, ROOT, 0
            self.last = (conv, 0, 0, 0, None, None, 0, False, None)
            if conv != family:
                for x in self.base[:shared]:
                    self.extend(*x)
        if conv == family and len(self.base) < MOST_SHARED:
            self.base.append((digest, size))
        self.own += 1
        if conv == family or self.own > shared:
            self.extend(digest, size)

    def extend(self, digest: bytes, size: int) -> None:
        self.rows.append(self.last)
        above, self.digest = self.digest, hashlib.blake2b(self.digest + digest, digest_size=16).digest()
        self.depth += 1
        self.last = (self.conv, self.depth, *_halves(self.digest), *_halves(above), size, False, int.from_bytes(digest[:8], "little", signed=True))

    def finish(self) -> None:
        if self.conv is not None:
            self.rows.append((*self.last[:7], True, self.last[8]))
            self.conv = None

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64()]
        names = [x.split()[0] for x in PREFIXES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, d1, d2, p1, p2, bytes, ended, turn): every prefix of every rebuilt conversation."""
    def of(batches):
        state = _Rebuild()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("family", "conv", "shared", "digest", "bytes")), strict=True):
                state.turn(*row)
                if len(state.rows) >= 10_000:
                    yield state.taken()
        state.finish()
        if state.rows:
            yield state.taken()

    conv = F.col("conv")
    rows = turns.select(conv, (conv - conv % FAMILY).alias("family"), (F.crc32(conv.cast("string")) % MOST_SHARED).alias("shared"), "turn", "digest", "bytes")
    return (rows.repartition("family").sortWithinPartitions("family", F.col("conv") != F.col("family"), "conv", F.asc_nulls_first("turn"), "digest", "bytes")
            .mapInArrow(of, PREFIXES))


def _turns(rows: DataFrame) -> DataFrame:
    """(conv, turn, digest, bytes): what a prefix needs of a turn, texts left behind."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # the role's length keeps ("ab", "c") and ("a", "bc") apart
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(content, 256)).alias("digest"),
                                                    F.octet_length(text).cast("long").alias("bytes"))


def _nodes(prefixes: DataFrame) -> DataFrame:
    name = F.xxhash64("depth", "p1", "p2", "turn", "bytes")
    one = F.when(F.col("least") == F.col("most"), F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes have the same digest")).cast("long"))
    return (prefixes.groupBy("d1", "d2").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("depth").alias("depth"), F.min("p1").alias("p1"),
                                             F.min("p2").alias("p2"), F.min("bytes").alias("bytes"), F.min(name).alias("least"), F.max(name).alias("most"))
            .withColumn("depth", one).drop("least", "most"))


def _ends(prefixes: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the nodes at which a conversation ends."""
    def of(batches):
        key, sha, out = None, None, []
        for batch in batches:
            for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
                if (d1, d2) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d1, d2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if key is not None:
            yield batch_of([*out, (*key, sha.hexdigest())])

    def batch_of(rows):
        d1, d2, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha)], ["d1", "d2", "ends_sha256"])

    block = F.floor(F.col("conv") / F.lit(BLOCK_IDS)).cast("long")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = prefixes.where("ended").groupBy("d1", "d2", block.alias("block")).agg(ids.alias("ids"))
    return blocks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "block").select("d1", "d2", "ids").mapInArrow(of, "d1 long, d2 long, ends_sha256 string")


def _layer(piece: int) -> "F.Column":
    """The layer of a shared node: the number of powers of ``piece`` below its members."""
    layer, power = F.lit(0), piece
    while power < 1 << 62:
        layer, power = layer + (F.col("n") > F.lit(power)).cast("int"), power * piece
    return layer


def add_up(depth: np.ndarray, own: np.ndarray, parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over subtrees of the nodes whose digests are the rows of ``own``.

    parent holds digests too; a parent that is no row of ``own`` ends a tree."""
    slots = Slots(own)
    at = slots.lookup(own)
    above, level = np.full(len(own), -1), np.zeros(len(own), np.int64)
    total = np.zeros((len(own), values.shape[1]), np.int64)
    above[at], level[at], total[at] = slots.lookup(parent), depth, values
    order = np.argsort(-level, kind="stable")
    edges = np.flatnonzero(np.diff(level[order])) + 1
    for nodes in np.split(order, edges):
        inner = nodes[above[nodes] >= 0]
        np.add.at(total, above[inner], total[inner])
    return total[at]


def _sums(nodes: DataFrame, tops: int) -> DataFrame:
    """(d1, d2, p1, p2, is_top, leaves, saved) of one layer's nodes, pieces dealt over ``tops`` tasks."""
    names = ["d1", "d2", "p1", "p2", "is_top", "leaves", "saved"]

    def of(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        col = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("d1", "d2", "p1", "p2", "r1", "r2", "depth", "leaves", "saved")}
        digests = lambda a, b: np.stack([col[a], col[b]], 1).view(U)
        sums = add_up(col["depth"], digests("d1", "d2"), digests("p1", "p2"), np.stack([col["leaves"], col["saved"]], 1))
        top = (col["d1"] == col["r1"]) & (col["d2"] == col["r2"])
        for lo in range(0, len(top), 50_000):
            s = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([*(pa.array(col[c][s]) for c in ("d1", "d2")), *(pa.array(col[c][s], mask=col["depth"][s] == 0) for c in ("p1", "p2")),
                                              pa.array(top[s]), pa.array(sums[s, 0]), pa.array(sums[s, 1])], names)

    dealt = nodes.withColumn("p1", F.coalesce("p1", F.lit(0))).withColumn("p2", F.coalesce("p2", F.lit(-1))).repartition(tops, "r1", "r2")
    return dealt.mapInArrow(of, "d1 long, d2 long, p1 long, p2 long, is_top boolean, leaves long, saved long")


def _subtrees(nodes: DataFrame, prefixes: DataFrame, piece: int) -> DataFrame:
    """(d1, d2, leaves, saved) of the shared nodes; nodes: with n_children and n_single."""
    shared = nodes.where("n > 1").withColumn("layer", _layer(piece))
    # the top of a node's piece is the first node of its layer on the way of its smallest member
    owners = shared.select("conv").distinct()
    own_way = (prefixes.select("conv", "depth", "d1", "d2").join(owners, "conv", "left_semi")
               .join(shared.select("d1", "d2", "layer", F.col("conv").alias("owner")), ["d1", "d2"]))
    first = Window.partitionBy("conv", "layer").orderBy("depth")
    tops = (own_way.withColumn("r1", F.first("d1").over(first)).withColumn("r2", F.first("d2").over(first))
            .where("conv = owner").select("d1", "d2", "r1", "r2"))
    leaves = F.col("n_single") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    placed = saved(shared.join(tops, ["d1", "d2"]).select("d1", "d2", "p1", "p2", "r1", "r2", "depth", "layer", leaves.cast("long").alias("leaves"),
                                                            ((F.col("n") - 1) * F.col("bytes")).alias("saved")), "placed")
    out, below = None, None
    for layer, count in sorted(map(tuple, placed.groupBy("layer").count().collect())):
        rows = placed.where(F.col("layer") == layer)
        if below is not None:
            rows = (rows.join(below, ["d1", "d2"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0)))
                    .withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s"))
        done = saved(_sums(rows, max(1, -(-count // SHARD_NODES))), "sums")
        up = done.where("is_top and p1 is not null").select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        up = up if below is None else up.unionByName(below)
        below = up.groupBy("d1", "d2").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
        rows = done.select("d1", "d2", "leaves", "saved")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else nodes.where("false").select("d1", "d2", F.col("n").alias("leaves"), F.col("n").alias("saved"))


def prefix_trie(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    rows: (conv_id, turn, role, text). A conversation's turns go by turn, null first; rows of
    the same turn by the digest of role and text, so repeated rows are turns of their own and
    the result does not depend on the order of reading. Conversation c is rebuilt from the
    first crc32(c) % 9 turns of c - c % 5 (remainder with the sign of c) and its own turns
    after its first that many. Null role or text is empty; rows with a null conv_id belong to
    no conversation and are left out. Without conversations there is no node. A conversation
    passes through one task as a stream, of which only a digest is held; other columns are
    not looked at."""
    prefixes = saved(_prefixes(_turns(rows)), "prefixes")
    nodes = saved(_nodes(prefixes), "nodes")
    kids = (nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("n_single"))
            .select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), "n_children", "n_single"))
    full = nodes.join(kids, ["d1", "d2"], "left").fillna(0, ["n_children", "n_single"]).join(_ends(prefixes), ["d1", "d2"], "left")
    full = saved(full, "full")
    sums = _subtrees(full, prefixes, piece)
    above = nodes.where("n > 1").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("above"))
    out = full.join(sums, ["d1", "d2"], "left").join(above, ["p1", "p2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth",
                      # only a shared node's child can have another owner than its parent
                      F.when(F.col("depth") > 0, F.coalesce("above", "conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
                      F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie over all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: h is a CRC-32 by bits: every byte of the id is followed by eight marks for a shift.
SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, (xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(c::VARCHAR) + 1),
                    lambda i: list_concat([ascii((c::VARCHAR)[i:i])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
                 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9) AS h FROM ids),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT h.c, o.pos, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % 5 AND o.pos <= h.h
      UNION ALL SELECT h.c, o.pos + 100, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.pos > h.h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, sha256(length(role) || ':' || role || text) AS k, strlen(text) AS bytes FROM b),
p AS (SELECT c, depth, string_agg(k, '') OVER (PARTITION BY c ORDER BY depth) AS key, bytes FROM t
      UNION ALL SELECT c, 0, '', 0 FROM ids),
e AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY depth DESC) = 1 AS ended FROM p),
n AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256 FROM e GROUP BY key, depth),
u AS (SELECT a.key, count(*) FILTER (WHERE d.depth = a.depth + 1) AS n_children, sum((d.n_convs - 1) * d.bytes) AS saved_tokens,
             count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM n x WHERE x.depth = d.depth + 1 AND starts_with(x.key, d.key))) AS n_leaves
      FROM n a JOIN n d ON d.depth >= a.depth AND starts_with(d.key, a.key) GROUP BY a.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, u.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN u USING (key) LEFT JOIN n q ON q.depth = n.depth - 1 AND q.key = left(n.key, greatest(length(n.key) - 64, 0))
"""
