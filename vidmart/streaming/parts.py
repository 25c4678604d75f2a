"""Stream sinks whose micro-batches commit as a whole: parts of tables and a manifest.

A micro-batch writes its rows as new folders (parts), of one table or of several, and then one
small manifest that lists every part of the new state; the manifest is put in its place by a
rename, and that is the commit. Readers read the parts of the newest manifest and nothing else,
so a batch that failed half way has left nothing that counts. The manifest also names the last
batch of each stream: one that is delivered again is skipped. One writer at a time.

* ``quarantine_sink`` (K6): good rows and rejects, with the names of the rules that they fail,
  in one commit.
* ``insert_new_sink`` (R1, R2): append rows with new keys. Beside each part stands a Bloom
  filter of its keys, a small table; a batch asks the filters first and reads the keys of those
  parts alone that may hold one of its own. A batch of new keys reads no old rows.
* ``upsert_levels_sink`` (R3): the newest row of a key. Parts have levels; ``fan`` parts of a
  level become one of the next in the commit that completes them, so a read of n batches merges
  at most (fan - 1) * (levels) parts, levels being 1 + log(n) / log(fan), and each row is
  rewritten once a level.
* ``key_sink`` (W6): a dictionary that gives unseen values the next keys; given keys stay.

Parts that no manifest lists any more stay for readers that still use them; ``vacuum`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..operators.dedup import dedup, extend_keys, insert_ignore
from ..sources.ingest import failed_rules

#: A key sets so many bits of one 64-bit word; there is a word for every two keys.
BITS = 6
ORDER = "_part_order"


class Parts:
    """The committed state of some tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.number, state = -1, {"done": {}, "parts": []}
        if (names := self._manifests()):
            self.number = int(names[-1])
            state = json.loads(spark.read.text(f"{root}/_manifest/{names[-1]}", wholetext=True).first()[0])
        self.done, self.parts = state["done"], state["parts"]

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _manifests(self) -> list[str]:
        folder = self._path("_manifest")
        return sorted(st.getPath().getName() for st in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def has(self, stream: str, batch_id: int) -> bool:
        return self.done.get(stream, -1) >= batch_id

    def write(self, df: DataFrame, table: str, **about) -> dict:
        """Rows as a part that counts once a commit lists it."""
        part = {"table": table, "name": f"{table}-{uuid.uuid4().hex[:12]}", **about}
        df.write.parquet(f"{self.root}/{part['name']}")
        return part

    def commit(self, parts: list[dict], stream: str, batch_id: int) -> None:
        self.number, self.parts, self.done = self.number + 1, parts, {**self.done, stream: max(batch_id, self.done.get(stream, -1))}
        draft, final = self._path(f"_draft-{uuid.uuid4().hex[:12]}"), self._path(f"_manifest/{self.number:012d}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({"done": self.done, "parts": self.parts}).encode()))
        out.close()
        self.fs.mkdirs(final.getParent())
        if not self.fs.rename(draft, final):
            raise OSError(f"{final} exists: another writer has committed")

    def of(self, table: str) -> list[dict]:
        return [p for p in self.parts if p["table"] == table]

    def read(self, parts: Sequence[dict], schema: StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p['name']}" for p in parts])

    def vacuum(self) -> int:
        """Delete parts and manifests of earlier states; returns how many parts went. Not while others read or write."""
        listed, gone = {p["name"] for p in self.parts}, 0
        for st in self.fs.listStatus(self._path()):
            name = st.getPath().getName()
            if name != "_manifest" and name not in listed:
                gone += self.fs.delete(st.getPath(), True)
        for name in self._manifests()[:-1]:
            self.fs.delete(self._path(f"_manifest/{name}"), False)
        return gone


def read_parts(spark: SparkSession, root: str, table: str, schema: StructType) -> DataFrame:
    """The committed rows of a table."""
    state = Parts(spark, root)
    return state.read(state.of(table), schema)


# --------------------------------------------------------------------------- K6

GOOD, REJECTS, FAILED = "good", "rejects", "failed_rules"


def quarantine_sink(root: str, rules: Mapping[str, Column], stream: str = "stream"):
    """foreachBatch function: rows that pass every rule to table ``good``, the others with
    ``failed_rules`` to table ``rejects``, both or neither."""
    def run(batch: DataFrame, batch_id: int) -> None:
        state = Parts(batch.sparkSession, root)
        if state.has(stream, batch_id):
            return
        tagged = batch.withColumn(FAILED, failed_rules(rules)).persist()
        try:
            good = state.write(tagged.where(F.size(FAILED) == 0).drop(FAILED), GOOD)
            bad = state.write(tagged.where(F.size(FAILED) > 0), REJECTS)
            state.commit([*state.parts, good, bad], stream, batch_id)
        finally:
            tagged.unpersist()
    return run


def read_rejects(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    return read_parts(spark, root, REJECTS, StructType([*schema.fields]).add(FAILED, ArrayType(StringType())))


# --------------------------------------------------------------------------- R1, R2

ROWS, FILTER = "rows", "filter"


def _word(keys: Sequence[str], log_words: Column) -> tuple[Column, Column]:
    """The word, of 2**log_words, that a key belongs to in a filter, and its bits there."""
    place, draw = F.xxhash64(F.lit(1), *keys), F.xxhash64(F.lit(2), *keys)
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))
    bits = [power(F.shiftrightunsigned(draw, 10 * i).bitwiseAND(F.lit(63))) for i in range(BITS)]
    return F.shiftrightunsigned(place, 1).bitwiseAND(power(log_words) - 1), reduce(Column.bitwiseOR, bits)


def key_filter(rows: DataFrame, keys: Sequence[str], count: int) -> tuple[DataFrame, int]:
    """(word, bits) of a Bloom filter of the rows' keys, and the logarithm of its number of words."""
    log_words = max(0, (count // 2).bit_length())
    word, bits = _word(keys, F.lit(log_words))
    return rows.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), log_words


def parts_with(state: Parts, batch: DataFrame, keys: Sequence[str]) -> list[dict]:
    """The parts of which the filters let a key of the batch pass: one equi-join of the keys'
    words with the filters' rows. Only part names reach the driver."""
    filters = state.of(FILTER)
    if not filters:
        return []
    known = F.array(*[F.struct(F.lit(f["name"]).alias("name"), F.lit(f["log_words"]).alias("log")) for f in filters])
    asked = batch.select(*keys).distinct().select("*", F.explode(known).alias("_f")).select("*", F.col("_f.name").alias("_name"), F.col("_f.log").alias("_log"))
    word, bits = _word(keys, F.col("_log"))
    asked = asked.select("_name", word.alias("word"), bits.alias("_asked"))
    held = reduce(DataFrame.unionByName, [state.read([f], StructType().add("word", "long").add("bits", "long")).withColumn("_name", F.lit(f["name"])) for f in filters])
    hits = asked.join(held, ["_name", "word"]).where(F.col("_asked").bitwiseAND(F.col("bits")) == F.col("_asked")).select("_name").distinct().collect()
    names = {r["_name"] for r in hits}
    return [p for p in state.of(ROWS) if p["filter"] in names]


def _filter_of(state: Parts, rows: list[dict], schema: StructType, keys: Sequence[str], level: int) -> dict:
    """Write one filter for the keys of these row parts and make them point to it."""
    kept = state.read(rows, schema).select(*keys)
    words, log_words = key_filter(kept, keys, kept.count())
    out = state.write(words, FILTER, log_words=log_words, level=level)
    for p in rows:
        p["filter"] = out["name"]
    return out


def insert_new_sink(root: str, keys: Sequence[str], order: Sequence[str] = (), stream: str = "stream", fan: int = 16):
    """foreachBatch function: append the batch rows whose key is in no part yet, the first of
    each key by ``order``. ``fan`` filters of a level become one of the next, so that a batch
    asks few of them however many batches there were."""
    def run(batch: DataFrame, batch_id: int) -> None:
        state = Parts(batch.sparkSession, root)
        if state.has(stream, batch_id):
            return
        batch = batch.persist()
        try:
            old = parts_with(state, batch, keys)
            new = insert_ignore(state.read(old, batch.schema), batch, keys, order) if old else dedup(batch, keys, order, keep="first")
            rows = [*map(dict, state.of(ROWS)), state.write(new, ROWS)]
            filters, level = [*state.of(FILTER), _filter_of(state, rows[-1:], batch.schema, keys, 0)], 0
            while len(full := [f["name"] for f in filters if f["level"] == level]) >= fan:
                level += 1
                one = _filter_of(state, [p for p in rows if p["filter"] in full], batch.schema, keys, level)
                filters = [f for f in filters if f["name"] not in full] + [one]
            state.commit([*rows, *filters], stream, batch_id)
        finally:
            batch.unpersist()
    return run


# --------------------------------------------------------------------------- R3

VERSIONS = "versions"


def upsert_levels_sink(root: str, keys: Sequence[str], order: Sequence[str] = (), stream: str = "stream", fan: int = 8):
    """foreachBatch function: keep-last upsert; a later batch wins over an earlier one, inside a
    batch the latest by ``order``. Rows of equal keys in ``fan`` parts of a level are merged to
    the newest as part of the commit."""
    def run(batch: DataFrame, batch_id: int) -> None:
        state = Parts(batch.sparkSession, root)
        if state.has(stream, batch_id):
            return
        age = 1 + max([p["age"] for p in state.parts], default=-1)
        part = state.write(dedup(batch, keys, order, keep="last").withColumn(ORDER, F.lit(age).cast("bigint")), VERSIONS, level=0, age=age)
        parts, level = [*state.parts, part], 0
        while len(full := [p for p in parts if p["level"] == level]) >= fan:
            merged = dedup(state.read(full, StructType([*batch.schema.fields]).add(ORDER, "long")), keys, [ORDER], keep="last")
            one = state.write(merged, VERSIONS, level=level + 1, age=age)
            parts, level = [p for p in parts if p["level"] != level] + [one], level + 1
        state.commit(parts, stream, batch_id)
    return run


def read_levels(spark: SparkSession, root: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """For each key the row of the newest batch."""
    rows = read_parts(spark, root, VERSIONS, StructType([*schema.fields]).add(ORDER, "long"))
    return dedup(rows, keys, [ORDER], keep="last").drop(ORDER)


# --------------------------------------------------------------------------- W6

KEYS = "keys"


def _key_schema(col: str, kind, key_name: str) -> StructType:
    return StructType().add(key_name, "long").add(col, kind)


def key_sink(root: str, col: str, key_name: str, stream: str = "stream"):
    """foreachBatch function: values of ``col`` that the dictionary below ``root`` does not hold get
    the keys above its greatest. A batch writes its new values alone; a replayed one changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        state = Parts(batch.sparkSession, root)
        if state.has(stream, batch_id):
            return
        known = state.read(state.of(KEYS), _key_schema(col, batch.schema[col].dataType, key_name))
        state.commit([*state.parts, state.write(extend_keys(known, batch, col, key_name), KEYS)], stream, batch_id)
    return run


def read_keys(spark: SparkSession, root: str, col: str, kind, key_name: str) -> DataFrame:
    """The dictionary (key_name, col)."""
    return read_parts(spark, root, KEYS, _key_schema(col, kind, key_name))
