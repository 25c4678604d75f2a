"""Structured Streaming ingest.

Landed files arrive in a folder; a file-source stream picks them up and a
``foreachBatch`` sink applies the same batch operators as the warehouse
build (insert-or-ignore, keep-last upsert). Stream checkpoints and sink
tables live under the shared checkpoint folder, so a restarted query
resumes where it stopped and re-delivered batches change nothing:

* insert-or-ignore sink: each micro-batch is deduplicated and anti-joined
  against the sink table as committed so far, so replaying a batch adds 0 rows;
* upsert sink: each micro-batch is appended as a version of its own and the
  newest version of a key is taken on read; no batch reads or rewrites an
  older one, and a replayed batch replaces its own version;
* windowed counts: each micro-batch appends its own counts by hour under its
  batch id, and the hours are summed on read; exact for events in any order,
  however late, and a replayed batch replaces its own rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.timefn import instant_to_ntz, ntz_to_instant
from ..operators.dedup import dedup, insert_ignore
from ..session import scratch_path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _data_files(spark: SparkSession, path: str) -> int:
    if not _exists(spark, path):
        return 0
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(1 for st in fs.listStatus(p) if st.getPath().getName().endswith(".parquet"))


def land_in_slices(df: DataFrame, path: str, slice_col: Column, n_slices: int, drop: Sequence[str] = ()) -> int:
    """Write ``df`` as ``n_slices`` successive appends ordered by ``slice_col``
    (e.g. time), so a file stream sees them in arrival order. Returns the
    largest number of files one slice produced: used as ``maxFilesPerTrigger``
    it makes one micro-batch per slice without funnelling a slice through one
    writer task."""
    b = df.withColumn("_vm_slice", slice_col).drop(*drop)
    spark, most, seen = df.sparkSession, 1, 0
    for i in range(n_slices):
        b.where(F.col("_vm_slice") == i).drop("_vm_slice").write.mode("append").parquet(path)
        now = _data_files(spark, path)
        most, seen = max(most, now - seen), now
    return most


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Landed files as a stream; no limit on a micro-batch unless one is asked for."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def in_partitions_of(target: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """The rows of ``target`` in the partitions that ``batch`` touches, named as literals so
    that the scan reads no others. The values are at most as many as there are partitions."""
    values = [r[0] for r in batch.select(column).distinct().collect()]
    some = F.col(column).isin([v for v in values if v is not None])
    return target.where(some | F.col(column).isNull() if None in values else some)


def insert_ignore_sink(target_path: str, keys: Sequence[str], order: Sequence[str] = (),
                       partition_col: str | None = None):
    """foreachBatch function: append the batch rows whose key is new.

    With ``partition_col`` (a column of the batch that is a function of the
    key, e.g. the snapshot month) the target is partitioned by it and each
    batch only reads the target partitions it touches (``in_partitions_of``)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()      # the batch is read several times below
        try:
            if batch.isEmpty():
                return
            if _exists(spark, target_path):
                # the batch schema is the table schema: no inference, and a target
                # folder that holds no file yet reads as empty instead of failing
                target = spark.read.schema(batch.schema).parquet(target_path)
                if partition_col:
                    target = in_partitions_of(target, batch, partition_col)
                new = insert_ignore(target, batch, keys, order)
            else:
                new = dedup(batch, keys, order, keep="first")
            w = new.write.mode("append")
            if partition_col:
                w = w.partitionBy(partition_col)
            w.parquet(target_path)
        finally:
            batch.unpersist()
    return run


KEY, VERSION = "_key", "_version"


def _versions(spark: SparkSession, table_path: str) -> list[str]:
    """Names of the versions of an upsert table, oldest first (as many as batches since it was last compacted)."""
    if not _exists(spark, table_path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    names = [st.getPath().getName() for st in found]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{VERSION}="))


def upsert_into(table_path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = (),
                writer: str | None = None) -> None:
    """Keep-last upsert: the batch, one row per key (the latest in ``order``), becomes the newest
    version of the table. Nothing older is read or rewritten, so a crash at any point leaves
    every earlier version whole. ``writer`` names the batch: written again under the same name it
    replaces its own version and keeps its place; without a name it is always a new version.
    All batches have the same columns. One writer at a time."""
    spark = batch.sparkSession
    known = _versions(spark, table_path)
    tag = writer or "once"
    mine = [v for v in known if v.split("-", 1)[1] == tag] if writer else []
    version = mine[0] if mine else f"v{int(known[-1][1:13]) + 1 if known else 0:012d}-{tag}"
    rows = dedup(batch, keys, order, keep="last").withColumns({KEY: F.struct(*keys), VERSION: F.lit(version)})
    # staged, then one folder is moved into place when the job commits
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(VERSION).parquet(table_path))


def read_upserted(spark: SparkSession, table_path: str) -> DataFrame:
    """For each key the row of its newest version."""
    return dedup(spark.read.parquet(table_path), [KEY], [VERSION], keep="last").drop(KEY, VERSION)


def compact_upserted(spark: SparkSession, table_path: str, to_path: str, keys: Sequence[str]) -> DataFrame:
    """The current rows as the only version of a new table; the old one stays as it is."""
    upsert_into(to_path, read_upserted(spark, table_path), keys)
    return read_upserted(spark, to_path)


def upsert_sink(table_path: str, keys: Sequence[str], order: Sequence[str] = (), stream: str = "stream"):
    """foreachBatch function: keep-last upsert (see ``upsert_into``). ``stream`` tells the
    batches of one checkpoint from those of another that writes to the same table."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_into(table_path, batch, keys, order, f"{stream}.{batch_id}")
    return run


def run_available(stream: DataFrame, sink, checkpoint: str) -> None:
    """Process everything available now, then stop (batch = stream tests,
    scheduled incremental loads)."""
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_insert_ignore(spark: SparkSession, source: str, schema: StructType, target: str,
                         keys: Sequence[str], order: Sequence[str] = (), checkpoint: str | None = None,
                         partition: tuple[str, Column] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Exact de-duplicated append of landed files (no unbounded
    stream state: the sink table is the memory). ``partition`` = (name,
    expression of the key) partitions the sink so each batch prunes it."""
    ck = checkpoint or scratch_path(spark, "ckpt-insert")
    src = file_stream(spark, source, schema, files_per_trigger)
    if partition:
        src = src.withColumn(partition[0], partition[1])
    run_available(src, insert_ignore_sink(target, keys, order, partition[0] if partition else None), ck)
    return spark.read.parquet(target)


def stream_upsert(spark: SparkSession, source: str, schema: StructType, table_path: str, keys: Sequence[str],
                  order: Sequence[str] = (), checkpoint: str | None = None,
                  files_per_trigger: int | None = None) -> DataFrame:
    """Last-wins upsert of landed files into a versioned table."""
    ck = checkpoint or scratch_path(spark, "ckpt-upsert")
    sink = upsert_sink(table_path, keys, order, hashlib.md5(ck.encode()).hexdigest()[:12])
    run_available(file_stream(spark, source, schema, files_per_trigger), sink, ck)
    return read_upserted(spark, table_path)


def hourly_window_counts(events: DataFrame, ts: str, value: str, watermark: str | None = None) -> DataFrame:
    """Tumbling one-hour windows: event count and value total. Works on
    a batch or a streaming frame; the watermark bounds stream state.
    Zone-less event times are mapped to instants as UTC wall clocks and back,
    so windows align with wall-clock hours whatever the session time zone."""
    e = events.withColumn("_vm_ts", ntz_to_instant(ts) if dict(events.dtypes)[ts] == "timestamp_ntz"
                          else F.col(ts).cast("timestamp"))
    if watermark and events.isStreaming:
        e = e.withWatermark("_vm_ts", watermark)
    g = e.groupBy(F.window("_vm_ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value"))
    return g.select(instant_to_ntz("w.start").alias("hour_start"), "n_events", "total_value")


BATCH = "_batch"


def hourly_sink(log_path: str, ts: str, value: str):
    """foreachBatch function: the batch's counts by hour, in a partition of its own batch id
    (written again as a whole when the batch is replayed)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        counts = hourly_window_counts(batch, ts, value).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        (counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BATCH).parquet(log_path))
    return run


def read_hourly(log: DataFrame) -> DataFrame:
    return log.groupBy("hour_start").agg(F.sum("n_events").alias("n_events"), F.sum("total_value").alias("total_value"))


def compact_hourly(spark: SparkSession, log_path: str, to_path: str) -> DataFrame:
    """One row per hour of a finished log, as batch -1 of a new log."""
    read_hourly(spark.read.parquet(log_path)).withColumn(BATCH, F.lit(-1).cast("bigint")) \
        .write.partitionBy(BATCH).parquet(to_path)
    return read_hourly(spark.read.parquet(to_path))


def stream_hourly(spark: SparkSession, source: str, schema: StructType, log_path: str, ts: str, value: str,
                  checkpoint: str | None = None, files_per_trigger: int | None = None,
                  watermark: str | None = None) -> DataFrame:
    """R4 on a stream: counts by hour, exact for any order of files. ``watermark`` is accepted
    for callers that pass one, but there is no state for it to bound and nothing is ever late."""
    ck = checkpoint or scratch_path(spark, "ckpt-hourly")
    run_available(file_stream(spark, source, schema, files_per_trigger), hourly_sink(log_path, ts, value), ck)
    return read_hourly(spark.read.parquet(log_path))


def growth_vs_previous(hourly: DataFrame, time_col: str = "hour_start", value: str = "n_events") -> DataFrame:
    """Each hour against exactly one hour earlier, as an equi-join on the
    shifted key (no single-partition lag window)."""
    prev = hourly.select((F.col(time_col) + F.expr("INTERVAL 1 HOUR")).alias(time_col),
                         F.col(value).cast("double").alias(f"prev_{value}"))
    j = hourly.join(prev, time_col, "left")
    return j.withColumn("growth_pct", F.try_divide((F.col(value) - F.col(f"prev_{value}")) * 100.0,
                                                   F.col(f"prev_{value}")))
