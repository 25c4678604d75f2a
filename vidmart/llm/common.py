"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmart.session import scratch_path

#: Bits of a bitmap of keys.
KEY_BITS = 1 << 26
#: Bytes of text that the array kernels work on at a time; they hold up to 140 times as much, in each Python worker.
SLICE_BYTES = 1 << 18


#: Rows of an Arrow batch with whole texts; Spark's own 10,000 would hold 30 MB of usual texts in every buffer.
TEXT_ROWS = 1_000
#: Rows of ids, and rows whose texts are joined or worked on, for which a partition of their own is worth it.
ID_ROWS, WORK_ROWS = 250_000, 2_000


def small_batches(spark: SparkSession) -> None:
    """Let this session hand whole texts to Python in batches of at most ``TEXT_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Chosen columns of the whole ``documents`` table."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


def keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """``docs`` as (rid, cols): rid tells rows apart that repeat a doc_id.

    rid is the place of the row in the scan, so reading the same files again,
    or again after a lost executor, gives the same value."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), *cols)


def _buckets(spark: SparkSession) -> int:
    """As many as shuffle partitions, as far as Spark allows so many."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


def in_buckets(df: DataFrame, bucket: str) -> DataFrame:
    """Deal the rows out as ``saved(..., bucket)`` keeps them, so that a bucket is one file."""
    return df.repartition(_buckets(df.sparkSession), bucket)


def saved(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts the lineage).

    bucket: also keep it in as many buckets of that column as there are shuffle partitions,
    so that a later join on it leaves these rows where they are."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # no reader asks for the marker, and on a local path Hadoop starts a process from the driver for each of its two files
    writer = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    if bucket is None:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        table = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
        writer.format("parquet").option("path", path).bucketBy(_buckets(spark), bucket).saveAsTable(table)
        out = spark.table(table)
        out.held_as = table
    out.held_at = path
    give_back()
    return out


def give_back() -> None:
    """Hand memory that this process has freed back to the system; the C library (glibc) keeps much of it otherwise."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mostly_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``ids`` (key), and a few others, without a shuffle of ``df``.

    A bitmap of ``KEY_BITS`` hashes of the keys is broadcast, 8 MB however many they are; the
    more there are, the more other rows pass. A join with the distinct ids afterwards makes it exact."""
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(KEY_BITS))
    maps = ids.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket")
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*df.columns)


def in_files(df: DataFrame, rows: int, each: int = ID_ROWS) -> DataFrame:
    """``df``, which has about ``rows`` rows, in no more partitions than one for every ``each`` of them or one a core.

    Where shuffles are dealt finer than that, the partitions beyond would be files of a few rows; on a local
    path Hadoop starts two processes from the executor for each file, which for a moment hold its memory too."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def release(*frames: DataFrame) -> None:
    """Delete what saved() wrote for these frames, once no plan will read it again."""
    for df in frames:
        spark = df.sparkSession
        if getattr(df, "held_as", None):
            spark.sql(f"DROP TABLE IF EXISTS {df.held_as}")
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.held_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_arrays(batch.column(column))[1][1:] - text_arrays(batch.column(column))[1][:-1])
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as UTF-8 bytes and row offsets into them; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]
