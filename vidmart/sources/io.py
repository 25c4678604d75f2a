"""Readers, writers and input guards.

All readers take an explicit schema (no inference) and return lazy
DataFrames, so column pruning and filters reach the file scan.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from .csv_splits import read_csv_splits


class MissingColumnsError(ValueError):
    pass


class EmptyInputError(ValueError):
    pass


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None,
               cols: Iterable[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Read one landed table.

    CSV text may hold quoted newlines. With a schema it is read in splits that meet at true
    record ends (``csv_splits``); without one Spark has to infer it, with ``multiLine`` and a
    file in one task. Landed CSV is converted to parquet once (``land_csv``) and everything
    else reads parquet.
    """
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv" and schema is not None:
        df = read_csv_splits(spark, path, schema)
    elif fmt == "csv":
        df = (r.option("header", True).option("multiLine", True).option("escape", '"')
              .option("mode", "PERMISSIVE").csv(path))
    elif fmt == "json":
        df = r.option("multiLine", True).json(path)
    else:
        df = r.format(fmt).load(path)
    if cols is not None:
        df = df.select(*cols)
    if where is not None:
        df = df.where(where)
    return df


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def land_csv(spark: SparkSession, src: str, dst: str, schema: StructType,
             partition_by: Iterable[str] = ()) -> None:
    """CSV landing file -> parquet table (one pass; later reads are splittable)."""
    w = read_table(spark, src, "csv", schema).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(dst)


def read_jdbc(spark: SparkSession, url: str, table: str, props: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 8, fetchsize: int = 100_000) -> DataFrame:
    """Whole-table or partitioned JDBC read (S4/S5): ``numPartitions`` parallel range scans
    instead of client-side chunking."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetchsize)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Raise when a required column is absent (no Spark job: schema only)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, name: str = "input") -> DataFrame:
    """Raise on an empty input; ``isEmpty`` reads at most one row."""
    if df.isEmpty():
        raise EmptyInputError(f"{name} is empty")
    return df


def select_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order; skip the rest."""
    return df.select(*[c for c in cols if c in df.columns])


def load_tables(spark: SparkSession, specs: Mapping[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Load a name->path list, skipping paths that do not exist or hold no rows."""
    out = {}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, path in specs.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            continue
        df = read_table(spark, path, fmt)
        if df.isEmpty():
            continue
        out[name] = df
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = ()) -> None:
    """Full overwrite (K1)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = ()) -> None:
    """Append a batch (K2); parquet needs no header handling."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, partition_by: Iterable[str] = (),
                   fmt: str = "parquet") -> None:
    """Save as a catalog table bucketed and sorted by ``key``. Facts and
    dimensions written with the same key and bucket count join without a
    shuffle (each bucket pair is joined locally)."""
    w = df.write.mode("overwrite").format(fmt).bucketBy(buckets, key).sortBy(key)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table)


def publish_table(df: DataFrame, url: str, table: str, props: Mapping[str, str] | None = None,
                  batchsize: int = 10_000) -> None:
    """Replace a database table with batched multi-row inserts (K3)."""
    w = (df.write.mode("overwrite").format("jdbc").option("url", url).option("dbtable", table)
         .option("batchsize", batchsize).option("truncate", "true"))
    for k, v in (props or {}).items():
        w = w.option(k, v)
    w.save()
